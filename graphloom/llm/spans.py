"""Matches with positions, found with SQL functions alone.

``split`` and ``regexp_extract_all`` walk a text alike, so gaps and matches alternate and their
lengths add up to code-point positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are placed one after another; more are placed block by block, so the work stays in proportion.
BLOCK = 256
SPAN = "array<struct<at:bigint,until:bigint,match:string,left:string,right:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def spans_of(text: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (never empty ones) in ``text``.

    Each is a struct of start and end (end exclusive, in code points), the match, and up to
    ``context`` characters of the text on either side that belong to no other match. Texts
    without a match cost one search.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next"))
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, n: acc + n)

    def step(acc: Column, x: Column) -> Column:
        gap, match, after = x["gap"], x["match"], x["next"]
        at = acc["at"] + F.length(gap)
        until = at + F.coalesce(F.length(match), F.lit(0))
        one = F.struct(
            at.cast("long").alias("at"), until.cast("long").alias("until"), match.alias("match"),
            (F.right(gap, F.lit(context)) if context else F.lit("")).alias("left"),
            (F.left(after, F.lit(context)) if context else F.lit("")).alias("right"),
        )
        grown = F.when(match.isNotNull(), F.concat(acc["spans"], F.array(one).cast(SPAN))).otherwise(acc["spans"])
        return F.struct(until.cast("long").alias("at"), grown.alias("spans"))

    def walk(block: Column, at: Column) -> Column:
        start = F.struct(at.cast("long").alias("at"), no_spans().alias("spans"))
        return F.aggregate(block, start, step, lambda acc: acc["spans"])

    def many(all_pieces: Column) -> Column:
        # blocks of pieces keep the growing arrays short; a block starts where the lengths before it add up to
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_pieces, b * BLOCK + 1, F.lit(BLOCK)))
        sized = F.transform(blocks, lambda block: F.struct(block.alias("block"), total(F.transform(block, size)).cast("long").alias("size")))
        return let(sized, lambda bs: F.flatten(F.transform(bs, lambda b, i: walk(b["block"], total(F.transform(F.slice(bs, F.lit(1), i), lambda x: x["size"]))))))

    return F.when(text.rlike(pattern), let(pieces, lambda p: F.when(F.size(p) <= BLOCK, walk(p, F.lit(0))).otherwise(many(p)))).otherwise(no_spans())


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as (order, at, kind, until), the form in which kinds are merged and sorted."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("order"), s["at"].alias("at"), F.lit(kind).alias("kind"), s["until"].alias("until")))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")
