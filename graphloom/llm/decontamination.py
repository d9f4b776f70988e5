"""Benchmark decontamination by spaced-seed hashing, in SQL functions only.

Words are lower-cased and lose ASCII punctuation. A mask keeps some positions of a window of words and ignores
others; the hash of the kept words is a seed. Seeds of all windows of the documents are joined with the seeds of all
windows of the benchmark, so a copy whose words were replaced here and there still meets its original. Every hit names a
diagonal (document position minus item position); around it document and item are compared word by word, and an overlap
counts if, of some stretch of ``STRETCH`` item words (the whole item if that is shorter), at least ``SIMILARITY`` agree.

The masks find every such overlap. A stretch of 13 words with 11 agreeing ones has four in a row; 10 to 12 words with
two replaced ones have four in a row, or two on either side of a replaced one; 5 to 9 words with one replaced one have five
in a row of which at most one was replaced; shorter items must agree in full, and have seeds of their own width where the benchmark
has any.

Defined cases: a null or empty text has no words and no overlaps; items without words are never found; a row without
``doc_id`` is never reported and never removed. Repeated rows are reported once. Ties: overlaps of one document and item
are merged into one row with the best score, then the smallest start. Texts may be of any length, as far as their words fit
one row; empty tables give empty results; other columns are ignored, whatever their names, and ``clean`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise, text_or_empty

#: Kept (1) and ignored (0) word positions.
MASKS = ("1111", "10111", "11011", "11101")
#: Items of fewer words than this have a mask that keeps all their words.
SHORT = 4
STRETCH = 13
SIMILARITY = 0.8
#: A side of at most so many rows of 24 bytes is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: Column) -> Column:
    """Lower-cased words without ASCII punctuation; words of nothing else vanish."""
    # white space becomes blanks, punctuation (beyond the replacement's end) goes
    plain = F.translate(F.lower(text), "\t\n\x0b\f\r" + PUNCTUATION, " " * 5)
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def _seeds(words: Column, masks: list[str]) -> Column:
    """For every start, an array with the seed of each mask (null where it does not fit)."""

    def of(mask: str, i: Column) -> Column:
        kept = [F.get(words, i + j) for j, c in enumerate(mask) if c == "1"]
        return F.when(i + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))

    return F.transform(words, lambda w, i: F.array(*[of(m, i) for m in masks]))


def seeds(df: DataFrame, key: str, masks: list[str]) -> DataFrame:
    """key, at (word position) and seed of every window and mask."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), words_of(text_or_empty()).alias("words"))
    rows = rows.select(key, F.posexplode(_seeds(F.col("words"), masks)).alias("at", "all"))
    return rows.select(key, "at", F.explode("all").alias("seed")).where("seed IS NOT NULL")


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a materialised table only if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, start, n_words, score.

    ``start`` is the document's word position where the item's first word lies (negative if the
    item's beginning is missing), ``n_words`` the item's words, ``score`` the share of agreeing words
    in the best stretch.
    """
    sizes = benchmark.where("item_id IS NOT NULL").select(F.size(words_of(text_or_empty())).alias("n"))
    # fewer than SHORT rows
    narrow = [r["n"] for r in sizes.where(f"n > 0 AND n < {SHORT}").distinct().orderBy("n").collect()]
    masks = [*MASKS, *("1" * n for n in narrow)]
    known = materialise(seeds(benchmark, "item_id", masks).withColumnRenamed("at", "item_at"), "benchmark-seeds")
    hits = seeds(docs, "doc_id", masks).join(_sized(known), "seed").select("doc_id", F.col("at").alias("doc_at"), "item_id", F.col("item_at").alias("at"))
    hits = materialise(
        hits.select("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct(), "seed-hits"
    )
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_or_empty().alias("text")).join(
        _sized(materialise(hits.select("doc_id").distinct(), "hit-documents")), "doc_id", "left_semi"
    ).select("doc_id", words_of(F.col("text")).alias("words"))
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(text_or_empty()).alias("item")).where("size(item) > 0")
    pairs = texts.join(hits, "doc_id").join(items, "item_id")
    agree = F.transform("item", lambda w, i: F.when(F.try_element_at("words", _index(F.col("diagonal") + i)).eqNullSafe(w), 1).otherwise(0))
    pairs = pairs.select("doc_id", "item_id", "diagonal", F.size("item").cast("long").alias("n_words"), agree.alias("agree"))
    width = F.least(F.size("agree"), F.lit(STRETCH))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("agree") - width + 1),
        lambda s: F.aggregate(F.slice("agree", s, width), F.lit(0), lambda a, b: a + b),
    )) / width
    scored = pairs.select("doc_id", "item_id", F.col("diagonal").cast("long").alias("start"), "n_words", best.alias("score")).where(F.col("score") >= SIMILARITY)
    return scored.groupBy("doc_id", "item_id").agg(F.min(F.struct(-F.col("score"), "start", "n_words")).alias("b")).select(
        "doc_id", "item_id", "b.start", "b.n_words", (-F.col("b.col1")).alias("score")
    )


def _index(position: Column) -> Column:
    """One-based index for try_element_at, with a value beyond any array for negative positions."""
    return F.when(position >= 0, position + 1).otherwise(F.lit(2**31 - 1))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    found = materialise(overlaps(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(_sized(found.withColumnRenamed("doc_id", "__found")), docs["doc_id"] == F.col("__found"), "left_anti")
