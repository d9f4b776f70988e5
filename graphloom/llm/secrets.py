"""Secret scanning with multipart credential linking, in SQL functions only.

Base spans are strong on their own: assignments to a secret's name, access-key identifiers and
long hexadecimal strings. Weak candidates are reported only where complementary parts of a
credential stand close together in one document: an identifier, a secret and an endpoint.

Linking is an interval join. Positions fall into scopes of ``SCOPE`` characters; parts are first
reduced to their least and greatest position per document, scope and role, and each weak candidate
meets the summaries of its own and the two neighbouring scopes. Within its own scope any part is
near enough; of a neighbouring scope the nearest position decides. So the join is exact for
"starts at most SCOPE characters apart", and no pairs of parts are ever listed.

Defined cases: a null text has no spans; a row without ``doc_id`` is scanned like any other (rows
are told apart by content and id, so repeated rows give repeated results); matches that fail their
length test are dropped without a retry; a weak secret that starts where a base assignment
starts is that assignment and not reported again; other linked spans may overlap base spans and each
other; parts and texts may be of any length; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise, text_or_empty
from graphloom.llm.spans import listed, no_spans, spans_of, tagged

#: Farthest distance of linked parts, in code points.
SCOPE = 200

#: The base patterns of the contract, with possessive or anchored repetition.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

#: Weak parts by role.
IDENTIFIER = r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}+"""
SECRET = r"""(?i:\b(?:pwd|pass(?:word|wd)?|pin|secret|token|credential|private_?key|auth))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!#$%&*-]{4,}+"""
ENDPOINT = r"(?i:\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s?ftp|ssh)://[^\s\"'<>]{3,}+)"


def _base(text: Column) -> Column:
    def kept(spans: Column, rule) -> Column:
        return F.filter(spans, rule)

    assign = kept(spans_of(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    access = kept(F.when(text.contains("AKIA"), spans_of(text, ACCESS)).otherwise(no_spans()), lambda s: F.length(s["match"]) >= 16)
    return F.struct(assign.alias("assign"), access.alias("access"), spans_of(text, HEX).alias("hex"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and linked spans.

    ``base`` is an array of (at, order, kind, until) sorted by position and kind, ``linked`` an
    array of weak candidates that complementary parts confirm, and n_assign, n_access, n_hex
    count the base spans.
    """
    text = text_or_empty()
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _base(text).alias("b"), *[
        spans_of(text, pattern).alias(role) for role, pattern in (("identifier", IDENTIFIER), ("secret", SECRET), ("endpoint", ENDPOINT))
    ])
    found = found.select(
        "doc_id", "row",
        *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.array_sort(F.transform(
            F.concat(*[tagged(F.col(f"b.{k}"), k, i) for i, k in enumerate(BASE_KINDS)]),
            lambda s: F.struct(s["at"].alias("at"), s["order"].alias("order"), s["kind"].alias("kind"), s["until"].alias("until")),
        )).alias("base"),
        F.concat(
            # an access key is an identifier too, a strong secret completes a weak identifier
            tagged(F.col("b.access"), "access", 0), tagged(F.col("identifier"), "identifier", 1),
            tagged(F.col("secret"), "secret", 2), tagged(F.col("b.assign"), "assign", 2), tagged(F.col("b.hex"), "hex", 2),
            tagged(F.col("endpoint"), "endpoint", 3),
        ).alias("parts"),
    )
    found = materialise(found, "secret-parts")
    parts = found.where(F.size("parts") > 1).select("row", F.inline("parts")).withColumn("role", F.greatest("order", F.lit(1)))
    linked = _link(parts)
    return found.join(linked, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in BASE_KINDS], "base",
        F.coalesce("linked", F.array().cast("array<struct<at:bigint,order:int,kind:string,until:bigint>>")).alias("linked"),
    )


def _link(parts: DataFrame) -> DataFrame:
    """Weak parts (row, at, kind, until, role) near parts of another role, collected per row.

    A weak identifier or secret needs the other of the two nearby; an endpoint alone confirms
    a secret but not an identifier.
    """
    scope = F.floor(F.col("at") / SCOPE)
    summary = parts.groupBy("row", scope.alias("scope"), "role").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    strong = parts.where("kind = 'assign'").select("row", "at")
    weak = parts.where(F.col("kind").isin("identifier", "secret")).join(strong, ["row", "at"], "left_anti").withColumn("own", scope)
    probes = weak.withColumn("scope", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    near = (F.col("scope") == F.col("own")) | (
        (F.col("scope") < F.col("own")) & (F.col("at") - F.col("hi") <= SCOPE)
    ) | ((F.col("scope") > F.col("own")) & (F.col("lo") - F.col("at") <= SCOPE))
    partner = F.when(F.col("role") == 1, F.col("other") == 2).otherwise(F.col("other").isin(1, 3))
    hits = probes.join(summary.withColumnRenamed("role", "other"), ["row", "scope"]).where(near & partner)
    return hits.select("row", F.struct("at", F.col("order").alias("order"), "kind", "until").alias("s")).groupBy("row").agg(
        F.array_sort(F.collect_set("s")).alias("linked")
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    out = scan(docs)
    everything = F.array_sort(F.concat("base", F.transform("linked", lambda s: F.struct(s["at"].alias("at"), (s["order"] + 3).alias("order"), s["kind"].alias("kind"), s["until"].alias("until")))))
    return out.select(
        "doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(everything).alias("spans"),
    )
