"""Exact deduplication on a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is deduplicated within
itself by an aggregation over digests, against history by a sort-merge anti-join that reads the
index's buckets without shuffling them, and its new digests are appended.

The index is a log: a digest that a later batch brings again gets a further row, and the rows of a digest
add up (``resolved``), so the longest text stays whichever batch brought it.

Defined cases: a null text counts as empty; texts that differ only in white space
(space, tab, line feed, vertical tab, form feed, carriage return) are equal; of equal texts the
one with the most code points stays, then the smallest ``doc_id`` (null ids come last). Rows
repeated with the same id and text form one group and share one fate in ``groups``;
``DigestIndex.add`` and ``keep`` let only one of them through. Texts may be of any length. Empty tables
give empty results. Columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import SPACE, batches_of, materialise, scratch, text_or_empty


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, length (code points of the original) and text_sha256 of the normalised text."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.length(text).cast("long").alias("length"),
        F.sha2(F.translate(text, SPACE, ""), 256).alias("text_sha256"),
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: keep_id, keep_length and group_size. Partial sums run before the shuffle."""
    # least struct wins: longest first, then null ids last, then the smallest id
    order = F.struct(-F.col("length"), F.col("doc_id").isNull(), "doc_id")
    return rows.groupBy("text_sha256").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")
    ).select("text_sha256", F.col("first.doc_id").alias("keep_id"), (-F.col("first.col1")).alias("keep_length"), "group_size")


class DigestIndex:
    """A table of known digests, bucketed and sorted by digest, that outlives the session.

    ``path`` holds the files; the catalog entry is made anew in each session from ``path`` and
    ``buckets`` (keep the same number over an index's life). At 100 TB use some thousand buckets,
    so that a bucket's digests fit one task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        # the whole path counts: paths that end alike are different indexes
        self.table = f"digests_{zlib.crc32(path.encode()):08x}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        self.again = self.table + "_again"
        for table, folder in ((self.table, "first"), (self.again, "again")):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, keep_length BIGINT, group_size BIGINT)"
                f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'"
            )
            known = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            if not known.get("Location", "").rstrip("/").endswith(f"{path.split(':', 1)[-1].rstrip('/')}/{folder}".lstrip("/")) or known.get("Num Buckets") != str(buckets):
                raise ValueError(f"{table} is known with other files or another number of buckets")

    def rows(self) -> DataFrame:
        """The first row of every digest."""
        return self.spark.table(self.table)

    def resolved(self) -> DataFrame:
        """digest, keep_id and group_size over all batches."""
        order = lambda length, name: F.struct((-length).alias("minus"), name.isNull().alias("none"), name.alias("keep_id"))
        # both tables are bucketed and sorted by digest: an aggregation and a merge join without a shuffle
        again = self.spark.table(self.again).groupBy("digest").agg(F.min(order(F.col("keep_length"), F.col("keep_id"))).alias("more"), F.sum("group_size").alias("n"))
        rows = self.rows().join(again.hint("merge"), "digest", "left")
        first = F.least(order(F.col("keep_length"), F.col("keep_id")), "more")
        return rows.select("digest", first["keep_id"].alias("keep_id"), (F.col("group_size") + F.coalesce("n", F.lit(0))).alias("group_size"))

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with a ``digest`` column) whose digest is not in the index."""
        return batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def seen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose digest is in the index."""
        return batch.join(self.rows().select("digest").hint("merge"), "digest", "left_semi")

    def _append(self, rows: DataFrame, table: str) -> None:
        (
            rows.select("digest", "keep_id", "keep_length", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)
        )

    def append(self, fresh: DataFrame) -> None:
        """Append rows of the index's columns, each bucket sorted by digest."""
        self._append(fresh, self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicate a batch within itself and against history; append what is new.

        Returns one index row (digest, keep_id, keep_length, group_size) for each text that
        history did not have: what a consumer that works batch by batch lets through. ``group_size``
        counts the batch's rows. Texts that history has are logged for ``resolved``.
        """
        batch = materialise(winners(digests(docs)).withColumnRenamed("text_sha256", "digest"), "batch-digests")
        return self._take(batch)

    def _take(self, batch: DataFrame) -> DataFrame:
        fresh = materialise(self.unseen(batch), "fresh-digests")
        self._append(self.seen(batch), self.again)
        self.append(fresh)
        return fresh


def groups(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Without ``index`` a fresh one is built in the shared folder. The table is taken in by ascending ids
    in some batches, each deduplicated against those before it. The digests are written once, so texts
    are hashed once; the join back runs on plain shuffles, where adaptive execution splits a digest
    that holds a large part of all rows.
    """
    spark = docs.sparkSession
    rows = materialise(digests(docs), "digests")
    index = index or DigestIndex(spark, scratch(spark, "digest-index"))
    for own in batches_of(rows, batches):
        index._take(materialise(winners(own).withColumnRenamed("text_sha256", "digest"), "batch-digests"))
    known = index.resolved().withColumnRenamed("digest", "text_sha256")
    return rows.join(known, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


#: Rows (some 100 bytes each) of ids and digests at most that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 300_000


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row for each distinct text.

    The rows that go are found on ids and digests alone and taken out by an anti-join, in the scan
    where they are few; texts are only shuffled where they are not.
    """
    rows = materialise(digests(docs), "digests")
    best = winners(rows).withColumnRenamed("keep_id", "best").where("group_size > 1")
    marked = rows.join(best, "text_sha256").groupBy("doc_id", "text_sha256", "length").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("doc_id").eqNullSafe(F.col("best")) & (F.col("length") == F.col("keep_length"))).alias("stays")
    )
    # of a row that is there several times with its id all go, and one comes back
    out = materialise(marked.where("NOT stays OR n > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), "length", "stays"), "gone-rows")
    twice = out.where("stays")

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = docs["doc_id"].eqNullSafe(out["id"]) & (F.sha2(F.translate(text, SPACE, ""), 256) == out["digest"]) & (F.length(text) == out["length"])
    stay = docs.join(side(out), same, "left_anti")
    if not twice.isEmpty():
        back = docs.join(side(twice), docs["doc_id"].eqNullSafe(twice["id"]) & (F.sha2(F.translate(text, SPACE, ""), 256) == twice["digest"]) & (F.length(text) == twice["length"]), "left_semi")
        digest, length = _free(docs, 2)
        back = back.withColumns({digest: F.sha2(F.translate(text_or_empty(), SPACE, ""), 256), length: F.length(text_or_empty())})
        stay = stay.unionByName(back.dropDuplicates(["doc_id", digest, length]).drop(digest, length))
    return stay


def _free(docs: DataFrame, n: int) -> list[str]:
    """Column names that the table does not have."""
    lower = {c.lower() for c in docs.columns}
    return [c for c in (f"own_{i}" for i in range(len(lower) + n)) if c not in lower][:n]
