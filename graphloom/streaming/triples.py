"""Triples as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of triples from N-Triples files as they arrive in a folder, with the time they were read."""
    from graphloom.sources.ntriples import LINE

    rows = spark.readStream.text(path).where(F.col("value").rlike(LINE))
    part = lambda i: F.regexp_extract("value", LINE, i)
    pick = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    return rows.select(pick(part(1), part(2)).alias("s"), part(3).alias("p"), pick(part(4), part(5), part(6)).alias("o"), F.current_timestamp().alias("at"))


def lift_events(events: DataFrame, base: str = "http://example.com") -> DataFrame:
    """A stream of event rows as triples with the event's time."""
    kinds = dict(events.dtypes)
    subject = F.concat(F.lit(f"{base}/events/"), F.col("event_id").cast("string"))
    cells = F.array(*[F.struct(F.lit(f"{base}/events#{c}").alias("p"), terms.from_native(F.col(c), kinds[c]).alias("o")) for c in events.columns if c != "ts"])
    return events.select(subject.alias("s"), F.inline(cells), F.col("ts").cast("timestamp").alias("at")).where("o IS NOT NULL")


def as_set(triples: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A triple passes once within the watermark's delay; state older than it is dropped."""
    return triples.withWatermark("at", delay).dropDuplicatesWithinWatermark(["s", "p", "o"])


def append_to_store(triples: DataFrame, path: str, checkpoint: str):
    """Start a query that appends a stream to a saved store (Parquet by predicate), exactly once."""
    return triples.select("s", "p", "o").writeStream.format("parquet").partitionBy("p").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(triples: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Triples by predicate and time window; late ones beyond the delay are dropped."""
    counted = triples.withWatermark("at", delay).groupBy(F.window("at", width), "p").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "p", "n")
