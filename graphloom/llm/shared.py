"""Places and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words in the operators' contracts.
SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a session in local mode may leave the setting out (as tests do); it then gets a
    temporary folder. On a cluster a missing setting is an error, since a machine-local folder
    would hide one executor's files from the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts of more characters are encoded and counted in parts of about so many.
CUT = 4_000_000
_BORDER = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


def cut(text: str) -> Iterator[str]:
    """Parts of a text, each but the first starting with a single blank between two characters that are not white space."""
    start = 0
    while len(text) - start > CUT and (found := _BORDER.search(text, start + CUT)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


_HELD: list = []


def worker_state(key, make):
    """What a Python worker keeps between tasks: one thing at a time, so caches of different operators don't add up."""
    if not _HELD or _HELD[0] != key:
        _HELD.clear()
        gc.collect()
        _HELD[:] = [key, make()]
    return _HELD[1]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sample_by_hash(rows: DataFrame, k: int, by: str | None = None, seed: int = 42) -> DataFrame:
    """The ``k`` texts with the smallest 64-bit hashes among ``rows``, of each ``by`` if that is given.

    ``rows`` has columns ``text`` and ``by``. Copies count once. A group of fewer texts is taken whole; of a larger
    one about 2k hashes lie under the threshold that its number of texts gives, however large it is.
    """
    keys = [by] if by else []
    hashed = rows.select(*keys, "text", F.xxhash64("text", F.lit(seed)).alias("__h"))
    totals = hashed.select(*keys, "__h").distinct().groupBy(*keys).count().collect()
    limit = F.lit(None).cast("long")
    for r in totals:
        top = F.lit(hash_limit(k, r["count"]))
        limit = F.when(F.col(by) == r[by], top).otherwise(limit) if by else top
    few = hashed.where(F.col("__h") <= limit).dropDuplicates([*keys, "__h"])
    ranked = few.withColumn("__n", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__h")))
    return ranked.where(F.col("__n") <= k).select(*keys, "text")


def hash_limit(k: int, n: int) -> int:
    """The signed 64-bit value up to which about 2k of n hashes lie; all of them if there are no more."""
    return 2**63 - 1 if n <= 2 * k else -(2**63) + (2 * k << 64) // n


def batches_of(rows: DataFrame, n: int, by: str = "doc_id") -> list[DataFrame]:
    """Every row in one of ``n`` batches of about equal size by ascending ids; rows without an id are in the first."""
    cuts = sorted(set(rows.approxQuantile(by, [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    out = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = F.lit(True) if low is None else F.col(by) >= F.lit(low)
        own = own if high is None else own & (F.col(by) < F.lit(high)) if low is not None else (F.col(by).isNull() | (F.col(by) < F.lit(high)))
        out.append(rows.where(own))
    return out
