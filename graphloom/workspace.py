"""The folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; local sessions without it get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so its lineage ends there.

    The files are plain: Spark takes their size for the table's, and compressed triples many times
    the broadcast limit would look small enough to be broadcast.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files and names below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self._conf), at

    def exists(self, name: str) -> bool:
        files, at = self._at(name)
        return files.exists(at)

    def names(self, name: str = "") -> list[str]:
        """What a folder holds; nothing if it is not there."""
        files, at = self._at(name)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def make(self, name: str) -> None:
        files, at = self._at(name)
        files.mkdirs(at)

    def remove(self, name: str) -> None:
        files, at = self._at(name)
        files.delete(at, True)

    def text(self, name: str) -> str:
        files, at = self._at(name)
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file whole and move it into place; False if the name is taken."""
        files, at = self._at(f"{name}.{uuid.uuid4().hex[:12]}.tmp")
        files.mkdirs(at.getParent())
        stream = files.create(at, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, to = self._at(name)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(at, to, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception:
            files.delete(at, False)
            if files.exists(to):
                return False
            raise
        return True
