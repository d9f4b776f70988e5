"""Named stores from a configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.operators.lift import Lifted
from graphloom.operators.store import TripleStore
from graphloom.sources import ntriples, turtle


class Session:
    """Stores by name: a mapping of name to ``path``, ``format`` (parquet, ntriples, turtle, tables) and ``prefixes``."""

    def __init__(self, spark: SparkSession, config: dict[str, dict]):
        self.spark, self.config = spark, config

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> Session:
        import yaml

        return cls(spark, yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]))

    def names(self) -> list[str]:
        return list(self.config)

    def store(self, name: str) -> TripleStore:
        spec = self.config[name]
        path, kind, prefixes = spec["path"], spec.get("format", "parquet"), spec.get("prefixes")
        if kind == "parquet":
            return TripleStore.load(self.spark, path, prefixes)
        if kind == "tables":
            return TripleStore(self.spark, Lifted(self.spark, path).graph(*spec.get("tables", ())), prefixes)
        readers = {"ntriples": ntriples.read, "turtle": turtle.read}
        if kind not in readers:
            raise ValueError(f"unknown format {kind!r}")
        return TripleStore(self.spark, readers[kind](self.spark, path), prefixes)
