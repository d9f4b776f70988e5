"""Tables, documents and bytes in files."""

from __future__ import annotations

import csv
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import PREFIXES


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> tuple[list[str], DataFrame]:
    """Headers (which may repeat) and rows of CSV files; the separator is guessed from the first line if not given."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0].lstrip("\ufeff") if first else ""
    sep = sep or sniff(line)
    headers = next(csv.reader([line], delimiter=sep), [])
    names = [f"c{i}" for i in range(len(headers))]
    schema = ", ".join(f"{n} string" for n in names) or "c0 string"
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, quote='"', escape='"', encoding=encoding, enforceSchema=True)
    return headers, df


def sniff(line: str) -> str:
    """The separator of a header line: the one of , ; tab | that occurs most often outside quotes."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",;\t|", key=lambda c: (bare.count(c), -",;\t|".index(c)))


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=True, quote='"', escape='"')


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as JSON (column doc) from JSON Lines, or from YAML files with sections of documents.

    YAML files are parsed one per task; a section's name becomes the ``@type`` of documents without one.
    """
    if not re.search(r"\.ya?ml$", path.rstrip("/*")):
        return spark.read.text(path).select(F.col("value").alias("doc")).where("trim(doc) <> ''")

    def run(frames):
        import yaml

        for frame in frames:
            rows = []
            for text in frame["value"]:
                whole = yaml.safe_load(text) or {}
                for section, found in whole.items():
                    if section in ("@context", "prefixes"):
                        continue
                    for d in found if isinstance(found, list) else [found]:
                        rows.append(json.dumps({"@type": section} | d if section != "@graph" else d, default=str))
            yield pd.DataFrame({"doc": rows})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "doc string")


def read_bytes(spark: SparkSession, triples: DataFrame, datasets: DataFrame, retries: int = 1) -> DataFrame:
    """s, url and content of the files that datasets (column s) are distributed as.

    Each dataset's distributions (``dcat:distribution`` to ``dcat:downloadURL``, or a URL of its own) are
    looked up by joins; local and Hadoop paths are read by Spark's binary source.
    """
    dcat = PREFIXES["dcat"]
    urls = triples.where(F.col("p") == dcat + "downloadURL").select(F.col("s").alias("d"), F.regexp_replace("o", '^"|"(\\^\\^.*)?$', "").alias("url"))
    via = triples.where(F.col("p") == dcat + "distribution").select("s", F.col("o").alias("d"))
    found = via.join(urls, "d").select("s", "url").unionByName(urls.select(F.col("d").alias("s"), "url")).join(datasets, "s", "left_semi")
    paths = sorted({r.url for r in found.select("url").distinct().collect()})
    if not paths:
        return found.select("s", "url", F.lit(None).cast("binary").alias("content")).where("false")
    data = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return found.join(data, F.regexp_replace("url", "^file:/+", "/") == F.col("path")).select("s", "url", "content")


def save_prefixes(spark: SparkSession, prefixes: dict[str, str]) -> DataFrame:
    """Triples that declare prefixes."""
    vann = PREFIXES["vann"]
    rows = [t for p, ns in prefixes.items() for t in ((f"_:prefix_{p}", vann + "preferredNamespacePrefix", f'"{p}"'), (f"_:prefix_{p}", vann + "preferredNamespaceUri", f'"{ns}"'))]
    return spark.createDataFrame(rows, "s string, p string, o string")


def load_prefixes(triples: DataFrame) -> DataFrame:
    """prefix and namespace declared in triples."""
    from graphloom.functions import terms
    from graphloom.operators.solutions import match

    vann = PREFIXES["vann"]
    found = match(triples, ("?d", vann + "preferredNamespacePrefix", "?prefix"), ("?d", vann + "preferredNamespaceUri", "?namespace"))
    return found.df.select(terms.lexical(F.col("prefix")).alias("prefix"), terms.lexical(F.col("namespace")).alias("namespace")).distinct()
