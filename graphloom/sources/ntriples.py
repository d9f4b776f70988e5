"""N-Triples: one statement per line, so files split anywhere between lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms

_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*)>"
_BLANK = r"(_:[A-Za-z0-9_][A-Za-z0-9_.-]*)"
#: Possessive, so that literals of any length match without recursion.
_LITERAL = r'("[^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?)'
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def parse(lines: DataFrame, scope: str = "", strict: bool = True) -> DataFrame:
    """Triples of a DataFrame of lines (column value).

    Blank node labels are local to a load and get its ``scope``. With ``strict`` a line that is
    neither a statement, a comment nor empty raises an error; else it is left out.
    """
    part = lambda i: F.regexp_extract("value", LINE, i)
    blank = lambda c: F.when(c != "", F.concat(F.lit("_:" + scope), F.substr(c, F.lit(3))))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(LINE)
    if strict:
        checked = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.left("value", F.lit(200)))))
        rows = rows.withColumn("value", checked)
    else:
        rows = rows.where(good)
    iri = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        F.coalesce(blank(part(2)), part(1)).alias("s"), part(3).alias("p"), F.coalesce(blank(part(5)), iri(part(6)), part(4)).alias("o"),
    ).distinct()


def read(spark: SparkSession, path: str, scope: str | None = None, strict: bool = True) -> DataFrame:
    """Triples of N-Triples files."""
    import zlib

    return parse(spark.read.text(path), f"f{zlib.crc32(path.encode()):08x}_" if scope is None else scope, strict)


def lines(triples: DataFrame) -> DataFrame:
    """Statements as lines (column value)."""
    node = lambda c: F.when(F.col(c).startswith("_:") | F.col(c).startswith('"'), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    return triples.select(F.concat_ws(" ", node("s"), node("p"), node("o"), F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines(triples).write.mode(mode).text(path)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str], mode: str = "errorifexists") -> None:
    """Turtle, a subject to a line with its predicates grouped; every part file repeats the prefixes."""
    from pyspark.sql import Window

    node = lambda c: F.when(F.col(c).startswith("_:") | F.col(c).startswith('"'), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    objects = triples.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set(node("o"))), ", ").alias("o"))
    subjects = objects.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", node("p"), "o"))), " ; ").alias("po"))
    body = subjects.select(F.concat(node("s"), F.lit(" "), "po", F.lit(" .")).alias("value"))
    head = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(prefixes.items()))
    w = Window.partitionBy(F.spark_partition_id()).orderBy("value")
    body.withColumn("n", F.row_number().over(w)).select(F.when(F.col("n") == 1, F.concat(F.lit(head), "value")).otherwise(F.col("value")).alias("value")).write.mode(mode).text(path)
