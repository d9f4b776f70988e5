"""Relational tables as virtual triples.

A table with a key becomes resources ``<base>/<table>/<key>``, one triple for each non-null cell
(predicate ``<base>/<table>#<column>``), foreign keys linking resources, and an ``rdf:type``. Nothing
is copied: a pattern with a known predicate reads one column pair, and patterns on one subject of one
table are one scan of that table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES
from graphloom.operators.solutions import Solutions

TYPE = PREFIXES["rdf"] + "type"


@dataclass
class Table:
    """How a table is lifted: its key column and foreign keys (column to table)."""

    key: str
    links: dict[str, str] = field(default_factory=dict)


#: The relational test schema. Order lines have no key and are not resources of their own.
TABLES = {
    "region": Table("r_regionkey"), "nation": Table("n_nationkey", {"n_regionkey": "region"}), "customer": Table("c_custkey", {"c_nationkey": "nation"}),
    "supplier": Table("s_suppkey", {"s_nationkey": "nation"}), "part": Table("p_partkey"), "orders": Table("o_orderkey", {"o_custkey": "customer"}),
    "events": Table("event_id"), "documents": Table("doc_id"), "pages": Table("page_id"), "benchmark": Table("item_id"), "embeddings": Table("vec_id"),
}


class Lifted:
    """A folder of tables as a graph."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table] = TABLES, base: str = "http://example.com"):
        self.spark, self.folder, self.tables, self.base = spark, folder, tables, base

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def resource(self, table: str) -> str:
        return f"{self.base}/{table}/"

    def predicate(self, table: str, column: str) -> str:
        return f"{self.base}/{table}#{column}"

    def star(self, table: str, subject: str, **objects: str) -> Solutions:
        """Solutions of ``subject`` with one variable for each of some columns: one scan.

        Values keep their native types; foreign keys stay raw keys of the table they point to.
        """
        spec = self.tables[table]
        df = self.read(table)
        columns = {subject: spec.key} | dict(objects)
        templates = {subject: self.resource(table)} | {v: self.resource(spec.links[c]) for v, c in objects.items() if c in spec.links}
        df = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns.values()))
        return Solutions(df.select(*[F.col(c).alias(v) for v, c in columns.items()]), templates)

    def rows(self, table: str, **columns: str) -> Solutions:
        """Solutions over a table without resources of its own, such as order lines linked to other tables.

        Keywords name variables; ``variable="column->table"`` makes it a resource of that table.
        """
        df, templates, out = self.read(table), {}, {}
        for v, c in columns.items():
            name, _, target = c.partition("->")
            out[v] = F.col(name)
            if target:
                templates[v] = self.resource(target)
        return Solutions(df.select(*[c.alias(v) for v, c in out.items()]), templates)

    def triples(self, table: str, columns: list[str] | None = None, key=None) -> DataFrame:
        """The triples of one table, or of some of its columns, or of one resource, from a single scan.

        A known ``key`` is compared as it is stored, so Parquet can skip what does not hold it.
        """
        spec, df = self.tables[table], self.read(table)
        if key is not None:
            df = df.where(F.col(spec.key) == key)
        kinds = dict(df.dtypes)
        subject = F.concat(F.lit(self.resource(table)), F.col(spec.key).cast("string"))
        cells = []
        for c in columns or [*df.columns]:
            value = F.concat(F.lit(self.resource(spec.links[c])), F.col(c).cast("string")) if c in spec.links else terms.from_native(F.col(c), kinds[c])
            cells.append(F.struct(F.lit(self.predicate(table, c)).alias("p"), value.alias("o")))
        if columns is None:
            cells.append(F.struct(F.lit(TYPE).alias("p"), F.lit(f"{self.base}/{table}").alias("o")))
        return df.where(F.col(spec.key).isNotNull()).select(subject.alias("s"), F.inline(F.array(*cells))).where("o IS NOT NULL")

    def graph(self, *tables: str) -> DataFrame:
        """The union of some tables' triples. Each branch carries literal predicates, so a bound one prunes the others."""
        out = None
        for t in tables or tuple(self.tables):
            part = self.by_column(t)
            out = part if out is None else out.unionByName(part)
        return out

    def view(self, *tables: str) -> View:
        """Some tables as a graph that hands out the branch of a known predicate alone."""
        return View(self, tables or tuple(self.tables))

    def by_column(self, table: str, only: str | None = None) -> DataFrame:
        """One branch for each column, for patterns that bind the predicate: only that column is then read.

        ``only`` keeps the branch of one predicate.
        """
        spec, df = self.tables[table], self.read(table)
        kinds, out = dict(df.dtypes), None
        subject = F.concat(F.lit(self.resource(table)), F.col(spec.key).cast("string")).alias("s")
        for c in [*df.columns, None]:
            if only is not None and only != (TYPE if c is None else self.predicate(table, c)):
                continue
            if c is None:
                value, predicate = F.lit(f"{self.base}/{table}"), TYPE
            else:
                value = F.concat(F.lit(self.resource(spec.links[c])), F.col(c).cast("string")) if c in spec.links else terms.from_native(F.col(c), kinds[c])
                predicate = self.predicate(table, c)
            # nulls go before terms are made: the scan skips them, and no filter repeats a long expression
            full = F.col(spec.key).isNotNull() if c in (None, spec.key) else F.col(spec.key).isNotNull() & F.col(c).isNotNull()
            part = df.where(full).select(subject, F.lit(predicate).alias("p"), value.alias("o"))
            out = part if out is None else out.unionByName(part)
        return out


class View:
    """Tables as a graph for patterns and search.

    A known predicate picks its branch before any plan is made, so plans stay as small as the query:
    Catalyst would prune the other branches too, but only after working through all of them.
    """

    def __init__(self, lifted: Lifted, tables: tuple[str, ...]):
        self.lifted, self.tables = lifted, tables

    def with_predicate(self, p: str) -> DataFrame:
        out = None
        for t in self.tables:
            part = self.lifted.by_column(t, p) if p == TYPE or p.startswith(f"{self.lifted.base}/{t}#") else None
            if part is not None:
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.lifted.spark.createDataFrame([], "s string, p string, o string")

    def all(self) -> DataFrame:
        return self.lifted.graph(*self.tables)
