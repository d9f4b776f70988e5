"""A store of triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES, iri
from graphloom.operators import paths, solutions
from graphloom.operators.closure import edges_of, reach
from graphloom.workspace import written

SCHEMA = "s string, p string, o string"
#: Adds after which a store is written anew, so that its plan has so many scans at most.
CHANGES = 16


class UniquenessError(ValueError):
    """More than one value where one was asked for."""


class ResourceExistsError(ValueError):
    """A resource that should be new is in the store already."""


class TripleStore:
    """Triples as a set in a DataFrame (s, p, o), with prefixes. Methods that change it return the store.

    A saved store is Parquet partitioned by predicate, so a pattern with a predicate reads that part
    alone and constants are pushed down to it.
    """

    def __init__(self, spark: SparkSession, triples: DataFrame | None = None, prefixes: dict[str, str] | None = None):
        self.spark = spark
        self.df = triples.select("s", "p", "o") if triples is not None else spark.createDataFrame([], SCHEMA)
        self.prefixes = dict(PREFIXES) | (prefixes or {})
        self._changes = 0

    # -- life ----------------------------------------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> TripleStore:
        return cls(spark, spark.read.parquet(path).select("s", "p", "o"), prefixes)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the store, each predicate in a folder of its own; a common predicate is dealt to several tasks by subject."""
        self.df.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.mode(mode).partitionBy("p").parquet(path)

    def settle(self) -> TripleStore:
        """Cut the lineage of many changes by writing the triples to the shared folder."""
        self.df, self._changes = written(self.df, "triples"), 0
        return self

    def bind(self, prefix: str, namespace: str | None) -> TripleStore:
        """Bind a prefix, or unbind it with None."""
        if namespace is None:
            self.prefixes.pop(prefix, None)
        else:
            self.prefixes[prefix] = namespace
        return self

    def term(self, value):
        """A term with its prefix expanded; columns and None pass."""
        if isinstance(value, str):
            return iri(value, self.prefixes) if not value.startswith(('"', "_:")) else value
        return value if value is None or isinstance(value, Column) else terms.term(value)

    # -- scans ---------------------------------------------------------------------------------

    def _where(self, s=None, p=None, o=None) -> Column:
        cond = F.lit(True)
        for column, value in (("s", s), ("p", p), ("o", o)):
            if value is None:
                continue
            if isinstance(value, (list, tuple, set)):
                cond = cond & F.col(column).isin([self.term(x) for x in value])
            else:
                cond = cond & (F.col(column) == self.term(value))
        return cond

    def triples(self, s=None, p=None, o=None) -> DataFrame:
        """Triples that match; each part is a term, a collection of terms, or None for any."""
        return self.df.where(self._where(s, p, o))

    def subjects(self, p=None, o=None) -> DataFrame:
        return self.triples(None, p, o).select("s")

    def predicates(self, s=None, o=None) -> DataFrame:
        return self.triples(s, None, o).select("p")

    def objects(self, s=None, p=None) -> DataFrame:
        return self.triples(s, p).select("o")

    def subject_objects(self, p=None) -> DataFrame:
        return self.triples(None, p).select("s", "o")

    def predicate_objects(self, s=None) -> DataFrame:
        return self.triples(s).select("p", "o")

    def subject_predicates(self, o=None) -> DataFrame:
        return self.triples(None, None, o).select("s", "p")

    def has(self, s=None, p=None, o=None) -> bool:
        return not self.triples(s, p, o).limit(1).isEmpty()

    def having(self, subjects: DataFrame, p=None, o=None) -> DataFrame:
        """Rows of ``subjects`` (column s) that have a matching triple: ``has`` for a whole table."""
        return subjects.join(self.triples(None, p, o).select("s"), "s", "left_semi")

    def value(self, s=None, p=None, o=None, default=None, any: bool = False, lang: str | None = None):
        """The one missing part of a triple; ``default`` if there is none, an error if there are several (unless ``any``)."""
        missing = [c for c, v in (("s", s), ("p", p), ("o", o)) if v is None]
        if len(missing) != 1:
            raise ValueError("just one part must be missing")
        found = self.triples(s, p, o).select(missing[0]).distinct()
        if lang:
            found = found.where(terms.language(F.col(missing[0])) == lang.lower())
        rows = [r[0] for r in (found.orderBy(missing[0]).limit(2) if any else found.limit(2)).collect()]
        if len(rows) > 1 and not any:
            raise UniquenessError(f"several values for {(s, p, o)}")
        return rows[0] if rows else default

    def values(self, p, lang: str | None = None, any: bool = False) -> DataFrame:
        """s and its value of a predicate, for all subjects: those with several are left out unless ``any`` (then the least)."""
        rows = self.triples(None, p)
        if lang:
            rows = rows.where(terms.language(F.col("o")) == lang.lower())
        out = rows.groupBy("s").agg(F.min("o").alias("value"), F.max("o").alias("most"))
        return (out if any else out.where("value = most")).select("s", "value")

    def match(self, *patterns: tuple) -> solutions.Solutions:
        """Solutions of a basic graph pattern; parts that start with ``?`` are variables, a predicate may be a path (whose predicates are IRIs)."""
        kept = lambda x: isinstance(x, paths.Path) or isinstance(x, str) and x.startswith("?")
        own = [tuple(x if kept(x) else self.term(x) for x in t) for t in patterns]
        plain = [t for t in own if not isinstance(t[1], paths.Path)]
        out = solutions.match(self.df, *plain) if plain else None
        for s, path, o in (t for t in own if isinstance(t[1], paths.Path)):
            more = paths.solutions(self.df, s, path, o)
            out = more if out is None else out.join(more)
        return out

    def describe(self, resources: DataFrame | str) -> DataFrame:
        """Triples of some resources (column s) and, through blank nodes, of what hangs below them."""
        seeds = self.spark.createDataFrame([(self.term(resources),)], "source string") if isinstance(resources, str) else resources.select(F.col("s").alias("source"))
        blanks = edges_of(self.df).where(F.col("b").startswith("_:"))
        nodes = reach(blanks, seeds, include_seeds=True).select(F.col("node").alias("s")).distinct()
        return self.df.join(nodes, "s", "left_semi")

    # -- changes -------------------------------------------------------------------------------

    def add(self, triples: DataFrame | list) -> TripleStore:
        """Add triples; those already there stay single.

        The store is only probed with the new rows (which are broadcast if they are few), not shuffled. Rows that are
        really new are written, so the store stays in its plan once; after ``CHANGES`` adds it is settled.
        A store that changes for long is better kept as a ``VersionedStore``.
        """
        if isinstance(triples, list):
            triples = self.spark.createDataFrame([tuple(self.term(x) for x in t) for t in triples], SCHEMA)
        new = triples.select("s", "p", "o").distinct()
        known = self.df.join(new, ["s", "p", "o"], "left_semi").distinct()
        self.df = self.df.unionByName(written(new.join(known, ["s", "p", "o"], "left_anti").select("s", "p", "o"), "added"))
        self._changes += 1
        return self.settle() if self._changes >= CHANGES else self

    def remove(self, s=None, p=None, o=None) -> TripleStore:
        """Remove matching triples; without any argument, all."""
        self.df = self.df.where(~F.coalesce(self._where(s, p, o), F.lit(False)))
        return self

    def subtract(self, triples: DataFrame) -> TripleStore:
        self.df = self.df.join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        return self

    def set(self, triples: DataFrame | list) -> TripleStore:
        """Replace all values of each (subject, predicate) of some triples."""
        if isinstance(triples, list):
            triples = self.spark.createDataFrame([tuple(self.term(x) for x in t) for t in triples], SCHEMA)
        self.df = self.df.join(triples.select("s", "p").distinct(), ["s", "p"], "left_anti").select("s", "p", "o")
        return self.add(triples)

    def update(self, where: solutions.Solutions, delete: list[tuple] = (), insert: list[tuple] = ()) -> TripleStore:
        """Delete and insert template triples of every solution, both judged on the store as it was."""
        old = written(where.shown().df, "solutions")
        where = solutions.Solutions(old)
        gone = where.construct(*delete) if delete else None
        new = where.construct(*insert) if insert else None
        if gone is not None:
            self.subtract(gone)
        return self.add(new) if new is not None else self

    def delete(self, resources: DataFrame | str, scope: str = "all") -> TripleStore:
        """Delete resources with everything reachable from them, or with ``scope="blank"`` only blank nodes below them."""
        seeds = self.spark.createDataFrame([(self.term(resources),)], "source string") if isinstance(resources, str) else resources.select(F.col("s").alias("source"))
        edges = edges_of(self.df)
        if scope == "blank":
            edges = edges.where(F.col("b").startswith("_:"))
        nodes = reach(edges, seeds, include_seeds=True).select(F.col("node").alias("s")).distinct()
        self.df = self.df.join(nodes, "s", "left_anti").select("s", "p", "o")
        return self

    # -- lists ---------------------------------------------------------------------------------

    def list_items(self, heads: DataFrame | str) -> DataFrame:
        """head, position and item of RDF lists.

        By pointer doubling: after round k a cell knows the cell 2**k further on, so a list of n cells
        takes log n rounds, each one join of the cells with themselves. Cycles end with the number of cells.
        """
        rdf = PREFIXES["rdf"]
        seeds = self.spark.createDataFrame([(self.term(heads),)], "source string") if isinstance(heads, str) else heads.select(F.col("s").alias("source"))
        ahead = self.triples(None, rdf + "rest").where(F.col("o") != rdf + "nil").select(F.col("s").alias("node"), F.col("o").alias("next")).distinct()
        jump = written(ahead, "list-cells")
        cells, step = jump.count(), 1
        out = seeds.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
        while step == 1 or (step <= cells and not jump.isEmpty()):
            both = F.array(F.struct("node", "depth"), F.struct(F.col("next").alias("node"), (F.col("depth") + step).alias("depth")))
            out = out.join(jump, "node", "left").select("source", F.inline(both)).where("node IS NOT NULL")
            jump = written(jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", F.col("far").alias("next")), "list-cells")
            step *= 2
        # a cell that a cycle reaches again keeps its first place
        out = out.groupBy("source", "node").agg(F.min("depth").alias("depth"))
        first = self.triples(None, rdf + "first").select(F.col("s").alias("node"), F.col("o").alias("item"))
        return out.join(first, "node").select(F.col("source").alias("head"), F.col("depth").alias("position"), "item")


def lists(rows: DataFrame, owner: str, order: str, item: str) -> DataFrame:
    """Triples of one RDF list for each owner: cells in ``order``, with ``item`` a column of terms."""
    from pyspark.sql import Window

    rdf = PREFIXES["rdf"]
    w = Window.partitionBy(owner).orderBy(order)
    cell = lambda n: F.concat(F.lit("_:list_"), F.md5(F.col(owner).cast("string")), F.lit("_"), n.cast("string"))
    placed = rows.select(owner, F.col(item).alias("item"), F.row_number().over(w).alias("n"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    cells = F.array(
        F.struct(cell(F.col("n")).alias("s"), F.lit(rdf + "first").alias("p"), F.col("item").alias("o")),
        F.struct(cell(F.col("n")).alias("s"), F.lit(rdf + "rest").alias("p"), F.when(F.col("last"), rdf + "nil").otherwise(cell(F.col("n") + 1)).alias("o")),
    )
    return placed.select(F.inline(cells))
