"""Property paths: sequence, alternative, inverse, negated sets and repetition of any path.

A path is an expression of Python objects: ``p("knows") / p("name")``, ``p("a") | ~p("b")``, ``p("a").plus()``, ``.star()``,
``.optional()``, ``negated(["a"], ["b"])``. Sequences and alternatives are joins and unions with the multiplicity that
SPARQL gives them. A repetition is a set: its path becomes an automaton whose states are the path's
predicates, and the closure runs over (node, state) pairs, so ``(a / b | ~c)+`` is one frontier loop over the
triples instead of a closure over pairs that were joined for all nodes first. What is bound is pushed through: the
ends of a sequence's first part are the starts of the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.solutions import Solutions
from graphloom.workspace import written


class Path:
    def __truediv__(self, other: Path) -> Path:
        return Sequence(self, other)

    def __or__(self, other: Path) -> Path:
        return Alternative(self, other)

    def __invert__(self) -> Path:
        raise NotImplementedError

    def plus(self) -> Path:
        return Repeated(self, False, True)

    def star(self) -> Path:
        return Repeated(self, True, True)

    def optional(self) -> Path:
        return Repeated(self, True, False)


@dataclass(frozen=True)
class Step(Path):
    """Edges from subject to object with a predicate in ``forward`` (not in it if ``negated``), and back for ``backward``; None for no edges."""

    forward: tuple[str, ...] | None
    backward: tuple[str, ...] | None = None
    negated: bool = False

    def __invert__(self) -> Path:
        return Step(self.backward, self.forward, self.negated)

    def cells(self, leaf: int):
        """Structs (leaf, a, b) of a triple, NULL where it is no edge."""
        for names, a, b in ((self.forward, "s", "o"), (self.backward, "o", "s")):
            if names is not None:
                among = F.col("p").isin(list(names)) if names else F.lit(False)
                yield F.when(~among if self.negated else among, F.struct(F.lit(leaf).alias("leaf"), F.col(a).alias("a"), F.col(b).alias("b")))

    def predicates(self) -> list[str] | None:
        """The predicates that matter, or None if it may be any."""
        return None if self.negated else [*(self.forward or ()), *(self.backward or ())]


@dataclass(frozen=True)
class Sequence(Path):
    first: Path
    second: Path

    def __invert__(self) -> Path:
        return Sequence(~self.second, ~self.first)


@dataclass(frozen=True)
class Alternative(Path):
    one: Path
    other: Path

    def __invert__(self) -> Path:
        return Alternative(~self.one, ~self.other)


@dataclass(frozen=True)
class Repeated(Path):
    inner: Path
    zero: bool
    many: bool

    def __invert__(self) -> Path:
        return Repeated(~self.inner, self.zero, self.many)


def p(*predicates: str) -> Path:
    """A step along one of some predicates."""
    return Step(predicates)


def negated(forward: list[str] | None = None, backward: list[str] | None = None) -> Path:
    """A step along any predicate but some; with ``backward`` also against all but those, and only so without ``forward``."""
    if forward is None and backward is None:
        raise ValueError("a negated set needs a list")
    return Step(None if forward is None else tuple(forward), None if backward is None else tuple(backward), True)


# -- automata ------------------------------------------------------------------------------------


class Automaton:
    """States are a path's steps in reading order, numbered from 1; 0 is where it starts."""

    def __init__(self, path: Path):
        self.leaves: list[Step] = []
        self.moves: set[tuple[int, int]] = set()
        empty, first, last = self._of(path)
        self.moves |= {(0, x) for x in first}
        self.final = last | ({0} if empty else set())

    def _of(self, path: Path) -> tuple[bool, set[int], set[int]]:
        """Whether the path may be empty, the steps that it may start with and end with; notes which may follow which."""
        if isinstance(path, Step):
            self.leaves.append(path)
            own = {len(self.leaves)}
            return False, own, own
        if isinstance(path, Sequence):
            e1, f1, l1 = self._of(path.first)
            e2, f2, l2 = self._of(path.second)
            self.moves |= {(x, y) for x in l1 for y in f2}
            return e1 and e2, f1 | f2 if e1 else f1, l1 | l2 if e2 else l2
        if isinstance(path, Alternative):
            e1, f1, l1 = self._of(path.one)
            e2, f2, l2 = self._of(path.other)
            return e1 or e2, f1 | f2, l1 | l2
        empty, first, last = self._of(path.inner)
        if path.many:
            self.moves |= {(x, y) for x in last for y in first}
        return empty or path.zero, first, last

    def predicates(self) -> list[str] | None:
        lists = [leaf.predicates() for leaf in self.leaves]
        return None if None in lists else sorted({x for names in lists for x in names})


def _nodes(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("source")).distinct()


def _closure(triples: DataFrame, path: Path, seeds: DataFrame | None) -> DataFrame:
    """Distinct source and node of a path by its automaton; without seeds every node of the triples is one."""
    machine = Automaton(path)
    names = machine.predicates()
    used = triples if names is None else triples.where(F.col("p").isin(names))
    cells = F.filter(F.array(*[c for i, leaf in enumerate(machine.leaves, 1) for c in leaf.cells(i)]), lambda x: x.isNotNull())
    edges = written(used.select(F.inline(cells)).distinct(), "path-edges")
    moves = triples.sparkSession.createDataFrame(sorted(machine.moves), "state int, leaf int")
    start = (_nodes(triples) if 0 in machine.final else edges.select(F.col("a").alias("source"))) if seeds is None else seeds.select("source")
    front = written(start.where("source IS NOT NULL").distinct().select("source", F.col("source").alias("node"), F.lit(0).alias("state")), "path-front")
    found, known, turn = [front], front, 0
    while True:
        turn += 1
        # a row for each pair of steps of the path
        step = front.join(F.broadcast(moves), "state").select("source", F.col("node").alias("a"), "leaf").join(edges, ["a", "leaf"])
        step = step.select("source", F.col("b").alias("node"), F.col("leaf").alias("state")).distinct()
        front = written(step.join(known, ["source", "node", "state"], "left_anti"), "path-front")
        if front.isEmpty():
            break
        found.append(front)
        known = known.unionByName(front)
        if turn % 16 == 0:
            known = written(known, "path-known")
            found = [known]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where(F.col("state").isin(sorted(machine.final))).select("source", "node").distinct()


# -- evaluation ----------------------------------------------------------------------------------

#: Rows that one cell of a join makes, about, and the most cells of a join, about; larger joins have larger cells.
CELL, CELLS = 1 << 20, 8192


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two parts of a path joined where they meet, at ``__via``.

    Small tables make very many rows where a few nodes have many ends on both sides, and Spark deals out tasks by the size
    of tables. So the rows to be made are counted first; if they are many for what they are made of, those of each node are
    dealt to the cells of a grid: a left row goes to all cells of a grid row and a right one to all of a column.
    """
    sizes = left.groupBy("__via").agg(F.count(F.lit(1)).cast("double").alias("l")).join(right.groupBy("__via").agg(F.count(F.lit(1)).cast("double").alias("r")), "__via")
    made = F.col("l") * F.col("r")
    rows, most, given = sizes.agg(F.sum(made), F.max(made), F.sum(F.col("l") + F.col("r"))).first()
    if rows is None or rows <= CELL or rows <= 8 * given and most <= 16 * CELL:
        return left.join(right, "__via")
    # cells about as wide as high, so that rows are copied least
    cells = F.ceil(made / max(CELL, rows / CELLS))
    sizes = sizes.select("__via", cells.alias("cells"), F.least(cells, F.ceil(F.sqrt(cells * F.col("l") / F.col("r")))).alias("high"))
    sizes = written(sizes.select("__via", F.col("high").cast("int").alias("high"), F.ceil(F.col("cells") / F.col("high")).cast("int").alias("wide")), "path-cells")
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(2 * rows / max(CELL, rows / CELLS)))
    cell = ["__via", "__row", "__column"]

    def dealt(df: DataFrame, own: str, size: str, along: str, copies: str) -> DataFrame:
        # by place in written files, so that equal rows are dealt too and a retried task deals alike
        df = written(df, "path-side").withColumn("__place", F.xxhash64(F.monotonically_increasing_id()))
        # few files hold the rows, which become many: one task for a file would make all its copies
        df = df.repartition(left.sparkSession.sparkContext.defaultParallelism, "__place")
        df = df.join(sizes, "__via").withColumn(own, F.pmod("__place", F.col(size)).cast("int"))
        return df.withColumn(along, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("__place", "high", "wide").repartition(tasks, *cell)

    return dealt(left, "__row", "high", "__column", "wide").join(dealt(right, "__column", "wide", "__row", "high"), cell)


def pairs(triples: DataFrame, path: Path, seeds: DataFrame | None = None) -> DataFrame:
    """source and node of every solution of a path over triples (s, p, o).

    ``seeds`` (column source) are the starts; with a path that may be empty each of them leads to itself.
    """
    if isinstance(path, Step):
        names = path.predicates()
        rows = triples if names is None else triples.where(F.col("p").isin(names))
        if seeds is not None and path.backward is None:
            rows = rows.join(seeds.select(F.col("source").alias("s")).distinct(), "s", "left_semi")
        cells = F.filter(F.array(*path.cells(0)), lambda x: x.isNotNull())
        out = rows.select(F.inline(cells)).select(F.col("a").alias("source"), F.col("b").alias("node"))
        return out if seeds is None or path.backward is None else out.join(seeds.select("source").distinct(), "source", "left_semi")
    if isinstance(path, Sequence):
        first = pairs(triples, path.first, seeds)
        middle = written(first, "path-middle") if seeds is not None or isinstance(path.second, Repeated) else first
        then = pairs(triples, path.second, middle.select(F.col("node").alias("source")).distinct())
        return _met(middle.withColumnRenamed("node", "__via"), then.withColumnRenamed("source", "__via")).select("source", "node")
    if isinstance(path, Alternative):
        return pairs(triples, path.one, seeds).unionByName(pairs(triples, path.other, seeds))
    return _closure(triples, path, seeds)


def solutions(triples: DataFrame, s: str, path: Path, o: str) -> Solutions:
    """Solutions of a pattern with a path: ``s`` and ``o`` are terms or variables (``?name``).

    A bound object turns the path round, so the closure starts from it.
    """
    spark = triples.sparkSession
    free_s, free_o = s.startswith("?"), o.startswith("?")
    if free_s and not free_o:
        out = pairs(triples, ~path, spark.createDataFrame([(o,)], "source string")).select(F.col("node").alias("source"), F.col("source").alias("node"))
    else:
        out = pairs(triples, path, None if free_s else spark.createDataFrame([(s,)], "source string"))
    if not free_o:
        out = out.where(F.col("node") == o)
    if free_s and s == o:
        return Solutions(out.where("source = node").select(F.col("source").alias(s[1:])))
    names = {"source": s[1:]} if free_s else {}
    names |= {"node": o[1:]} if free_o else {}
    return Solutions(out.select(*[F.col(c).alias(v) for c, v in names.items()]) if names else out.select(F.lit(True).alias("__match")).limit(1))
