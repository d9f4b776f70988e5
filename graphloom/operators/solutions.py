"""Graph patterns as DataFrames.

A ``Solutions`` is a bag of rows, one column for each variable. Patterns are joined, made optional,
united, filtered and grouped with methods, each of which adds to one lazy plan; Catalyst and adaptive
execution choose how joins run. A variable may be unbound (NULL) only after ``optional`` or ``union``;
joins on such a variable follow the rule that unbound agrees with anything.

Resources of lifted tables stay raw keys until they are shown: a variable that stands for rows of a
table joins on the key, and its IRI is put together at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.workspace import written


class Solutions:
    def __init__(self, df: DataFrame, templates: dict[str, str] | None = None, maybe: set[str] | None = None):
        """``templates``: IRI prefix of variables that hold raw keys; ``maybe``: variables that may be unbound."""
        self.df, self.templates, self.maybe = df, dict(templates or {}), set(maybe or ())

    @property
    def variables(self) -> list[str]:
        return self.df.columns

    def _with(self, df: DataFrame, templates=None, maybe=None) -> Solutions:
        templates = self.templates if templates is None else templates
        maybe = self.maybe if maybe is None else maybe
        return Solutions(df, {v: t for v, t in templates.items() if v in df.columns}, {v for v in maybe if v in df.columns})

    def shown(self, *names: str) -> Solutions:
        """Raw keys of some variables (all without names) turned into IRIs."""
        names = names or tuple(self.templates)
        keyed = {v: F.concat(F.lit(self.templates[v]), F.col(v).cast("string")) for v in names if v in self.templates}
        return Solutions(self.df.withColumns(keyed), {v: t for v, t in self.templates.items() if v not in keyed}, self.maybe) if keyed else self

    def _aligned(self, other: Solutions) -> tuple[Solutions, Solutions, list[str]]:
        """Both sides with shared variables in one form."""
        both = [v for v in self.variables if v in other.variables]
        unlike = [v for v in both if self.templates.get(v) != other.templates.get(v)]
        return (self.shown(*unlike), other.shown(*unlike), both) if unlike else (self, other, both)

    # -- joins ---------------------------------------------------------------------------------

    def _joined(self, other: Solutions, how: str, on: Column | None = None) -> Solutions:
        a, b, both = self._aligned(other)
        loose = [v for v in both if v in a.maybe or v in b.maybe]
        right = b.df.withColumnsRenamed({v: f"{v}__r" for v in both})
        if not loose and on is None:
            df = a.df.join(b.df, both, how) if both else (_product(a.df, b.df) if how == "inner" else a.df.join(b.df, F.lit(True), how))
        elif how == "inner":
            df = _merged(_agreeing(a.df, right, both, loose), loose, both)
        elif how == "left":
            df = self._left(a, b, both, loose, on)
        else:
            df = _probed(a.df, right, both, loose, how == "left_semi")
        maybe = a.maybe & b.maybe if how == "inner" else a.maybe
        if how == "inner":
            maybe |= {v for v in a.maybe | b.maybe if v not in both}
        if how == "left":
            maybe |= {v for v in b.variables if v not in a.variables}
        return Solutions(df, {v: t for v, t in (a.templates | b.templates).items() if v in df.columns}, {v for v in maybe if v in df.columns})

    @staticmethod
    def _left(a: Solutions, b: Solutions, both: list[str], loose: list[str], on: Column | None) -> DataFrame:
        right = b.df.withColumnsRenamed({v: f"{v}__r" for v in both})
        if not loose:
            cond = F.lit(True)
            for v in both:
                cond = cond & (F.col(v) == F.col(f"{v}__r"))
            return a.df.join(right, cond if on is None else cond & on, "left").drop(*[f"{v}__r" for v in both])
        # solutions with partners, then those without: a row's content tells which they are
        found = _agreeing(a.df, right, both, loose)
        found = found if on is None else found.where(on)
        content = F.sha2(F.to_json(F.struct(*a.variables)), 256)
        alone = a.df.withColumn("__row", content).join(found.select(content.alias("__row")), "__row", "left_anti").drop("__row")
        return _merged(found, loose, both).unionByName(alone, allowMissingColumns=True)

    def join(self, other: Solutions) -> Solutions:
        """Solutions that agree on all shared variables; without any, every combination."""
        return self._joined(other, "inner")

    def optional(self, other: Solutions, on: Column | None = None) -> Solutions:
        """Left join; ``on`` is a filter inside the optional part and may use both sides' variables."""
        return self._joined(other, "left", on)

    def exists(self, other: Solutions) -> Solutions:
        return self._joined(other, "left_semi")._restored(self)

    def not_exists(self, other: Solutions) -> Solutions:
        return self._joined(other, "left_anti")._restored(self)

    def _restored(self, before: Solutions) -> Solutions:
        return Solutions(self.df.select(*before.variables), {v: t for v, t in before.templates.items() if v in self.templates}, before.maybe)

    def minus(self, other: Solutions) -> Solutions:
        """Without the solutions that agree with one of ``other`` on a shared bound variable."""
        a, b, both = self._aligned(other)
        if not both:
            return self
        if not any(v in a.maybe or v in b.maybe for v in both):
            return a.not_exists(Solutions(b.df.select(*both), b.templates, b.maybe))
        right = b.df.select(*[F.col(v).alias(f"{v}__r") for v in both])
        loose = [v for v in both if v in a.maybe or v in b.maybe]
        return a._with(_probed(a.df, right, both, loose, False, some=True))

    def union(self, other: Solutions) -> Solutions:
        """Bag union; variables that one side lacks are unbound there."""
        a, b, _ = self._aligned(other)
        lacking = set(a.variables) ^ set(b.variables)
        return Solutions(a.df.unionByName(b.df, allowMissingColumns=True), a.templates | b.templates, a.maybe | b.maybe | lacking)

    # -- rows ----------------------------------------------------------------------------------

    def filter(self, condition: Column | str) -> Solutions:
        """Rows whose condition is true; errors count as NULL and drop out."""
        return self._with(self.df.where(condition))

    def bind(self, name: str, value: Column) -> Solutions:
        if name in self.variables:
            raise ValueError(f"{name} is bound already")
        out = self._with(self.df.withColumn(name, value))
        return Solutions(out.df, out.templates, out.maybe | {name})

    def values(self, name: str, rows: list) -> Solutions:
        """Keep rows whose variable is one of some terms (an inline table)."""
        one = self.shown(name) if name in self.templates and rows and isinstance(rows[0], str) else self
        return one._with(one.df.where(F.col(name).isin(rows)))

    def distinct(self) -> Solutions:
        return self._with(self.df.distinct())

    def project(self, *names: str) -> Solutions:
        return self._with(self.df.select(*names))

    def order(self, *columns) -> Solutions:
        return self._with(self.df.orderBy(*columns))

    def limit(self, n: int, offset: int = 0) -> Solutions:
        return self._with(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def group(self, *names: str, **aggregates: Column) -> Solutions:
        """Group by variables; the keywords name the aggregates."""
        df = self.df.groupBy(*names).agg(*[c.alias(k) for k, c in aggregates.items()])
        return self._with(df)

    # -- results -------------------------------------------------------------------------------

    def select(self, *names: str) -> DataFrame:
        """The result with resources shown as IRIs."""
        names = names or tuple(self.variables)
        return self.project(*names).shown().df

    def ask(self) -> DataFrame:
        """One row, whether there is any solution."""
        return self.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))

    def construct(self, *template: tuple) -> DataFrame:
        """Triples of a template for every solution, as a set.

        Parts are variables (``?v``), terms, columns, or ``_:name`` for a blank node that is new
        for each solution. Triples with an unbound part or a literal subject are left out.
        """
        shown = self.shown()
        df = shown.df
        blank = any(isinstance(x, str) and x.startswith("_:") for t in template for x in t)
        if blank:
            # a solution's blank nodes are named by its content and its place among equal solutions, so a retried
            # task repeats them and each solution has its own
            content = F.sha2(F.to_json(F.struct(*df.columns)), 256)
            df = df.withColumn("__row", content).withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0))))
            df = df.withColumn("__row", F.concat_ws("_", "__row", F.col("__n").cast("string"))).drop("__n")

        def part(x) -> Column:
            if not isinstance(x, str):
                return x
            if x.startswith("?"):
                return F.col(x[1:]).cast("string")
            return F.concat(F.lit(x + "_"), F.col("__row")) if x.startswith("_:") else F.lit(x)

        rows = F.array(*[F.struct(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in template])
        out = df.select(F.inline(rows)).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        return out.where(~F.col("s").startswith('"') & ~F.col("p").startswith("_:")).distinct()


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every combination of two tables, as pattern semantics ask for where nothing is shared.

    The rows of one side are dealt to the rows of a square grid and those of the other to its columns, and each
    is copied along its row or column: an equi-join on a grid's cell, with as many cells as there are shuffle partitions and
    the root of that as copies of a row.
    """
    side = max(1, math.isqrt(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(side)).cast("int")
    along = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = a.withColumn("__row", dealt(a)).withColumn("__column", along)
    right = b.withColumn("__column", dealt(b)).withColumn("__row", along)
    return left.join(right, ["__row", "__column"]).drop("__row", "__column")


def _halves(a: DataFrame, right: DataFrame, both: list[str], loose: list[str]):
    """Parts of two sides by which of the loose variables are bound, with the variables to join on.

    Each yields (left rows, right rows, variables bound on both sides). A left row is in the parts of
    one pattern only, so a row's partners are spread over parts without overlap. Both sides are written once; only
    patterns that occur are joined, and right patterns that share the same variables with a left one go together.
    """
    strict = [v for v in both if v not in loose]

    def masked(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[int]]:
        mask = sum((F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
        df = written(df.withColumn("__mask", mask), "masked")
        # as many rows as there are patterns
        return df, sorted(r[0] for r in df.select("__mask").distinct().collect())

    left, left_masks = masked(a, loose)
    right, right_masks = masked(right, [f"{v}__r" for v in loose])
    for m in left_masks or [0]:
        for shared in sorted({m & n for n in right_masks} or {0}):
            near = right.where(F.col("__mask").bitwiseAND(F.lit(m)) == shared).drop("__mask")
            yield m, left.where(F.col("__mask") == m).drop("__mask"), near, strict + [v for i, v in enumerate(loose) if shared >> i & 1]


def _equal(keys: list[str]) -> Column:
    cond = F.lit(True)
    for v in keys:
        cond = cond & (F.col(v) == F.col(f"{v}__r"))
    return cond


def _agreeing(a: DataFrame, right: DataFrame, both: list[str], loose: list[str]) -> DataFrame:
    """Inner join where unbound agrees with anything: one equi-join for each pattern of bound variables."""
    out = None
    for _, left_rows, right_rows, keys in _halves(a, right, both, loose):
        part = left_rows.join(right_rows, _equal(keys)) if keys else _product(left_rows, right_rows)
        part = part.select(*a.columns, *right.columns)
        out = part if out is None else out.unionByName(part)
    return out


def _merged(df: DataFrame, loose: list[str], both: list[str]) -> DataFrame:
    return df.withColumns({v: F.coalesce(v, f"{v}__r") for v in loose}).drop(*[f"{v}__r" for v in both])


def _probed(a: DataFrame, right: DataFrame, both: list[str], loose: list[str], keep: bool, some: bool = False) -> DataFrame:
    """Rows with (``keep``) or without an agreeing row on the right; with ``some`` at least one variable must be bound on both sides."""
    rest, hits = {}, None
    for m, left_rows, right_rows, keys in _halves(a, right, both, loose):
        left_rows = rest.get(m, left_rows)
        if not keys and some:
            rest[m] = left_rows
            continue
        probe = right_rows.select(*[f"{v}__r" for v in keys]) if keys else right_rows.select(F.lit(True)).limit(1)
        cond = _equal(keys)
        if keep:
            found = left_rows.join(probe, cond, "left_semi")
            hits = found if hits is None else hits.unionByName(found)
        rest[m] = left_rows.join(probe, cond, "left_anti")
    if keep:
        return hits
    out = None
    for part in rest.values():
        out = part if out is None else out.unionByName(part)
    return out


def with_predicate(triples, p: str) -> DataFrame:
    """Triples of one predicate, from a DataFrame or a view that knows where they are."""
    return triples.where(F.col("p") == p) if isinstance(triples, DataFrame) else triples.with_predicate(p)


def everything(triples) -> DataFrame:
    return triples if isinstance(triples, DataFrame) else triples.all()


def pattern(triples, s: str, p: str, o: str) -> Solutions:
    """Solutions of one triple pattern: parts that start with ``?`` are variables, others are terms.

    Terms become filters on the scan (pushed to Parquet, and pruning partitions by predicate).
    """
    df, names = with_predicate(triples, p) if not p.startswith("?") else everything(triples), {}
    for column, part in (("s", s), ("p", p), ("o", o)):
        if not part.startswith("?"):
            df = df if column == "p" else df.where(F.col(column) == part)
        elif part[1:] in names:
            df = df.where(F.col(column) == F.col(names[part[1:]]))
        else:
            names[part[1:]] = column
    return Solutions(df.select(*[F.col(c).alias(v) for v, c in names.items()]) if names else df.select(F.lit(True).alias("__match")).limit(1))


def match(triples, *patterns: tuple[str, str, str]) -> Solutions:
    """Solutions of a basic graph pattern; each pattern is joined to those that share a variable with it."""
    bound = lambda t: sum(not x.startswith("?") for x in t)
    rest = sorted(patterns, key=bound, reverse=True)
    first = rest.pop(0)
    out, seen = pattern(triples, *first), {x for x in first if x.startswith("?")}
    while rest:
        # the most selective pattern that is connected; a product only where nothing is
        nxt = next((t for t in rest if seen & set(t)), rest[0])
        rest.remove(nxt)
        out, seen = out.join(pattern(triples, *nxt)), seen | {x for x in nxt if x.startswith("?")}
    return out
