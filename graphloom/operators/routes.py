"""Mapping routes: cheapest ways to derive a target from sources.

A node is derived by mapping, instance or subclass steps from one other node, or by a function from
all of its inputs together. Costs add up. The search is a fixed point over DataFrames: every round
makes the routes of those nodes anew that have an input whose routes changed; it ends when no list changes. A route is
dropped only if ``k`` cheaper ones of its node pass no other nodes than it does, since each of those can
then stand in for it wherever it could be used; so the ``k`` cheapest routes of a target are never lost.
Only nodes behind the targets take part, steps that can only lead back to their own inputs are taken out
first, and of the nodes that a route passes only those count that may lie on a cycle: no other can be met
twice. In a graph without cycles each node thus keeps ``k`` routes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES
from graphloom.workspace import written

#: Default costs of steps.
COSTS = {"function": 10.0, "mapsTo": 2.0, "instanceOf": 1.0, "subClassOf": 1.0, "value": 0.0}
MAPS_TO = PREFIXES["map"] + "mapsTo"
HAS_COST = PREFIXES["map"] + "hasCost"

STEPS = "output string, step string, kind string, input string, position int, cost double"


def steps(triples: DataFrame, maps_to: str = MAPS_TO, instance_of: str | None = None, sub_class: str = PREFIXES["rdfs"] + "subClassOf", functions: DataFrame | None = None, costs: dict[str, float] = COSTS) -> DataFrame:
    """Steps (output, step, kind, input, position, cost) from the triples, and from function descriptions.

    ``functions`` has columns function, inputs (array), output and cost (nullable). Mapping edges work both
    ways; a class is derived from its subclasses, an instance lends its value to its class.
    """
    def edges(p: str, kind: str, inverse: bool):
        a, b = ("s", "o") if inverse else ("o", "s")
        rows = triples.where((F.col("p") == p) & ~F.col("o").startswith('"')).select(F.col(a).alias("output"), F.col(b).alias("input"))
        return rows.select("output", F.concat_ws(" ", F.lit(kind), "input").alias("step"), F.lit(kind).alias("kind"), "input", F.lit(0).alias("position"), F.lit(costs[kind]).alias("cost"))

    out = edges(maps_to, "mapsTo", False).unionByName(edges(maps_to, "mapsTo", True)).unionByName(edges(sub_class, "subClassOf", False))
    if instance_of:
        out = out.unionByName(edges(instance_of, "instanceOf", False))
    if functions is not None:
        calls = functions.select(F.col("output"), F.concat_ws(" ", F.lit("function"), "function").alias("step"), F.lit("function").alias("kind"), F.posexplode("inputs").alias("position", "input"), F.coalesce("cost", F.lit(costs["function"])).alias("cost"))
        out = out.unionByName(calls)
    given = triples.where(F.col("p") == HAS_COST).select(F.col("s").alias("input"), terms.number(F.col("o")).alias("own"))
    out = out.join(given, "input", "left").select("output", "step", "kind", "input", "position", F.when(F.col("kind") == "mapsTo", F.coalesce("own", "cost")).otherwise(F.col("cost")).alias("cost"))
    return out.distinct()


def functions_of(triples: DataFrame, has_input: str = PREFIXES["emmo"] + "hasInput", has_output: str = PREFIXES["emmo"] + "hasOutput") -> DataFrame:
    """function, inputs, output and cost described by input and output predicates (inputs in IRI order)."""
    ins = triples.where(F.col("p") == has_input).groupBy(F.col("s").alias("function")).agg(F.array_sort(F.collect_set("o")).alias("inputs"))
    outs = triples.where(F.col("p") == has_output).select(F.col("s").alias("function"), F.col("o").alias("output"))
    cost = triples.where(F.col("p") == HAS_COST).groupBy(F.col("s").alias("function")).agg(F.min(terms.number(F.col("o"))).alias("cost"))
    return outs.join(ins, "function").join(cost, "function", "left").select("function", "inputs", "output", "cost")


def cheapest(steps_: DataFrame, sources: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """target, rank, cost and route of the ``k`` cheapest routes to each target.

    ``sources`` has node and cost (the cost of its value), ``targets`` node. ``route`` lists steps from
    the target back, a node that is used twice being derived twice. Routes that pass a node on their own
    way are left out.
    """
    steps_ = written(steps_, "steps")
    own = _useful(steps_.join(_behind(steps_, targets), "output", "left_semi"), targets)
    cyclic = written(_cyclic(own), "cycles").withColumn("cyclic", F.lit(True))
    alike = cyclic.isEmpty()
    own = own.withColumn("last", F.max("position").over(Window.partitionBy("output", "step")))
    own = written(own.join(cyclic.withColumnRenamed("node", "output"), "output", "left"), "steps")
    passed = lambda name: F.when(F.col("cyclic"), F.array(name)).otherwise(F.array().cast("array<string>"))
    # the cheapest route stays the first however often it is there
    once = lambda df: df if alike and k == 1 else df.dropDuplicates(["node", "route"])
    widest = own.agg(F.max("position")).first()[0] or 0
    base = sources.join(cyclic, "node", "left").select("node", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.array(F.concat_ws(" ", F.lit("value"), "node")).alias("route"), passed("node").alias("nodes"))
    best = written(_top(once(base), ["node"], k, alike), "routes")
    base, fresh = best, best.select("node").distinct()
    while True:
        due = written(own.join(fresh, own["input"] == fresh["node"], "left_semi").select("output").distinct(), "due")
        if due.isEmpty():
            break
        mine, nodes = own.join(due, "output", "left_semi"), due.withColumnRenamed("output", "node")
        grown = base.join(nodes, "node", "left_semi")
        partial = mine.where("position = 0").join(best.withColumnsRenamed({"cost": "c", "node": "input"}), "input").where(~F.array_contains("nodes", F.col("output")))
        partial = partial.select("output", "step", "last", (F.col("cost") + F.col("c")).alias("cost"), F.concat(F.array("step"), "route").alias("route"), F.array_sort(F.array_union(passed("output"), "nodes")).alias("nodes"))
        for position in range(widest + 1):
            if position:
                more = mine.where(F.col("position") == position).select("output", "step", "input")
                partial = partial.where(F.col("last") >= position).join(more, ["output", "step"]).join(best.select(F.col("node").alias("input"), F.col("cost").alias("c"), F.col("route").alias("r"), F.col("nodes").alias("n")), "input")
                partial = partial.where(~F.array_contains("n", F.col("output"))).select("output", "step", "last", (F.col("cost") + F.col("c")).alias("cost"), F.concat("route", "r").alias("route"), F.array_sort(F.array_union("nodes", "n")).alias("nodes"))
                partial = _top(partial, ["output", "step", "last"], k, alike)
            done = partial.where(F.col("last") == position).select(F.col("output").alias("node"), "cost", "route", "nodes")
            grown = grown.unionByName(done)
        made = written(_top(once(grown), ["node"], k, alike), "made")
        fresh = written(_differing(made, best.join(nodes, "node", "left_semi")), "fresh")
        best = written(best.join(nodes, "node", "left_anti").unionByName(made), "routes")
    ranked = best.join(targets.select("node").distinct(), "node").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("cost", "route")))
    return ranked.where(F.col("rank") <= k).select(F.col("node").alias("target"), "rank", "cost", "route")


def _behind(steps_: DataFrame, targets: DataFrame) -> DataFrame:
    """The nodes (output) that some target is derived from, and the targets; nodes alone, not pairs with each target."""
    front = written(targets.select(F.col("node").alias("output")).where("output IS NOT NULL").distinct(), "behind")
    known, turn = front, 0
    while not front.isEmpty():
        turn += 1
        step = steps_.join(front, "output", "left_semi").select(F.col("input").alias("output")).where("output IS NOT NULL").distinct()
        front = written(step.join(known, "output", "left_anti"), "behind")
        known = known.unionByName(front)
        if turn % 16 == 0:
            known = written(known, "behind")
    return known


def _differing(now: DataFrame, before: DataFrame) -> DataFrame:
    """The nodes whose routes are not the same in both."""
    digest = lambda df, name: df.groupBy("node").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "route").cast("decimal(38,0)")).alias("h")).alias(name))
    return digest(now, "now").join(digest(before, "before"), "node", "full").where(~F.col("now").eqNullSafe(F.col("before"))).select("node")


def _useful(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Steps to a target, or to a node that some other than their own inputs is derived from."""
    aims = targets.select(F.col("node").alias("output")).distinct().withColumn("aim", F.lit(True))
    rows, before = written(rows.join(aims, "output", "left"), "steps"), None
    while (n := rows.count()) != before:
        before = n
        # a node (output) and what is derived from it (input), turned so that they meet the step back
        uses = rows.select(F.col("input").alias("output"), F.col("output").alias("input")).distinct()
        # steps to a target stay anyway
        open_ = rows.where("aim IS NULL")
        back = open_.join(uses, ["output", "input"]).groupBy("output", "step").agg(F.size(F.collect_set("input")).alias("back"))
        used = open_.where("position = 0").select("output", "step").join(uses.groupBy("output").agg(F.count(F.lit(1)).alias("uses")), "output")
        ahead = used.join(back, ["output", "step"], "left").where(F.col("uses") > F.coalesce("back", F.lit(0))).select("output", "step")
        rows = written(rows.where("aim").unionByName(open_.join(ahead, ["output", "step"], "left_semi")), "steps")
    return rows.drop("aim")


def _cyclic(rows: DataFrame) -> DataFrame:
    """The nodes that may lie on a cycle: what is left when nodes without inputs or without uses go, again and again."""
    edges, before = rows.select("input", "output").distinct(), None
    while True:
        edges = written(edges, "edges")
        if (n := edges.count()) in (0, before):
            return edges.select(F.col("output").alias("node")).distinct()
        before = n
        made, fed = edges.select(F.col("output").alias("input")), edges.select(F.col("input").alias("output"))
        edges = edges.join(made, "input", "left_semi").join(fed, "output", "left_semi")


def _top(rows: DataFrame, keys: list[str], k: int, alike: bool) -> DataFrame:
    """Rows (cost, route, nodes) without those that ``k`` cheaper ones of their key make needless; ``alike`` if all pass the same nodes."""
    # of routes over the same nodes k are enough, which is settled before any list is made
    same = Window.partitionBy(*keys, *([] if alike else ["nodes"])).orderBy("cost", "route")
    rows = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k).drop("n")
    if alike:
        return rows
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cost", "route", "nodes"))).alias("all"))
    within = lambda y, x: F.size(F.array_except(y["nodes"], x["nodes"])) == 0
    keep = lambda acc, x: F.when(F.size(F.filter(acc, lambda y: within(y, x))) < k, F.concat(acc, F.array(x))).otherwise(acc)
    return listed.select(*keys, F.inline(F.aggregate("all", F.slice("all", 1, 0), keep)))


def dot(route: list[str]) -> str:
    """Graphviz text of one route."""
    lines = [f'  "{b}" -> "{a}";' for a, b in zip(route, route[1:], strict=False)]
    return "digraph route {\n" + "\n".join(lines) + "\n}"
