"""How many routes lead to a target.

A route derives its target by one of the target's steps, whose inputs are derived in turn, down to sources; no
node is derived from itself on its own way. Alternatives add up and the inputs of one call multiply.

The graph of steps is condensed to its strong components. What leads into a node from outside its component can't pass
the node again, so its number is the same wherever it is used and is counted once. Within a component the nodes passed
so far matter: a state is a node with the nodes of its own component on the way to it, so where
there is no cycle a state is just a node. States are found from the targets in rounds and counted back from the sources in
rounds, as exact decimals. Inside a component there are as many states as sets of nodes that simple ways pass, which
grows quickly with a dense component's size; the condensation keeps that to components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import strong_components
from graphloom.workspace import written

STATE = ["node", "passed"]
COUNT = "decimal(38,0)"


def _states(steps: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States behind the targets, and calls: which states each step of a state asks for (``dead`` if one was passed before)."""
    none = F.array().cast("array<string>")
    front = written(targets.select("node", none.alias("passed")).distinct(), "states")
    states, calls = front, None
    while not front.isEmpty():
        made = front.join(steps, front["node"] == steps["output"]).select(*STATE, "step", "position", "input", "inside")
        here = F.array_sort(F.array_union("passed", F.array("node")))
        made = made.select(*STATE, "step", "position", "input", F.when(F.col("inside"), here).otherwise(none).alias("then"), (F.col("inside") & F.array_contains(here, F.col("input"))).alias("dead"))
        made = written(made, "calls")
        calls = made if calls is None else calls.unionByName(made)
        asked = made.where("NOT dead").select(F.col("input").alias("node"), F.col("then").alias("passed")).distinct()
        front = written(asked.join(states, STATE, "left_anti"), "states")
        states = states.unionByName(front)
    return written(states, "all-states"), calls


def route_counts(steps: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """node and routes (a decimal) of every target; ``sources`` and ``targets`` have a column node, ``steps`` is as ``routes.steps`` gives it.

    A source is derived by its value, beside its steps. A target that nothing leads to has 0 routes.
    Numbers of more than 38 digits raise an error.
    """
    parts = strong_components(steps.select(F.col("input").alias("a"), F.col("output").alias("b")))
    parts = written(parts, "parts")
    own = steps.select("output", "step", "position", "input").distinct()
    own = own.join(parts.select(F.col("node").alias("output"), F.col("component").alias("of")), "output", "left").join(parts.select(F.col("node").alias("input"), F.col("component").alias("from")), "input", "left")
    # a step from a node to itself is dead wherever it is met
    inside = F.coalesce(F.col("of") == F.col("from"), F.lit(False)) | (F.col("input") == F.col("output"))
    own = written(own.select("output", "step", "position", "input", inside.alias("inside")), "steps")
    states, calls = _states(own, targets)
    alive = calls.join(calls.where("dead").select(*STATE, "step").distinct(), [*STATE, "step"], "left_anti").select(*STATE, "step", "position", "input", "then")
    alive = written(alive, "alive-calls")
    # written, so that joins know its size
    given = written(sources.select("node", F.lit(1).cast(COUNT).alias("given")).distinct(), "given")
    base = written(states.join(given, "node", "left").select(*STATE, F.coalesce("given", F.lit(0).cast(COUNT)).alias("given")), "bases")
    front = written(base.join(alive.select(*STATE).distinct(), STATE, "left_anti").withColumnRenamed("given", "routes"), "counted")
    known = front
    times = lambda a, x: (a * x).cast(COUNT)
    while not front.isEmpty():
        open_calls = alive.join(known, STATE, "left_anti")
        asked = known.select(F.col("node").alias("input"), F.col("passed").alias("then"), "routes")
        by_call = open_calls.join(asked, ["input", "then"], "left").groupBy(*STATE, "step").agg(F.count(F.lit(1)).alias("n"), F.count("routes").alias("have"), F.collect_list("routes").alias("all"))
        by_call = by_call.select(*STATE, (F.col("n") == F.col("have")).alias("full"), F.aggregate("all", F.lit(1).cast(COUNT), times).alias("ways"))
        ready = by_call.groupBy(*STATE).agg(F.bool_and("full").alias("full"), F.sum("ways").cast(COUNT).alias("ways")).where("full")
        front = written(ready.join(base, STATE).select(*STATE, (F.col("ways") + F.col("given")).cast(COUNT).alias("routes")), "counted")
        known = known.unionByName(front)
    return known.where(F.size("passed") == 0).join(targets.select("node").distinct(), "node", "left_semi").select("node", "routes")
