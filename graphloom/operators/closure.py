"""Reachability and property paths.

Closure runs as a frontier loop: each round joins only newly found pairs with the edges, removes what
is already known, and writes the new frontier to the shared folder, so plans stay short and lost
executors cost one round. Rounds are bounded by the longest shortest path, and cycles end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import written


def reach(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, max_depth: int | None = None) -> DataFrame:
    """source, node and depth of everything that can be reached.

    ``edges`` has columns a and b, ``seeds`` a column source. ``depth`` is the least number of
    steps. With ``include_seeds`` every seed reaches itself in 0 steps, even if it has no edge.
    """
    edges = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    start = written(seeds.select("source").where("source IS NOT NULL").distinct(), "seeds")
    frontier = start.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"))
    found = [frontier] if include_seeds else []
    known = frontier.select("source", "node") if include_seeds else None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["a"]).select("source", F.col("b").alias("node")).distinct()
        if known is not None:
            step = step.join(known, ["source", "node"], "left_anti")
        frontier = written(step.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        found.append(frontier)
        pairs = frontier.select("source", "node")
        known = pairs if known is None else known.unionByName(pairs)
        if depth % 16 == 0:
            known = written(known, "known")
    if not found:
        return frontier.where("false")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def path_pairs(edges: DataFrame, modifier: str, seeds: DataFrame | None = None) -> DataFrame:
    """source and node of a path ``p+``, ``p*`` or ``p?`` over edges (a, b); sets, not bags.

    Without ``seeds`` every node of the edges is one.
    """
    nodes = edges.select(F.col("a").alias("source")) if modifier == "+" else edges.select(F.col("a").alias("source")).unionByName(edges.select(F.col("b").alias("source")))
    seeds = nodes.distinct() if seeds is None else seeds
    out = reach(edges, seeds, include_seeds=modifier in "*?", max_depth=1 if modifier == "?" else None)
    return out.select("source", "node")


def edges_of(triples: DataFrame, predicates: list[str] | None = None, inverse: bool = False, resources_only: bool = True) -> DataFrame:
    """Edges (a, b) of some predicates (all without a list) from subject to object, or the other way round."""
    rows = triples if predicates is None else triples.where(F.col("p").isin(predicates))
    if resources_only:
        rows = rows.where(~F.col("o").startswith('"'))
    a, b = ("o", "s") if inverse else ("s", "o")
    return rows.select(F.col(a).alias("a"), F.col(b).alias("b"))
