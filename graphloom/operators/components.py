"""Strongly connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import written


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that may lie on a cycle: nodes without an edge in or out go, again and again."""
    edges, before = written(edges, "edges"), None
    while True:
        n = edges.count()
        if n in (0, before):
            return edges
        before = n
        kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges = written(kept.select("a", "b"), "edges")


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (one of its nodes) of all nodes that lie on a cycle of edges (a, b); loops at one node don't count.

    Every node takes the greatest label among the nodes that lead to it; whoever leads back to the node that
    a label comes from is in its component. Components found leave, and edges between labels too, since no component crosses
    them. Each step is a join that is written, so nothing is collected and a lost executor costs one step.
    """
    rest, out = trimmed(edges.select("a", "b").where("a <> b").distinct()), None
    while not rest.isEmpty():
        labels = written(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
        while True:
            heard = rest.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("label").alias("heard"))
            moved = labels.join(heard, "node", "left").select("node", F.greatest("label", F.coalesce("heard", "label")).alias("label"), (F.coalesce("heard", "label") > F.col("label")).alias("moved"))
            moved = written(moved, "labels")
            labels = moved.select("node", "label")
            if moved.where("moved").isEmpty():
                break
        within = rest.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b").where("la = lb")
        within = written(within.select("a", "b", F.col("la").alias("label")), "within")
        # back from the node that gave its name
        front = written(labels.where("node = label").select("node", F.col("label").alias("component")), "members")
        members = front
        while not front.isEmpty():
            step = front.join(within, (F.col("node") == F.col("b")) & (F.col("component") == F.col("label"))).select(F.col("a").alias("node"), "component").distinct()
            front = written(step.join(members, "node", "left_anti"), "members")
            members = members.unionByName(front)
        members = written(members, "components")
        alone = members.groupBy("component").count().where("count = 1").select("component")
        found = members.join(alone, "component", "left_anti").select("node", "component")
        out = found if out is None else out.unionByName(found)
        gone = members.select("node")
        rest = trimmed(within.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    return out if out is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
