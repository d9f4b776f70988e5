"""Pattern algebra against a naive evaluator on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import closure
from graphloom.operators.solutions import match


def naive_join(a, b):
    return [x | y for x in a for y in b if all(x[k] == y[k] for k in x.keys() & y.keys())]


def naive_match(triples, patterns):
    out = [{}]
    for pattern in patterns:
        found = []
        for t in triples:
            row = {}
            if all((row.setdefault(x, v) == v) if x.startswith("?") else x == v for x, v in zip(pattern, t)):
                found.append(row)
        out = naive_join(out, found)
    return out


def bag(rows, variables):
    return sorted((tuple(r.get("?" + v) for v in variables) for r in rows), key=repr)


def spark_bag(solutions):
    variables = solutions.variables
    return sorted((tuple(r) for r in solutions.select().collect()), key=repr), variables


@pytest.fixture(scope="module")
def graphs(spark):
    rnd = random.Random(8)
    out = []
    for _ in range(3):
        triples = sorted({(f"http://n/{rnd.randrange(6)}", f"http://p/{rnd.randrange(3)}", rnd.choice([f"http://n/{rnd.randrange(6)}", f'"{rnd.randrange(3)}"'])) for _ in range(24)})
        out.append((triples, spark.createDataFrame(triples, "s string, p string, o string")))
    return out


P = ["http://p/0", "http://p/1", "http://p/2"]


def test_basic_graph_patterns(graphs):
    for triples, df in graphs:
        for patterns in ([("?a", P[0], "?b")], [("?a", P[0], "?b"), ("?b", P[1], "?c")], [("?a", P[0], "?a")], [("?a", "?p", "?b"), ("?c", P[2], "?b")], [("?a", P[0], "?b"), ("?c", P[1], "?d")]):
            got, variables = spark_bag(match(df, *patterns))
            assert got == bag(naive_match(triples, patterns), variables)


def test_optional_union_minus_and_exists(graphs):
    for triples, df in graphs:
        a, b, c = [("?a", P[0], "?b")], [("?b", P[1], "?c")], [("?a", P[2], "?c")]
        na, nb, nc = (naive_match(triples, x) for x in (a, b, c))
        sa, sb, sc = (match(df, *x) for x in (a, b, c))
        left = [x | y for x in na for y in nb if x["?b"] == y["?b"]] + [x for x in na if not any(x["?b"] == y["?b"] for y in nb)]
        got, variables = spark_bag(sa.optional(sb))
        assert got == bag(left, variables)
        # joining on a variable that may be unbound
        agree = lambda x, y: all(x[k] == y[k] for k in x.keys() & y.keys())
        got, variables = spark_bag(sa.optional(sb).join(sc))
        assert got == bag([x | y for x in left for y in nc if agree(x, y)], variables)
        got, variables = spark_bag(sa.union(sc))
        assert got == bag(na + nc, variables)
        got, variables = spark_bag(sa.union(sc).join(sb))
        assert got == bag([x | y for x in na + nc for y in nb if agree(x, y)], variables)
        got, variables = spark_bag(sa.minus(sc))
        assert got == bag([x for x in na if not any(x["?a"] == y["?a"] for y in nc)], variables)
        got, variables = spark_bag(sa.optional(sb).minus(sc))
        assert got == bag([x for x in left if not any(agree(x, y) and x.keys() & y.keys() for y in nc)], variables)
        got, variables = spark_bag(sa.exists(sc))
        assert got == bag([x for x in na if any(x["?a"] == y["?a"] for y in nc)], variables)
        got, variables = spark_bag(sa.not_exists(sb))
        assert got == bag([x for x in na if not any(x["?b"] == y["?b"] for y in nb)], variables)
        assert sa.minus(match(df, ("?x", P[2], "?y"))) is sa


def test_construct(graphs):
    triples, df = graphs[0]
    s = match(df, ("?a", P[0], "?b"))
    got = s.construct(("?b", "http://q", "?a"), ("?a", "http://r", "_:v"), ("_:v", "http://s", "?b")).collect()
    naive = naive_match(triples, [("?a", P[0], "?b")])
    assert sum(r.p == "http://q" for r in got) == sum(not x["?b"].startswith('"') for x in naive)
    assert sum(r.p == "http://r" for r in got) == len(naive) and len({r.o for r in got if r.p == "http://r"}) == len(naive)


def test_solution_modifiers(graphs):
    _, df = graphs[1]
    s = match(df, ("?a", "?p", "?b"))
    n = df.count()
    assert s.group("p", n=F.count(F.lit(1))).df.agg(F.sum("n")).first()[0] == n
    assert s.order("a", "p", "b").limit(3, offset=1).df.collect() == df.orderBy("s", "p", "o").selectExpr("s AS a", "p", "o AS b").offset(1).limit(3).collect()
    assert s.ask().first()[0] and not s.filter("false").ask().first()[0]
    with pytest.raises(ValueError):
        s.bind("a", F.lit(1))


def reachable(edges, source, include):
    depth = {source: 0} if include else {}
    frontier, d = [source], 0
    while frontier:
        d += 1
        new = {b for a, b in edges if a in frontier} - set(depth)
        depth |= {b: d for b in new}
        frontier = list(new)
    return depth


def test_closure_on_cyclic_graphs(spark):
    rnd = random.Random(2)
    for n, m in ((12, 15), (30, 60)):
        edges = sorted({(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)})
        df = spark.createDataFrame(edges, "a string, b string")
        seeds = ["n0", "n1", "absent"]
        s = spark.createDataFrame([(x,) for x in seeds], "source string")
        for include in (False, True):
            got = {(r.source, r.node): r.depth for r in closure.reach(df, s, include).collect()}
            assert got == {(x, y): d for x in seeds for y, d in reachable(edges, x, include).items()}
        nodes = {a for a, _ in edges}
        assert {tuple(r) for r in closure.path_pairs(df, "+").collect()} == {(x, y) for x in nodes for y in reachable(edges, x, False)}
        every = nodes | {b for _, b in edges}
        assert {tuple(r) for r in closure.path_pairs(df, "?").collect()} == {(x, x) for x in every} | set(edges)


def test_long_chains_end(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    got = closure.reach(df, spark.createDataFrame([(0,)], "source long"))
    assert {r.node: r.depth for r in got.collect()} == {i: i for i in range(1, 21)}
