import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import paths
from graphloom.operators.components import strong_components
from graphloom.operators.paths import Alternative, Repeated, Sequence, Step, negated, p
from graphloom.operators.store import TripleStore


def leaf(step, triples):
    out = []
    for s, q, o in triples:
        for names, a, b in ((step.forward, s, o), (step.backward, o, s)):
            if names is not None and (q in names) != step.negated:
                out.append((a, b))
    return out


def brute(path, triples, nodes):
    """Bags of pairs, repetitions as sets."""
    if isinstance(path, Step):
        return leaf(path, triples)
    if isinstance(path, Sequence):
        return [(a, d) for a, b in brute(path.first, triples, nodes) for c, d in brute(path.second, triples, nodes) if b == c]
    if isinstance(path, Alternative):
        return brute(path.one, triples, nodes) + brute(path.other, triples, nodes)
    inner = set(brute(path.inner, triples, nodes))
    out = {(n, n) for n in nodes} if path.zero else set()
    out |= inner
    while path.many:
        more = out | {(a, d) for a, b in out for c, d in inner if b == c}
        if more == out:
            break
        out = more
    return list(out)


def random_path(rnd, depth):
    kind = rnd.choice(["step", "seq", "alt", "rep"]) if depth else "step"
    if kind == "step":
        one = p(*rnd.sample("pqr", rnd.randrange(1, 3)))
        one = negated([rnd.choice("pqr")]) if rnd.random() < 0.15 else negated(["p"], ["q"]) if rnd.random() < 0.1 else one
        return ~one if rnd.random() < 0.4 else one
    if kind == "seq":
        return random_path(rnd, depth - 1) / random_path(rnd, depth - 1)
    if kind == "alt":
        return random_path(rnd, depth - 1) | random_path(rnd, depth - 1)
    return rnd.choice([Repeated.plus, Repeated.star, Repeated.optional])(random_path(rnd, depth - 1))


def make(spark, triples):
    return spark.createDataFrame(triples, "s string, p string, o string").coalesce(2)


@pytest.mark.parametrize("seed", range(9))
def test_random_paths_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    triples = sorted({(rnd.choice("abcde"), rnd.choice("pqr"), rnd.choice('abcde"')) for _ in range(9)})
    df, nodes = make(spark, triples), {x for s, _, o in triples for x in (s, o)}
    path = random_path(rnd, 3)
    for one in (path, ~path):
        want = brute(one, triples, nodes)
        got = sorted(tuple(r) for r in paths.pairs(df, one).collect())
        assert got == sorted(want), (seed, one)
    seeds = rnd.sample(sorted(nodes), 2)
    got = sorted(tuple(r) for r in paths.pairs(df, path, spark.createDataFrame([(x,) for x in seeds], "source string")).collect())
    assert got == sorted(x for x in brute(path, triples, nodes) if x[0] in seeds)


def test_patterns_with_paths_join_others(spark):
    g = TripleStore(spark, make(spark, [("k", "knows", "b"), ("b", "knows", "c"), ("c", "name", '"C"'), ("b", "name", '"B"'), ("c", "knows", "k")]))
    out = g.match(("?x", p("knows").plus(), "?y"), ("?y", "name", "?n")).select("x", "n")
    assert sorted(map(tuple, out.collect())) == sorted((x, n) for x in "kbc" for n in ('"B"', '"C"'))
    one = lambda *t: sorted(map(tuple, g.match(t).select().collect()))
    assert one("k", p("knows") / p("knows") / p("name"), "?n") == [('"C"',)]
    assert one("?x", p("knows") / p("name"), '"C"') == [("b",)]
    assert one("?x", p("knows").plus(), "?x") == [("b",), ("c",), ("k",)]
    assert g.match(("k", p("knows").star(), "k")).ask().first()[0] and not g.match(("k", p("name"), "k")).ask().first()[0]
    # a path that may be empty leads a term to itself, even one without triples
    assert one("nobody", p("knows").star(), "?y") == [("nobody",)]


def test_negated_sets_need_a_list():
    with pytest.raises(ValueError):
        negated()
    with pytest.raises(NotImplementedError):
        ~paths.Path()


def closure(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(25):02}", f"n{rnd.randrange(25):02}") for _ in range(rnd.choice([20, 32, 45]))]
    back = closure({e for e in edges if e[0] != e[1]})
    want = {(a, b) for a, b in back if (b, a) in back and a != b}
    got = {r.node: r.component for r in strong_components(spark.createDataFrame(edges, "a string, b string").coalesce(1)).collect()}
    assert {(a, b) for a in got for b in got if a != b and got[a] == got[b]} == want
    assert spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string").transform(strong_components).where(F.col("node").isNotNull()).count() == 0


def test_joins_that_make_many_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(paths, "CELL", 1000, raising=False)
    # one hub between many ends, one way twice, and nodes with few ends
    rows = [(f"a{i}", "in", "hub") for i in range(300)] + [("a0", "way", "hub")] + [("hub", "out", f"b{i}") for i in range(70)] + [("x", "in", "y"), ("y", "out", "z"), ("z", "out", "x")]
    df = make(spark, rows)
    path = p("in", "way") / p("out")
    want = sorted(brute(path, rows, None))
    assert len(want) == 301 * 70 + 1
    for seeds in (None, spark.createDataFrame([(s,) for s, _, _ in rows], "source string")):
        out = paths.pairs(df, path, seeds)
        assert sorted(tuple(r) for r in out.collect()) == want
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < len(want) / 2


def test_cells_are_small_enough_for_eight_million_rows(spark):
    rows = [(f"a{i}", "in", "hub") for i in range(4000)] + [("hub", "out", f"b{i}") for i in range(2000)]
    out = paths.pairs(make(spark, rows), p("in") / p("out"))
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 8_000_000 and max(tasks) < 4_000_000
