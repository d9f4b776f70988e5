import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import registry, units
from graphloom.operators import routes

RDFS = "http://www.w3.org/2000/01/rdf-schema#"


def cheapest(spark, triples, sources, targets, functions=None, k=5):
    g = spark.createDataFrame(triples or [("x", "y", "z")], "s string, p string, o string")
    s = spark.createDataFrame(sources, "node string, cost double")
    t = spark.createDataFrame([(x,) for x in targets], "node string")
    return [(r.target, r["rank"], r.cost, r.route) for r in routes.cheapest(routes.steps(g, functions=functions), s, t, k).orderBy("target", "rank").collect()]


def test_a_chain_of_mappings(spark):
    got = cheapest(spark, [("a", routes.MAPS_TO, "b"), ("b", routes.MAPS_TO, "c"), ("other", routes.MAPS_TO, "d")], [("a", None)], ["c"])
    assert got == [("c", 1, 4.0, ["mapsTo b", "mapsTo a", "value a"])]


def test_subclasses_and_alternatives(spark):
    triples = [("a", routes.MAPS_TO, "m"), ("m", routes.MAPS_TO, "t"), ("b", RDFS + "subClassOf", "t")]
    got = cheapest(spark, triples, [("a", 0.0), ("b", 5.0)], ["t", "none"])
    assert [(x[1], x[2]) for x in got] == [(1, 4.0), (2, 6.0)]
    assert "->" in routes.dot(got[0][3])


def test_functions_take_all_inputs(spark):
    add = lambda *cols: sum(cols[1:], cols[0])
    r = registry.Registry()
    r.add("f:first", lambda x: x * 2, ["B"], "C")
    r.add("f:add", add, ["A", "C"], "D", cost=3.0)
    got = cheapest(spark, [], [("A", 1.0), ("B", 0.5)], ["D"], r.described(spark))
    assert got == [("D", 1, 1.0 + 10.0 + 0.5 + 3.0, ["function f:add", "value A", "function f:first", "value B"])]
    df = spark.createDataFrame([(3.2, 0.25)], "a double, b double")
    assert df.select(r.evaluate(got[0][3], {"A": F.col("a"), "B": F.col("b")}).alias("d")).first().d == pytest.approx(3.7)


def test_top_routes_equal_enumeration(spark):
    layers = [["s0", "s1"], ["m0", "m1", "m2"], ["t"]]
    edges = [(a, b, round(1 + (i * 7 % 5) * 0.37, 2)) for i, (a, b) in enumerate([*itertools.product(layers[0], layers[1]), *itertools.product(layers[1], layers[2])])]
    rows = [(b, f"edge {a} {b}", "mapsTo", a, 0, c) for a, b, c in edges]
    s = spark.createDataFrame([("s0", 0.0), ("s1", 0.1)], "node string, cost double")
    t = spark.createDataFrame([("t",)], "node string")
    got = [r.cost for r in routes.cheapest(spark.createDataFrame(rows, routes.STEPS), s, t, 4).orderBy("rank").collect()]
    cost = {(a, b): c for a, b, c in edges}
    want = sorted(v + cost[x, m] + cost[m, "t"] for x, v in (("s0", 0.0), ("s1", 0.1)) for m in layers[1])[:4]
    assert got == pytest.approx(want)


def test_described_functions(spark):
    emmo = "https://w3id.org/emmo#"
    g = spark.createDataFrame([("f", emmo + "hasInput", "b"), ("f", emmo + "hasInput", "a"), ("f", emmo + "hasOutput", "c"), ("f", routes.HAS_COST, '"7"^^<http://www.w3.org/2001/XMLSchema#integer>')], "s string, p string, o string")
    assert [tuple(r) for r in routes.functions_of(g).collect()] == [("f", ["a", "b"], "c", 7.0)]


def test_registry_only_imports_what_is_allowed():
    r = registry.Registry(("pyspark.sql.functions",))
    r.add_from("f:abs", "pyspark.sql.functions", "abs", ["x"], "y")
    with pytest.raises(PermissionError):
        r.add_from("f:bad", "os", "system", ["x"], "y")


def test_interpolation_equals_numpy(spark):
    xs, ys = [0.0, 2.0, 4.0, 6.0, 8.0, 10.0], [0.0, 4.0, 16.0, 36.0, 64.0, 100.0]
    points = [-3.0, 0.0, 1.0, 2.0, 3.3, 9.99, 10.0, 12.5, 23.0]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    for kw in ({}, {"left": -1.0, "right": 7.0}, {"period": 12.0}):
        got = [r[0] for r in df.select(registry.interpolate(F.col("x"), xs, ys, **kw)).collect()]
        assert got == pytest.approx(np.interp(points, xs, ys, **kw).tolist())


def test_units(spark):
    u = units.table(spark)
    rows = [(100.0, "°C", "K", 373.15), (212.0, "°F", "°C", 100.0), (1.0, "Inch", "cm", 2.54), (1.0, "m", "s", None), (1.0, "m", "nope", None), (None, "m", "cm", None), (36.0, "km", "Metre", 36000.0)]
    df = spark.createDataFrame([r[:3] for r in rows], "v double, a string, b string")
    got = [r.converted for r in units.convert(df, u, "v", "a", "b").collect()]
    assert got == [pytest.approx(r[3]) if r[3] is not None else None for r in rows]
    dims = spark.createDataFrame([("T-2 L+1 M+1 I0 Θ0 N0 J0",), ("T0 L0 M0 I0 Θ0 N0 J0",), ("T1",)], "d string")
    assert [r[0] for r in dims.select(units.base_expression(units.parse_dimension(F.col("d")))).collect()] == ["Second**-2 * Metre * Kilogram", "1", None]
    sizes = spark.createDataFrame([(0.05, [0, 1, 0, 0, 0, 0, 0]), (5000.0, [0, 1, 0, 0, 0, 0, 0]), (300.0, [1, 0, 0, 0, 0, 0, 0])], "m double, d array<int>")
    assert [r.unit for r in units.simplest(sizes, u, "m", "d").orderBy("m").collect()] == ["Centimetre", "Minute", "Kilometre"]
    assert spark.createDataFrame([("2.5e1 m/s",)], "q string").select(units.parse_quantity(F.col("q"))).first()[0].asDict() == {"magnitude": 25.0, "unit": "m/s"}


def test_streams(spark, tmp_path):
    from graphloom.operators.store import TripleStore
    from graphloom.streaming import triples

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<http://a> <http://p> "1" .\n<http://a> <http://p> "1" .\nnot a statement\n')
    stream = triples.as_set(triples.read_lines(spark, str(tmp_path / "in")))
    triples.append_to_store(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    (tmp_path / "in" / "b.nt").write_text('<http://b> <http://q> _:x .\n')
    triples.append_to_store(triples.as_set(triples.read_lines(spark, str(tmp_path / "in"))), str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(tuple(r) for r in TripleStore.load(spark, str(tmp_path / "store")).df.collect()) == [("http://a", "http://p", '"1"'), ("http://b", "http://q", "_:x")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    lifted = triples.lift_events(events)
    assert lifted.count() == events.count() * (len(events.columns) - 1)
    assert triples.windowed_counts(lifted).agg(F.sum("n")).first()[0] == lifted.count()


def test_two_way_edges_with_leaves_equal_enumeration(spark):
    links = [("t", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), *[("b", f"leaf{i}") for i in range(6)], *[("a", f"twig{i}") for i in range(3)]]
    into = {}
    for x, y in links:
        into.setdefault(x, []).append(y)
        into.setdefault(y, []).append(x)
    own = {"leaf0": 3.0, "leaf1": 0.5, "leaf2": 0.25, "leaf3": 7.0, "twig0": 4.25, "twig2": 4.5, "c": 3.75}

    def ways(node, seen):
        found = [own[node]] if node in own else []
        for other in into[node]:
            if other not in seen:
                found += [2.0 + cost for cost in ways(other, seen | {other})]
        return found

    got = cheapest(spark, [(x, routes.MAPS_TO, y) for x, y in links], list(own.items()), ["t", "leaf0"], k=5)
    for target in ("t", "leaf0"):
        assert [cost for name, _, cost, _ in got if name == target] == sorted(ways(target, {target}))[:5]


def test_rounds_make_only_what_has_new_inputs(spark, monkeypatch):
    made, top = [], routes._top

    def counted(rows, *args):
        out = top(rows, *args)
        made.append(out.count())
        return out

    monkeypatch.setattr(routes, "_top", counted)
    # a chain of functions: each round settles one node more
    calls = spark.createDataFrame([(f"f{i}", [f"n{i}"], f"n{i + 1}", 1.0) for i in range(5)], "function string, inputs array<string>, output string, cost double")
    got = cheapest(spark, [], [("n0", 0.5)], ["n5"], calls)
    assert got == [("n5", 1, 5.5, [*[f"function f{i}" for i in range(4, -1, -1)], "value n0"])]
    assert sum(made) == 6
