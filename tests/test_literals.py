import itertools
import random

from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators import routes
from graphloom.operators.solutions import Solutions
from graphloom.operators.store import TripleStore
from graphloom.sources import ntriples

TEXTS = ["", "plain", 'a "quoted" b', "back\\slash", "\\", "\\\\n", "tab\tline\nreturn\r", "nul\x00 and \\ both", "ends with \\", '"', "é😀", "x" * 5000, 'long "\\\n' * 200_000, "^^<not a type>", "a@en"]


def test_lexical_forms_survive(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for kind, lang in ((None, None), (terms.XSD + "string", None), (None, "en-GB")):
        o = terms.literal(F.col("t"), kind, lang)
        for r in rows.select("t", terms.lexical(o).alias("l"), terms.datatype(o).alias("d"), terms.language(o).alias("g"), terms.parse_object(o).alias("p"), o.alias("o")).collect():
            assert (r.l, r.d, r.g) == (r.t, kind, lang and lang.lower())
            assert r.p == r.o


def test_ntriples_round_trip_of_long_literals(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(F.lit("http://x/s").alias("s"), F.lit("http://x/p").alias("p"), terms.literal(F.col("t")).alias("o"))
    back = ntriples.parse(ntriples.lines(rows))
    assert {r.o for r in back.collect()} == {r.o for r in rows.collect()}


def agree(x, y):
    return all(x[k] is None or y[k] is None or x[k] == y[k] for k in x.keys() & y.keys())


def key(rows, names):
    return sorted((tuple(r.get(n) for n in names) for r in rows), key=repr)


def test_joins_on_maybe_unbound_variables_match_all_pairs(spark):
    rnd = random.Random(3)
    left = [{"a": rnd.randrange(4), "b": rnd.choice([None, 0, 1, 2]), "c": rnd.choice([None, 0, 1])} for _ in range(40)]
    right = [{"b": rnd.choice([None, 0, 1, 2]), "c": rnd.choice([None, 0, 1]), "d": i} for i in range(25)]
    x = Solutions(spark.createDataFrame([tuple(r.values()) for r in left], "a int, b int, c int"), maybe={"b", "c"})
    y = Solutions(spark.createDataFrame([tuple(r.values()) for r in right], "b int, c int, d int"), maybe={"b", "c"})
    merge = lambda r, s: {k: r.get(k) if r.get(k) is not None else s.get(k) for k in "abcd"}
    pairs = [merge(r, s) for r, s in itertools.product(left, right) if agree(r, s)]
    alone = [r | {"d": None} for r in left if not any(agree(r, s) for s in right)]
    got = lambda s: sorted((tuple(r) for r in s.select(*[v for v in "abcd" if v in s.variables]).collect()), key=repr)
    assert got(x.join(y)) == key(pairs, "abcd")
    assert got(x.optional(y)) == key(pairs + alone, "abcd")
    far = [merge(r, s) for r, s in itertools.product(left, right) if agree(r, s) and s["d"] > 20]
    assert got(x.optional(y, F.col("d") > 20)) == key(far + [r | {"d": None} for r in left if not any(agree(r, s) and s["d"] > 20 for s in right)], "abcd")
    assert got(x.exists(y)) == key([r for r in left if any(agree(r, s) for s in right)], "abc")
    assert got(x.not_exists(y)) == key([r for r in left if not any(agree(r, s) for s in right)], "abc")
    shared = lambda r, s: agree(r, s) and any(r[k] is not None and s[k] is not None for k in "bc")
    assert got(x.minus(y)) == key([r for r in left if not any(shared(r, s) for s in right)], "abc")
    plan = x.join(y).df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_equal_solutions_have_blank_nodes_of_their_own(spark):
    rows = Solutions(spark.createDataFrame([("x",), ("x",), ("y",)], "v string"))
    assert rows.construct(("_:n", "http://p", "?v")).count() == 3


def test_lists_long_shared_and_cyclic(spark):
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    cells = [(f"_:c{i}", rdf + "rest", f"_:c{i + 1}" if i < 99 else rdf + "nil") for i in range(100)] + [(f"_:c{i}", rdf + "first", f'"{i}"') for i in range(100)]
    cells += [("_:h", rdf + "rest", "_:c40"), ("_:h", rdf + "first", '"h"'), ("_:r0", rdf + "rest", "_:r1"), ("_:r1", rdf + "rest", "_:r0"), ("_:r0", rdf + "first", '"a"'), ("_:r1", rdf + "first", '"b"')]
    g = TripleStore(spark, spark.createDataFrame(cells, "s string, p string, o string"))
    heads = spark.createDataFrame([("_:c0",), ("_:h",), ("_:r1",), ("_:none",)], "s string")
    got = {}
    for r in sorted(g.list_items(heads).collect(), key=lambda r: (r.head, r.position)):
        got.setdefault(r.head, []).append((r.position, r.item))
    assert got["_:c0"] == [(i, f'"{i}"') for i in range(100)]
    assert got["_:h"] == [(0, '"h"')] + [(i - 39, f'"{i}"') for i in range(40, 100)]
    assert got["_:r1"] == [(0, '"b"'), (1, '"a"')] and "_:none" not in got


def test_routes_over_a_loop_are_replaced_by_the_next(spark):
    # X has k cheap routes over Y and one that is dearer; Y's route over X must use that one
    k = 3
    edges = [("V", "Y")] + [("Y", f"a{i}") for i in range(k)] + [(f"a{i}", "X") for i in range(k)] + [("S", "b1"), ("b1", "b2"), ("b2", "b3"), ("b3", "X")]
    triples = spark.createDataFrame([(a, routes.MAPS_TO, b) for a, b in edges], "s string, p string, o string")
    sources = spark.createDataFrame([("V", 0.0), ("S", 0.0)], "node string, cost double")
    targets = spark.createDataFrame([("Y",)], "node string")
    graph = {}
    for a, b in edges:
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)

    def walk(node, seen):
        if node in "VS":
            yield 0.0
        for n in graph[node] - seen:
            for c in walk(n, seen | {n}):
                yield c + 2.0

    want = sorted(walk("Y", {"Y"}))[: k]
    got = [r.cost for r in routes.cheapest(routes.steps(triples), sources, targets, k=k).orderBy("rank").collect()]
    assert got == want and len(got) == k
