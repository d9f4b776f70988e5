import random
from collections import defaultdict

import pytest

from graphloom.operators.route_counts import route_counts


def brute(steps, sources, target):
    calls = defaultdict(lambda: defaultdict(list))
    for output, step, _, given, _, _ in steps:
        calls[output][step].append(given)

    def count(node, passed):
        total = int(node in sources)
        for inputs in calls[node].values():
            ways = 1
            for x in inputs:
                ways *= 0 if x in passed or x == node else count(x, passed | {node})
            total += ways
        return total

    return count(target, frozenset())


def checked(spark, steps, sources, targets):
    df = spark.createDataFrame(steps, "output string, step string, kind string, input string, position int, cost double").coalesce(1)
    one = lambda names: spark.createDataFrame([(n,) for n in names], "node string").coalesce(1)
    got = {r.node: int(r.routes) for r in route_counts(df, one(sources), one(targets)).collect()}
    assert got == {t: brute(steps, set(sources), t) for t in targets}
    return got


def mapping(a, b):
    return (b, f"mapsTo {a}", "mapsTo", a, 0, 2.0)


def test_two_way_mappings_count_routes_not_walks(spark):
    both = [mapping("a", "b"), mapping("b", "a"), mapping("b", "c"), mapping("c", "b")]
    assert checked(spark, both, ["a"], ["a", "b", "c"]) == {"a": 1, "b": 1, "c": 1}


@pytest.mark.parametrize("seed", range(5))
def test_random_graphs_with_cycles_and_functions(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    steps = []
    for _ in range(rnd.randrange(5, 11)):
        a, b = rnd.sample(names, 2)
        steps += [mapping(a, b)] + ([mapping(b, a)] if rnd.random() < 0.6 else [])
    for k in range(3):
        output = rnd.choice(names)
        steps += [(output, f"function f{k}", "function", rnd.choice(names), i, 10.0) for i in range(rnd.randrange(1, 4))]
    checked(spark, sorted(set(steps)), rnd.sample(names, 3), rnd.sample(names, 5) + ["unknown"])


def test_numbers_beyond_doubles_are_exact(spark):
    # 3 alternatives at each of 40 steps, and one more at the end: 3**40 + 1 needs 64 bits
    steps = [(f"n{i + 1}", f"mapsTo n{i} {k}", "mapsTo", f"n{i}", 0, 1.0) for i in range(20) for k in range(9)]
    steps += [("n20", "mapsTo other", "mapsTo", "other", 0, 1.0)]
    df = spark.createDataFrame(steps, "output string, step string, kind string, input string, position int, cost double").coalesce(1)
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    assert int(route_counts(df, one("n0", "other"), one("n20")).first().routes) == 3**40 + 1
