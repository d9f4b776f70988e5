import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>, own int, x string"


def brute(rows, k=16, rounds=3, components=64, seed=1):
    kept = [(i, [math.floor(64 * v) for v in e]) for i, e in rows if e is not None and len(e) == components and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, one, strict=True)), i) for i, one in enumerate(c))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            some = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if some:
                c[j] = [sum(v) // len(some) for v in zip(*some, strict=True)]
    found = [(i, *near(x)) for i, x in kept]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), sha[o]) for i, d, o in found), key=repr)


def result(df, **kw):
    return sorted((tuple(r) for r in cl.report(df, **kw).collect()), key=repr)


def vectors(n, components=64, centres=5, seed=3, size=1.0):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, size) for _ in range(components)] for _ in range(centres)]
    return [(i, [float(np.float32(v + rnd.gauss(0, size / 2))) for v in rnd.choice(middle)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert result(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("k,rounds,components", [(16, 3, 64), (40, 6, 3), (1, 2, 2), (2, 4, 1), (9, 0, 4)])
def test_brute_force(spark, k, rounds, components):
    rows = vectors(400, components)
    assert result(table(spark, rows), k=k, rounds=rounds, components=components) == brute(rows, k, rounds, components)


def test_odd_rows_ties_and_large_components(spark):
    rows = vectors(60, 2) + [(None, [0.5, 0.5]), (None, [9.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (100, None), (101, [1.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 0.0]), (105, []), (106, [-0.001, -0.0])]
    rows += [(200 + i, [0.0, 0.0]) for i in range(30)] + [(300 + i, [float(1 << 20), -float(1 << 20) + i]) for i in range(5)]
    for k in (4, 200):
        assert result(table(spark, rows), k=k, components=2) == brute(rows, k, 3, 2)
    assert result(table(spark, [])) == []
    with pytest.raises(Exception, match="too large"):
        result(table(spark, [(1, [1e30, 0.0])]), components=2)


def test_bounds_save_measuring_and_never_change_it():
    rnd = np.random.default_rng(4)
    x = rnd.integers(-400, 400, (3000, 8))
    c = x[:40].copy()
    own = cl.Bounds(len(x), 10)
    own.scan(x, c, np.arange(len(x)))
    for turn in range(8):
        d = cl._squared(x, c)
        assert (own.own == d.argmin(1)).all()
        assert (own.upper * (1 + 1e-9) + 1e-9 >= np.sqrt(d[np.arange(len(x)), own.own])).all()
        new = np.stack([x[own.own == j].sum(0) // max(1, (own.own == j).sum()) if (own.own == j).any() else c[j] for j in range(len(c))])
        drift, c = np.sqrt(((new - c) ** 2).sum(1)), new
        own.moved(drift)
        own.keep_tracked(10 - turn)
        own.settle(x, c)
    assert (own.depth == 0).mean() > 0.3 and (own.depth > own.lowers.shape[1]).mean() < 0.5


def test_distances_of_any_size():
    x, c = np.array([[(1 << 27) - 1] * 64, [5] * 64]), np.array([[-(1 << 27) + 1] * 64, [3] * 64])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert cl._squared(x, c).tolist() == want and cl._measured(x, c, np.array([[0, 1], [0, 1]])).tolist() == want
