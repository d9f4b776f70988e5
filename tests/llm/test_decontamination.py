import random
from collections import defaultdict

import pytest

from graphloom.llm import decontamination as dc


def words(text):
    t = (text or "").lower().translate(str.maketrans("\t\n\x0b\f\r", "     ", dc.PUNCTUATION))
    return [w for w in t.split(" ") if w]


def brute(docs, items):
    """Every diagonal of every pair, and the best stretch of each."""
    out = {}
    for d, t in docs:
        dw = words(t)
        for i, u in items:
            iw = words(u)
            n = min(len(iw), dc.STRETCH)
            # a diagonal matters only if some word agrees on it
            places = defaultdict(list)
            for q, w in enumerate(iw):
                places[w].append(q)
            for g in {p - q for p, w in enumerate(dw) for q in places.get(w, ())}:
                agree = [0 <= q + g < len(dw) and dw[q + g] == iw[q] for q in range(len(iw))]
                score = max(sum(agree[s : s + n]) for s in range(len(iw) - n + 1)) / n
                if score >= dc.SIMILARITY:
                    out[d, i] = min(out.get((d, i), (0, 0)), (-score, g))
    return {k: (g, -s) for k, (s, g) in out.items()}


@pytest.fixture(scope="module")
def fixture(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rnd.choices(vocabulary, k=n)) for n in (3, 5, 6, 8, 14, 25, 40)] + ["", None, "solo", "two words", *(" ".join(rnd.choices(vocabulary, k=n)) for n in (4, 9, 10, 11, 12, 13))]
    docs = [" ".join(rnd.choices(vocabulary, k=60)) for _ in range(10)] + ["", None, items[0], items[1].upper() + "!"]
    for item in items[1:7]:
        for rate in (0, 0.1, 0.2, 0.5):
            w = [rnd.choice(vocabulary) if rnd.random() < rate else x for x in item.split()]
            docs.append(" ".join(rnd.choices(vocabulary, k=9) + w + rnd.choices(vocabulary, k=5)))
    # every place of one or two replaced words in items of 4 to 13 words, and items that lack their beginning
    for item in items[1:4] + items[-6:]:
        w = item.split()
        for a in range(len(w)):
            for b in range(a, len(w), 3):
                docs.append(" ".join(["zzz", *("qqq" if k in (a, b) else x for k, x in enumerate(w)), "yyy"]))
        docs.append(" ".join(w[1:]))
    docs += ["a solo b", "only two words", "two other words"]
    docs.append("the " * 30000)
    docs.append(" ".join(items[6].split()[20:]) + " end")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS score", "doc_id AS item_id", "3 AS `meta.src`")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return d, b, list(enumerate(docs)), list(enumerate(items))


def test_overlaps_match_brute_force(fixture):
    d, b, docs, items = fixture
    got = {(r.doc_id, r.item_id): (r.start, pytest.approx(r.score)) for r in dc.overlaps(d.unionByName(d.limit(5)), b).collect()}
    assert got == brute(docs, items)
    # verbatim copies of items of five words or more are among them, and so are most with a word in ten replaced
    assert len(got) >= 16


def test_clean_keeps_the_rest(fixture, spark):
    d, b, docs, items = fixture
    out = dc.clean(d, b)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in docs} - {k[0] for k in brute(docs, items)}
    nulls = spark.createDataFrame([(None, items[6][1])], "doc_id long, text string")
    assert dc.clean(nulls, b).count() == 1


def test_small_changes_that_fixed_windows_missed(spark):
    items = ["alpha beta gamma delta epsilon", "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10", "one two three"]
    docs = ["x y zzz beta gamma delta epsilon w", "q a1 a2 a3 a4 b5 b6 a7 a8 a9 a10 q", "so one two three it is", "alpha beta gamma"]
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in dc.overlaps(d, b).collect()) == [(0, 0, 0.8), (1, 1, 0.8), (2, 2, 1.0)]


def test_very_long_text(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    d = spark.createDataFrame([(1, "word " * 300_000 + "alpha beta gamma delta epsilon"), (2, "x" * 1_000_000)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in dc.overlaps(d, b).collect()] == [(1, 300_000)]


def test_empty_tables(fixture):
    d, b, docs, _ = fixture
    assert dc.overlaps(d.where("false"), b).count() == 0
    assert dc.overlaps(d, b.where("false")).count() == 0
    assert dc.clean(d, b.where("false")).count() == len(docs)


def test_no_python_in_the_plan(fixture):
    d, b, *_ = fixture
    plan = dc.overlaps(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
