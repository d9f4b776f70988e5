import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import store, versioned
from graphloom.operators.store import TripleStore
from graphloom.operators.versioned import Conflict, Databases, VersionedStore

EX = "http://ex.org/"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture
def db(spark, tmp_path):
    return Databases(spark, f"file://{tmp_path}/databases")


def test_databases_are_created_listed_and_removed(db):
    assert db.is_available() and db.names() == []
    db.create("one").add([("ex:a", "ex:p", 1)])
    db.create("two")
    assert db.names() == ["one", "two"] and db.open("one").df.count() == 1 and db.open("two").df.count() == 0
    with pytest.raises(ValueError):
        db.create("one")
    db.remove("one")
    assert db.names() == ["two"]
    with pytest.raises(ValueError):
        db.open("one")
    assert not Databases(db.spark, "nosuchscheme://x/y").is_available()


def test_random_changes_equal_a_set_of_triples(spark, db):
    rnd, want, kept = random.Random(3), set(), {0: set()}
    g = db.create("random", {"ex": EX})
    term = lambda: EX + rnd.choice("abcde")
    for _ in range(26):
        some = [(term(), EX + rnd.choice("pq"), term()) for _ in range(rnd.randrange(1, 7))]
        kind = rnd.choice(["add", "add", "add", "remove", "set", "subtract"])
        if kind == "add":
            g.add(some)
            want |= set(some)
        elif kind == "remove":
            s, p = rnd.choice([(some[0][0], None), (None, some[0][1]), (some[0][0], some[0][1])])
            g.remove(s, p)
            want = {t for t in want if not ((s is None or t[0] == s) and (p is None or t[1] == p))}
        elif kind == "set":
            g.set(some)
            want = {t for t in want if t[:2] not in {x[:2] for x in some}} | set(some)
        else:
            g.subtract(spark.createDataFrame(some, store.SCHEMA))
            want -= set(some)
        kept[g.version] = set(want)
        assert rows(g.df) == sorted(want) and scans(g.df) <= 2 and len(g.runs) <= 8
    assert max(kept) > 15
    for version in random.Random(1).sample(sorted(kept), 4):
        assert rows(g.at(version).df) == sorted(kept[version])
    middle = sorted(kept)[len(kept) // 2]
    got = {(r.change, (r.s, r.p, r.o)) for r in g.changes(middle).collect()}
    assert got == {("added", t) for t in want - kept[middle]} | {("removed", t) for t in kept[middle] - want}
    told = {r.version: r for r in g.history().collect()}
    assert told.keys() == kept.keys() - {0} and all(told[v].adds + told[v].deletes > 0 for v in told)
    g.compact()
    assert len(g.runs) == 1 and g.runs[0]["deletes"] == 0 and rows(g.df) == sorted(want)
    g.vacuum()
    assert len(g.folder.names("runs")) == 1 and rows(VersionedStore(spark, g.folder.path).df) == sorted(want)
    with pytest.raises(ValueError):
        g.at(middle)


def test_plans_stay_bounded_over_many_adds(db, monkeypatch):
    g = db.create("many")
    for i in range(40):
        g.add([(f"http://x/{i}", "http://p", i), (f"http://x/{i - 1}", "http://p", i - 1)])
    assert g.df.count() == 41 and g.version == 40 and scans(g.df) == 1 and len(g.runs) <= 3 * 3


def test_memory_stores_stay_bounded_too(spark):
    g = TripleStore(spark)
    for i in range(20):
        g.add([(f"http://x/{i}", "http://p", i)])
        assert scans(g.df) <= store.CHANGES + 1
    assert g.df.count() == 20


def test_a_failed_change_leaves_the_version_before(spark, db):
    g = db.create("failing").add([("http://a", "http://p", 1)])
    bad = spark.range(3).select(F.lit("http://a").alias("s"), F.lit("http://p").alias("p"), F.raise_error(F.lit("no")).cast("string").alias("o"))
    with pytest.raises(Exception, match="no"):
        g.add(bad)
    one = rows(g.df)
    assert g.version == 1 and rows(db.open("failing").df) == one
    # a run without a log file is not read, and goes with the next vacuum
    g._run(9, 0, spark.createDataFrame([("http://x", "http://p", "http://y", 9)], versioned.RUN), None)
    assert rows(db.open("failing").df) == one
    g.vacuum()
    assert len(g.folder.names("runs")) == 1


def test_of_two_writers_the_second_is_refused(db):
    one = db.create("shared")
    two = db.open("shared")
    one.add([("http://a", "http://p", 1)])
    with pytest.raises(Conflict):
        two.add([("http://a", "http://p", 2)])
    two.refresh().add([("http://a", "http://p", 2)])
    assert two.version == 2 and one.refresh().df.count() == 2
    with pytest.raises(Conflict):
        one.at(1).add([("http://b", "http://p", 1)])


def test_update_delete_and_changes_without_effect(db):
    g = db.create("update", {"ex": EX}).add([("ex:a", "ex:knows", "ex:b"), ("ex:b", "ex:knows", "ex:a"), ("ex:b", "ex:knows", "_:x"), ("_:x", "ex:p", "_:y"), ("_:y", "ex:p", 1)])
    g.update(g.match(("?a", "ex:knows", "?b")), delete=[("?a", EX + "knows", "?b")], insert=[("?b", EX + "knows", "?a")])
    assert g.version == 2 and rows(g.subject_objects("ex:knows")) == [("_:x", EX + "b"), (EX + "a", EX + "b"), (EX + "b", EX + "a")]
    g.add([("ex:a", "ex:knows", "ex:b")]).remove("ex:nobody").set([("ex:a", "ex:knows", "ex:b")])
    assert g.version == 2
    g.delete("_:x", scope="blank")
    assert not g.has("_:y") and not g.has("_:x") and g.version == 3
    assert g.add([]).version == 3
