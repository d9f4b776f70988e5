import hashlib
from collections import defaultdict

from graphloom.llm import exact_dedup

DROP = str.maketrans("", "", " \t\n\x0b\f\r")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(DROP)].append((-len(t or ""), i))
    out = {}
    for i, t in rows:
        g = groups[(t or "").translate(DROP)]
        keep = min(g)[1]
        out[i] = (keep, len(g), keep == i, hashlib.sha256((t or "").translate(DROP).encode()).hexdigest())
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(df).collect()}
    assert got == brute(rows)


def test_groups_match_brute_force(docs_of, documents):
    check(docs_of(["a b", "ab", None, "", " \t", "a  b", "x" * 100000, "é x", "éx", "b"]))
    check(documents)


def test_empty_table(docs_of):
    df = docs_of(["a"]).where("doc_id < 0")
    assert exact_dedup.groups(df).count() == 0
    assert exact_dedup.keep(df).count() == 0


def test_keep_returns_documents_once(docs_of, spark):
    df = docs_of(["a b", "ab", "c"]).unionByName(docs_of(["a b"]))
    out = exact_dedup.keep(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_null_ids_come_last(spark):
    df = spark.createDataFrame([(None, "ab"), (7, "a b"), (5, "ab ")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.groups(df).collect()}
    assert got == {(None, 5, False), (7, 5, False), (5, 5, True)}


def test_index_outlives_batches(spark, docs_of):
    from graphloom.llm.shared import scratch

    path = scratch(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert {r.keep_id for r in index.add(docs_of(["a", "b", "a "])).collect()} == {2, 1}
    spark.sql(f"DROP TABLE {index.table}")
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert [r.keep_id for r in again.add(docs_of(["a          ", "c"], [10, 11])).collect()] == [11]
    assert again.rows().count() == 3
    # the longer text of the second batch stays in the end
    assert {(r.keep_id, r.group_size) for r in again.resolved().collect()} == {(10, 3), (1, 1), (11, 1)}
    plan = again.unseen(again.rows().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_paths_that_end_alike_are_two_indexes(spark, docs_of):
    from graphloom.llm.shared import scratch

    tail = "/" + "t" * 80
    one, two = (exact_dedup.DigestIndex(spark, scratch(spark, name) + tail, 4) for name in ("one", "two"))
    one.add(docs_of(["a"]))
    assert two.rows().count() == 0 and two.add(docs_of(["a"])).count() == 1


def test_later_batches_meet_history(spark, docs_of):
    rows = docs_of(["a b", "c", "ab", "d", "c ", "c", "e", "a  b"])
    for batches in (1, 2, 4):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(rows, batches=batches).collect()}
        assert got == brute([(r.doc_id, r.text) for r in rows.collect()])


def test_keep_with_clashing_columns_nulls_and_both_joins(spark, monkeypatch):
    schema = "doc_id long, text string, __digest string, __keep long, id long, digest string, length int, stays boolean, own_0 int, OWN_1 int"
    extra = ("d", 1, 2, "e", 3, True, 4, 5)
    rows = [(1, "a b", *extra), (1, "a b", *extra), (2, "ab", *extra), (None, "q", *extra), (None, "q", *extra), (3, None, *extra), (4, " ", *extra), (5, "x" * 100000, *extra), (1, "other", *extra)]
    df = spark.createDataFrame(rows, schema)
    for limit in (0, 1000):
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
        out = exact_dedup.keep(df)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "a b"), (None, "q"), (4, " "), (5, "x" * 100000), (1, "other")], key=repr)
