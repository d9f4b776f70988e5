import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from test_decontamination import brute as overlaps  # noqa: E402
from test_exact_dedup import DROP  # noqa: E402
from test_minhash_dedup import brute as near  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    assert ids(stages[-1][0]) == ids(stages[-1][1])


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    with_letters = [r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")]
    assert ids(after) == sorted(with_letters)


def test_exact_dedup(stages):
    before, after = stages[1]
    best = {}
    for r in before.collect():
        key = (r.text or "").translate(DROP)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids(after) == sorted(i for _, i in best.values())


def test_near_dedup(stages):
    before, after = stages[2]
    assert ids(after) == sorted(i for i, v in near([(r.doc_id, r.text) for r in before.collect()], 5).items() if v[2])


def test_decontamination(stages, spark):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in overlaps([(r.doc_id, r.text) for r in before.collect()], items)}
    assert ids(after) == sorted(set(ids(before)) - gone)


def test_run_equals_the_stages(stages, spark):
    want = {tuple(r) for r in stages[-1][1].collect()}
    assert {tuple(r) for r in pipeline.run(spark, SF).collect()} == want


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(None, "some words here", "en", "s", 1), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "words here again", "en", "s", 2), (3, "words here again", "en", "s", 2), (4, "x" * 50000, "en", "s", 3)]
    rows += [(10 + i, " ".join(rnd.choices(["aa", "bb", "cc", "dd"], k=30)), "en", "s", 4) for i in range(9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([None, 3, 4, *range(10, 19)], key=str)
