import hashlib
import random
import re
from collections import defaultdict

import pytest

from graphloom.llm import substring_dedup as sd
from graphloom.llm.shared import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = defaultdict(lambda: float("inf"))
    for i, w in words:
        if i is not None:
            for k in range(len(w) - sd.WINDOW + 1):
                key = tuple(w[k : k + sd.WINDOW])
                least[key] = min(least[key], i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - sd.WINDOW + 1):
                if least[tuple(w[k : k + sd.WINDOW])] < i:
                    gone.update(range(k, k + sd.WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts():
    rnd = random.Random(6)
    vocabulary = ["w%d" % i for i in range(300)] + ["é", "😀x", "\xa0y"]
    passage = [" ".join(rnd.choices(vocabulary, k=n)) for n in (49, 50, 51, 80, 200)]
    out = [None, "", "a b", " ".join(["same"] * 120), " ".join(["same"] * 60), " ".join(["same"] * 49)]
    for _ in range(60):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(40))), rnd.choice(passage), rnd.choice(["\n", " \t ", "\v"]).join(rnd.choices(vocabulary, k=20)), rnd.choice(passage)]
        rnd.shuffle(parts)
        out.append(rnd.choice([" ", "\n", "  "]).join(parts))
    near = out[20].split(" ")
    for k in range(10):
        copy = list(near)
        copy[rnd.randrange(len(copy))] = f"changed{k}"
        out.append(" ".join(copy))
    return out + [out[21], "x" * 50000, "word " * 20000]


def result(df, index, batches=2):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.report(df, index, batches).collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_report_matches_brute_force(spark, docs_of, batches):
    own, ids = texts(), list(range(len(texts())))
    random.Random(batches).shuffle(ids)
    rows = list(zip(ids, own, strict=True))
    assert result(docs_of(own, ids), sd.FingerprintIndex(spark, scratch(spark, "f"), 4), batches) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("hot", [1, 3])
def test_common_anchors_are_dealt_to_parts(spark, docs_of, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    own = texts()
    assert result(docs_of(own), sd.FingerprintIndex(spark, scratch(spark, "f"), 4)) == sorted(brute(list(enumerate(own))), key=repr)


def test_windows_of_one_common_sequence_spread_over_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 50)
    own = [" ".join(["same"] * 249)] * 5 + [" ".join(f"u{i}" for i in range(80))]
    docs = docs_of(own)
    index = sd.FingerprintIndex(spark, scratch(spark, "f"), 4)
    run = index.append(docs)
    shared = index.shared(run)
    assert [r.n for r in shared.collect()] == [5 * 200]
    salts = [r["count"] for r in sd.shared_windows(docs, shared, index.read(run)).groupBy("salt").count().collect()]
    assert len(salts) == 20 and sum(salts) == 1000 and max(salts) < 100
    assert result(docs, sd.FingerprintIndex(spark, scratch(spark, "f"), 4)) == sorted(brute(list(enumerate(own))), key=repr)


def test_shuffle_paths_and_compaction(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 3)
    monkeypatch.setattr(sd, "BROADCAST_ANCHORS", -1)
    monkeypatch.setattr(sd, "BROADCAST_DOCUMENTS", -1)
    monkeypatch.setattr(sd, "BROADCAST_IDS", -1)
    index = sd.FingerprintIndex(spark, scratch(spark, "f"), 4)
    own = texts()
    assert result(docs_of(own), index, 4) == sorted(brute(list(enumerate(own))), key=repr)
    # four runs of the lowest level became two and then one
    assert [r.split("-")[2] for r in index.runs()] == ["2"]


def test_words_that_fool_sums_of_powers(spark, docs_of):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    own = [" ".join([w] * 60) for w in (one, other, "x" * 5000, "x" * 4999 + "y", "é" * 8 + "a", "é" * 8 + "b")]
    assert result(docs_of(own), sd.FingerprintIndex(spark, scratch(spark, "f"), 4)) == sorted(brute(list(enumerate(own))), key=repr)


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    rnd = random.Random(4)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 40))) for _ in range(3000)} | {"z" * n for n in range(1, 70)}
    words = sorted(words)
    hashes, counts = sd.word_hashes(pa.array([" ".join(words)] + words))
    assert counts.tolist() == [len(words)] + [1] * len(words)
    assert len(set(hashes[: len(words)].tolist())) == len(words) and hashes[: len(words)].tolist() == hashes[len(words) :].tolist()


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(documents, sd.FingerprintIndex(spark, scratch(spark, "f"), 4)) == sorted(brute(rows), key=repr)


def test_repeated_and_null_ids(spark, docs_of):
    t = texts()[10]
    rows = [(5, t), (5, t), (None, t), (7, t + " more"), (7, "other " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, sd.FingerprintIndex(spark, scratch(spark, "f"), 4)) == sorted(brute(rows), key=repr)


def test_empty_table(spark, docs_of):
    assert result(docs_of(["a"]).where("doc_id < 0"), sd.FingerprintIndex(spark, scratch(spark, "f"), 4)) == []


def test_history_is_merge_joined_without_a_shuffle(spark, docs_of):
    index = sd.FingerprintIndex(spark, scratch(spark, "f"), 4)
    index.append(docs_of(texts()[:30]))
    run = index.append(docs_of(texts()[30:], list(range(30, len(texts())))))
    plan = index.shared(run)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
