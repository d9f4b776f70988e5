import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from graphloom.llm import importance as imp


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(docs, target, percent=5, least=20):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + 10000) / ((s[k] + 1) * (all_t + 10000)))) for k in range(10000)]
    out, rank = [], {}
    for i, n, fs in own:
        weight = sum(gain[bucket(f)] for f in fs)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    open_rows = sorted((r for r in out if r[4] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], -r[1]))
    for k, r in enumerate(open_rows[: len(open_rows) * percent // 100]):
        rank[id(r)] = k + 1
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def result(docs, target, **kw):
    return sorted((tuple(r) for r in imp.resample(docs, target, **kw).collect()), key=repr)


def test_documents(spark, documents):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in target.collect()])
    assert result(documents, target) == want and sum(r[4] is not None for r in want) > 3


def odd_texts():
    rnd = random.Random(8)
    words = ["a", "B", "é", "É", "日本", "x1", "9", "İ", "ǆ", "Z" * 300]
    return [None, "", " .,", "one", "One TWO", "a-b_c", "\x00a\x7fb", "a b\xa0c"] + [" ".join(rnd.choices(words, k=rnd.randrange(60))) for _ in range(120)]


def test_odd_texts_ties_and_extra_columns(spark, docs_of):
    texts = odd_texts()
    df = docs_of(texts).withColumnsRenamed({"source": "rank", "kept": "score", "lang": "meta.src"})
    target = spark.createDataFrame([(1, "a b x1 9"), (2, None), (3, "É é")], "item_id long, text string")
    for percent in (5, 100):
        assert result(df, target, percent=percent) == brute(list(enumerate(texts)), ["a b x1 9", None, "É é"], percent)


def test_short_tries_and_slices_change_nothing(spark, docs_of, monkeypatch):
    texts = odd_texts() + ["some words " * 400, "y" * 5000]
    df, target = docs_of(texts).repartition(3), docs_of(["some words", "a b"])
    monkeypatch.setattr(imp, "BLOCK", 7)
    monkeypatch.setattr(imp, "SLICE", 11)
    # workers see the small values through the closure's module only in local runs of the helpers
    slices = [s for t in texts for s in imp._slices((t or "").encode())]
    assert sum(starts for _, starts in slices) == sum(features(t)[0] for t in texts) and max(len(w) for w, _ in slices) < 12
    want = Counter(bucket(f) for t in texts for f in features(t)[1])
    total = imp.Trie(slices).totals()
    assert {k: int(total[k]) for k in np.flatnonzero(total)} == want
    assert len(result(df, target)) == len(texts)


def test_states_follow_from_the_parents():
    rnd = random.Random(2)
    lengths = np.array([0, 1, 2, 3, 7, 8, 255, 256, 70000])
    tables = imp._shift_tables(lengths)
    for i, n in enumerate(lengths):
        for _ in range(5):
            a, b = rnd.randbytes(rnd.randrange(9)), rnd.randbytes(int(n))
            state = zlib.crc32(a)
            moved = 0
            for k in range(4):
                moved ^= int(tables[i, k, state >> 8 * k & 255])
            assert moved ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    long = "word other thing " * 10
    rows = [(None, long), (4, long), (4, long), (2, long + "x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = df.where("doc_id < 0")
    assert result(df, none, percent=50) == brute(rows, [], 50)
    assert result(none, df) == []
    assert result(df, df, percent=100) == brute(rows, [t for _, t in rows], 100)


def test_drawn_documents_keep_their_columns(spark, docs_of):
    texts = [f"alpha beta gamma {i} " * 8 for i in range(40)]
    df = docs_of(texts)
    got = imp.drawn(df, docs_of(["alpha beta gamma 7"]), percent=10)
    assert got.columns == df.columns and got.count() == 4
