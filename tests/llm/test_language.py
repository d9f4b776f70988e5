import itertools
import zlib

import numpy as np
import pytest

from graphloom.llm import language


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, transitions = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    starts, lens = np.array([0, 4, 4]), np.array([4, 0, 5])
    keep = lens > 0
    got, expected = language.forward_backward(scores, lens, transitions, pairs=True)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for s, n in zip(starts[keep], lens[keep]):
        paths = list(itertools.product(range(3), repeat=int(n)))
        w = np.array([np.exp(sum(scores[s + t, y] for t, y in enumerate(p)) + sum(transitions[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for t, y in enumerate(p):
                want[s + t, y] += x
            for a, b in itertools.pairwise(p):
                pairs[a, b] += x
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    out = language.report(df).collect()
    assert len(out) == len(lang)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    tested = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) / len(tested) > 0.97


@pytest.fixture(scope="module")
def model():
    return language.fit(["the cat and the dog of this house", "der hund und die katze von dem haus"] * 5, ["en", "de"] * 5)


def test_code_switched_words_get_their_own_labels(model):
    own = language.Labeller(model)
    posterior, lens = own.posteriors(["the dog and the cat of this house 12 der hund und die katze von dem haus", ""])
    assert lens.tolist() == [16, 0]
    assert [model.labels[k] for k in posterior.argmax(1)] == ["en"] * 8 + ["de"] * 8


def test_undetermined_and_odd_texts(docs_of, model):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs_of([None, "", "12 - 34!", "the " * 20000, "é" * 50000, "Katze?"]), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == "en" and got[5][0] == "de" and got[4][0] in model.labels


def test_nothing_to_learn_from(docs_of, spark):
    rows = spark.createDataFrame([(1, "text", None), (2, None, "en"), (None, "text", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.report(rows).collect()} == {"und"}
    assert language.keep(rows).count() == 0
    assert language.report(docs_of(["a"]).where("doc_id < 0")).count() == 0


def test_keep_passes_columns(docs_of):
    df = docs_of(["some words of text", None, "123", "more words"])
    out = language.keep(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {0, 3}


def test_sample_holds_every_language_at_any_size(spark):
    from graphloom.llm import shared

    for n in (301, 150_000_001, 10**10, 10**15):
        share = (shared.hash_limit(150, n) + 2**63) / 2**64
        assert share * n == pytest.approx(300, rel=1e-3)
    assert shared.hash_limit(150, 300) == 2**63 - 1
    # many rows of one text and 2000 of others: copies count once, the small language is whole
    rows = spark.range(6000).selectExpr("if(id < 4000, 'same text', concat('text ', id)) AS text", "'en' AS lang").union(spark.createDataFrame([("ein text", "de")] * 500, "text string, lang string"))
    got = [(r.lang, r.text) for r in shared.sample_by_hash(rows, 150, "lang").collect()]
    assert len(got) == len(set(got)) == 151 and ("de", "ein text") in got
    hashes = sorted(r.h for r in rows.where("lang = 'en'").selectExpr("xxhash64(text, 42) AS h").distinct().collect())
    kept = spark.createDataFrame([(t,) for x, t in got if x == "en"], "text string").selectExpr("xxhash64(text, 42) AS h").collect()
    assert sorted(r.h for r in kept) == hashes[:150]


def test_ngrams_cover_whole_words():
    def ngrams(word):
        whole, out = "\x02" + word + "\x03", []
        for n in range(1, 5):
            out += [whole[i : i + n] for i in range(len(whole) - n + 1) if n < 4 or i == 0 or i + n == len(whole)]
        return out

    def hashed(gram):
        h = 0
        for i, c in enumerate(gram):
            h = ((h * 0x9E3779B97F4A7C15 + ord(c)) * 0xD6E8FEB86659FD93) % 2**64
        return (h >> 40) % language.BUCKETS

    words = ["a", "b" * 20, "c" * 21, "".join(chr(97 + i % 26) for i in range(39)), "".join(chr(97 + i * 7 % 26) for i in range(40)), "é" * 400]
    ids, first = language.feature_ids(words)
    for w, a, b in zip(words, first, [*first[1:], len(ids)]):
        got = sorted(x for x in ids[a:b].ravel().tolist() if x != language.BUCKETS)
        assert got == sorted([*map(hashed, ngrams(w)), language.hash_word(w)])


def test_texts_without_blanks_are_read_to_their_end(model):
    own = language.Labeller(model)
    german = "derhundunddiekatzevondemhaus" * 20
    assert own.label(["thecatandthedogofthis" + german])[0] == ["de"]
    assert language.words_of("今日は良い天気 and สวัสดีชาว") == ["今日は良", "い天気", "and", "สวัส", "ดีชา", "ว"]
    cjk = language.fit(["今日は良い天気ですね", "我们今天去北京看朋友"] * 5, ["ja", "zh"] * 5)
    assert language.Labeller(cjk).label(["今日は良い" + "我们今天去北京看朋友" * 9])[0] == ["zh"]


def unbroken(scores, transitions):
    """Forward-backward over one chain, word by word."""
    local, step = np.exp(scores - scores.max(1, keepdims=True)), np.exp(transitions)
    a, b = [local[0] / local[0].sum()], [np.ones(scores.shape[1])]
    for x in local[1:]:
        v = (a[-1] @ step) * x
        a.append(v / v.sum())
    for x in local[:0:-1]:
        v = step @ (x * b[-1])
        b.append(v / v.sum())
    p = np.array(a) * np.array(b[::-1])
    a, b = np.array(a), np.array(b[::-1])
    joint = a[:-1, :, None] * step[None] * (local[1:] * b[1:])[:, None, :]
    return p / p.sum(1, keepdims=True), (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def test_long_chains_are_not_broken(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 7)
    rng = np.random.default_rng(2)
    lens = np.array([1000, 0, 7, 8, 1, 300, 14])
    scores, transitions = rng.normal(size=(lens.sum(), 4)), rng.normal(size=(4, 4)) * 3
    got, expected = language.forward_backward(scores, lens, transitions, pairs=True)
    parts = [unbroken(scores[e - n : e], transitions) for n, e in zip(lens, np.cumsum(lens)) if n]
    assert np.allclose(got, np.concatenate([p for p, _ in parts])) and np.allclose(expected, sum(x for _, x in parts))


def test_report_equals_a_brute_force_labelling(docs_of, model):
    texts = ["the dog und die katze " * 300, "of", "x1 der " + "hund" * 15, None, "12"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs_of(texts), model).collect()}
    for i, t in enumerate(texts):
        words = [w for w in (t or "").split() if language.has_letter(w)]
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        scores = np.array([model.weights[language.feature_ids([w])[0].ravel()].sum(0) for w in words], np.float64)
        mean = unbroken(scores, model.transitions)[0].mean(0)
        assert got[i][0] == model.labels[mean.argmax()] and got[i][1] == pytest.approx(mean.max(), abs=1e-4)


def test_ends_of_long_words_count():
    tail = lambda w: set(language.feature_ids([w])[0].ravel().tolist())
    a, b = tail("q" * 60 + "ing"), tail("q" * 60 + "ung")
    assert a != b and tail("q" * 60) != tail("q" * 60 + "e")
