import random
import re

import pytest

from graphloom.llm import components as cc
from graphloom.llm import minhash_dedup as md


def sets(text, words):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words=2, percent=80):
    own = {i: sets(t, words) for i, t in rows}
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if own[a] and own[b] and min(len(own[a]), len(own[b])) * 100 >= percent * max(len(own[a]), len(own[b])) and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(own[i]), find(i), find(i) == i) for i in ids}


def texts():
    rnd = random.Random(9)
    vocabulary = ["v%d" % i for i in range(200)] + ["É", "Ab", "aB"]
    out = [None, "", " \t", "one", "ONE", "one two", "One  two", "one two three", "É", "é"]
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([4, 10, 40, 150]))
        out.append(" ".join(base))
        for _ in range(rnd.randrange(12)):
            copy = list(base)
            for _ in range(rnd.randrange(1, max(2, len(base) // 7))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(rnd.choice([" ", "\n"]).join(copy))
            base = copy if rnd.random() < 0.5 else base
    return out + ["long word " * 30000, "x" * 100000] + out[12:20]


def result(df, *args):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in md.components(df, *args).collect()}


@pytest.mark.parametrize("words", [2, 5])
def test_components_match_brute_force(docs_of, words):
    own, ids = texts(), list(range(len(texts())))
    random.Random(words).shuffle(ids)
    assert result(docs_of(own, ids), words) == brute(list(zip(ids, own, strict=True)), words)


def test_documents(documents):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_dense_regions_and_large_clusters(docs_of, monkeypatch):
    for name, value in (("BLOCK", 5), ("PIVOTS", 3), ("PIVOT_ROWS", 1), ("BROADCAST_MEMBERS", -1)):
        monkeypatch.setattr(md, name, value)
    own = texts()
    assert result(docs_of(own)) == brute(list(enumerate(own)))


def look_alikes(pairs, copies=1):
    """Pages that share most of their words: pairs are 0.98 similar, pages of different pairs 0.77."""
    rnd = random.Random(6)
    frame = [f"frame{i}" for i in range(280)]
    out = []
    for k in range(pairs):
        own = frame + [f"own{k}x{i}" for i in range(42)]
        out.append(" ".join(own))
        for c in range(copies):
            other = list(own)
            other[-1 - rnd.randrange(30)] = f"other{k}x{c}"
            out.append(" ".join(other))
    rnd.shuffle(out)
    return out


def test_look_alike_pages_beyond_one_task(docs_of, monkeypatch):
    # with the operator's own BLOCK, 2,100 pairs take some three minutes here
    monkeypatch.setattr(md, "BLOCK", 400)
    own = look_alikes(300)
    got = result(docs_of(own))
    by_component = {}
    for i, (_, component, _) in got.items():
        by_component.setdefault(component, []).append(i)
    pair = {}
    for i, t in enumerate(own):
        pair.setdefault(t.split()[285].split("x")[0], []).append(i)
    assert sorted(map(sorted, by_component.values())) == sorted(pair.values()) and len(by_component) == 300


def test_large_clusters_with_tight_groups_and_chains(docs_of, monkeypatch):
    for name, value in (("BLOCK", 20), ("PIVOT_ROWS", 1)):
        monkeypatch.setattr(md, name, value)
    own = look_alikes(12, 9) + look_alikes(3, 60)
    # a chain: each is like the next, the ends are not alike
    words = look_alikes(1)[0].split()
    for i in range(40):
        words[7 * i % 280] = f"turn{i}"
        own.append(" ".join(words))
    assert result(docs_of(own)) == brute(list(enumerate(own)))


def test_clusters_are_dealt_by_size_of_their_texts(docs_of, monkeypatch):
    monkeypatch.setattr(md, "SHINGLES", 60)
    own = texts()
    assert result(docs_of(own)) == brute(list(enumerate(own)))


def test_common_prefixes():
    import numpy as np

    assert md.common_prefixes(np.array([[1, 2, 3], [1, 2, 4], [1, 2, 4], [2, 2, 4]])).tolist() == [2, 3, 0]


def test_words_that_fool_sums_of_powers(docs_of):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    assert len(one) == 1024 and result(docs_of([one, other])) == {0: (1, 0, True), 1: (1, 1, True)}


def test_keep_leaves_one_of_each(docs_of):
    own = texts()
    df = docs_of(own).withColumnsRenamed({"lang": "__gone", "source": "component"})
    out = md.keep(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, v in brute(list(enumerate(own)), 5).items() if v[2]}


def test_null_ids_repeated_rows_and_empty_tables(spark, docs_of):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a b c"), (9, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in md.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (9, 9, True)], key=repr)
    assert result(docs_of(["a"]).where("doc_id < 0")) == {}


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(2000, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in cc.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
