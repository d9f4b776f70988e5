import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import packing
from graphloom.llm.queries import BYTE_BPE
from graphloom.llm.shared import scratch

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def checked(rows, texts, library, capacity=2048):
    """Every id lies in exactly one piece, pieces lie in sequences without gaps; returns tokens and padding."""
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts.values())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys() and len(want) == len(texts)
    for doc, own in by_doc.items():
        ids, at = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length])) and r.length > 0
            at += r.length
        assert at == len(ids)
    padding = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return sum(r.length for r in rows), padding


def packed(spark, df, **kw):
    path = scratch(spark, "packing")
    packing.write(df, BYTE_BPE, path, **kw)
    return path, packing.pieces(spark, path).collect()


def test_documents(spark, documents, library):
    _, rows = packed(spark, documents)
    tokens, padding = checked(rows, {r.doc_id: r.text for r in documents.collect()}, library)
    assert padding < 0.01 * tokens and len(rows) < 4 * documents.count()


def test_odd_texts_and_columns(spark, docs_of, library):
    rnd = random.Random(1)
    texts = [None, "", " ", "a", "<|endoftext|>x", "é 日本", "word " * 30000, "x" * 9000] + ["w " * rnd.randrange(3000) for _ in range(200)] + ["same text"] * 50
    df = docs_of(texts).withColumnsRenamed({"source": "sequence_id", "kept": "meta.src"})
    _, rows = packed(spark, df.repartition(3))
    tokens, padding = checked(rows, dict(enumerate(texts)), library)
    assert padding < 0.01 * tokens
    # narrow sequences and wide ids
    _, rows = packed(spark, df, capacity=64, slack=0, end=1 << 17 | 1)
    assert sum(r.length for r in rows) == tokens and max(r.offset + r.length for r in rows) == 64


def test_repeated_and_missing_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (3, None)], "doc_id long, text string").coalesce(1)
    _, rows = packed(spark, df)
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 3), (0, 3), (3, 1), (3, 3), (3, 3)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    path, rows = packed(spark, df.where("doc_id > 3"))
    assert rows == [] and packing.sequences(spark, path).count() == 0


def test_sequences_are_padded(spark, docs_of):
    path, rows = packed(spark, docs_of(["some words here " * n for n in range(1, 400, 7)]))
    by_id = defaultdict(int)
    for r in rows:
        by_id[r.sequence_id] += r.length
    for r in packing.sequences(spark, path, pad=9).collect():
        n = by_id[r.sequence_id]
        assert r.n_tokens == n and len(r.ids) == (n if n & (n - 1) == 0 else 2048) and all(x == 9 for x in r.ids[n:])
        own = [p for p in rows if p.sequence_id == r.sequence_id]
        assert all(crc(r.ids[p.offset : p.offset + p.length]) == p.ids_crc32 for p in own)


def test_encoder_equals_the_library(documents, library, monkeypatch):
    own, rnd = packing.Encoder(BYTE_BPE), random.Random(4)
    assert own.fast is not None
    alphabet = "aethionrs  .,'!0123\n\tABC" + "éßжя漢한" + "½\u2028\x1c²٣"
    texts = ["".join(rnd.choices(alphabet[: -6 * (k % 2) or None], k=rnd.randrange(300))) for k in range(3000)] + [r.text for r in documents.collect()]
    texts += ["", "x" * 5000, " " * 9000, "<|endoftext|> a", "don't we'LL 's", "a\n\n  b  ", *("a" * n for n in range(40)), *(" " * n + "b" for n in range(30))]
    ids, counts = own.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sum(map(own.plain, texts)) > 300 and not own.plain("x" * 5000) and not own.plain("<|endoftext|>")
    monkeypatch.setattr(own, "fast", None)
    assert own.encode(texts[:200])[0].tolist() == [i for w in want[:200] for i in w]


def test_classes():
    for capacity in (1, 2, 7, 64, 2048):
        for n in range(0, 2 * capacity + 1):
            own = packing.harmonic_lengths(n, capacity, capacity // 64)
            assert sum(own) == n and all(0 < x <= capacity for x in own)
            # a full bin of a class never overflows and leaves little empty
            assert all(0 <= capacity - capacity // x * x <= max(capacity // 64, 2 * capacity**0.5) for x in own)
            assert sum(packing.leftover_lengths(n, capacity)) == n
    assert max(len(packing.harmonic_lengths(n)) for n in range(2048)) <= 6
