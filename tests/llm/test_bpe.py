import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import bpe, token_files
from graphloom.llm.queries import BYTE_BPE
from graphloom.llm.shared import scratch

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    None, "", " ", "a", "  a  b\n\n c\t d ", "x<|endoftext|>y <|endoftext|>", "½ ²³ ٣ \x1c b é́ 🤖🤖 日本語", "a" * 3000, "ab" * 500, " \n \n\n\n x",
    "don't you'll we'VE 's", "\x00\x01", "___ a_b 12_3", "\xa0x\xa0 y", "Ⅷ ① x̀y", "word " * 30000, "x" * 200000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip_equals_library(docs_of, documents, library):
    for df in (docs_of(TEXTS), documents):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = {r.doc_id: r for r in bpe.round_trip(df, BYTE_BPE).collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_encode_then_decode(docs_of):
    df = docs_of(TEXTS[:15])
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, BYTE_BPE), BYTE_BPE).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS[:15])}


def test_random_words_and_every_pair_check(library):
    own, rnd = bpe.codec(BYTE_BPE).vocabulary, random.Random(2)
    words = ["".join(rnd.choice("aethionrsé.,0") for _ in range(rnd.randrange(1, 90))).encode() for _ in range(3000)]
    ids, counts = own.encode_words(words)
    exact, exact_counts = own.merge(words)
    assert (ids == exact).all() and (counts == exact_counts).all()
    a, b = np.array([rnd.randrange(50256) for _ in range(4000)]), np.array([rnd.randrange(50256) for _ in range(4000)])
    merged, n = own.merge([own.bytes[x] + own.bytes[y] for x, y in zip(a, b, strict=True)])
    starts = np.cumsum(n) - n
    want = [k == 2 and merged[s] == x and merged[s + 1] == y for k, s, x, y in zip(n, starts, a, b, strict=True)]
    assert own.compatible(a, b).tolist() == want


def test_memo_bound_changes_nothing():
    own = bpe.Codec(BYTE_BPE)
    texts = [f"some words {i} and more {i * i}" for i in range(200)]
    whole = own.encode(texts)[0].tolist()
    own = bpe.Codec(BYTE_BPE, 10)
    assert [x for t in texts for x in own.encode([t])[0].tolist()] == whole


def test_codes_are_directly_addressable():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rnd.integers(0, 2**32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        reader = token_files.Reader(token_files.pack(ids))
        assert len(reader) == n and (reader.all() == ids).all()
        places = rnd.integers(0, max(n, 1), 300) if n else np.zeros(0, int)
        assert (reader.at(places) == ids[places]).all()
    with pytest.raises(IndexError):
        reader.at([5000])


def test_token_files_round_trip(spark, docs_of, library, monkeypatch):
    import zlib

    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 1 << 17)
    ids = list(range(100, 100 + len(TEXTS)))
    random.Random(1).shuffle(ids)
    df, path = docs_of(TEXTS, ids), scratch(spark, "tokens")
    token_files.write(df, BYTE_BPE, path, 3)
    flat, want = [], {}
    for i, t in sorted(zip(ids, TEXTS, strict=True)):
        own = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (len(flat), len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        flat += own
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.documents(spark, path).collect()} == want
    places = [0, len(flat) - 1, len(flat), 77, 77, *random.Random(4).sample(range(len(flat)), 50)]
    got = token_files.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert sorted((r.position, r.id) for r in got) == sorted((p, flat[p]) for p in places if p < len(flat))


def test_empty_table(spark, docs_of):
    df, path = docs_of(["a"]).where("doc_id < 0"), scratch(spark, "tokens")
    assert bpe.round_trip(df, BYTE_BPE).count() == 0
    token_files.write(df, BYTE_BPE, path)
    assert token_files.documents(spark, path).count() == 0


def test_very_long_texts_are_encoded_in_parts(monkeypatch):
    import random

    from tokenizers import Tokenizer

    from graphloom.llm import bpe, shared
    from graphloom.llm.queries import BYTE_BPE

    rnd, own, library = random.Random(5), bpe.Codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    monkeypatch.setattr(shared, "CUT", 10)
    monkeypatch.setattr(bpe, "CUT", 10)
    texts = ["".join(rnd.choice(["a", "th", "e", " ", "  ", "\n", ".", "'s", "É", "1", "\t", "<|endoftext|>"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    flat, counts = own.encode(texts)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_empty_table(docs_of):
    assert bpe.round_trip(docs_of(["text"]).where("doc_id < 0"), BYTE_BPE).count() == 0
