import random

import pytest

from graphloom.llm import token_counts
from graphloom.llm.queries import PIECE_BPE

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [None, "", " ", "  ", "\n", " \n ", "a", "  a  b\n\n c\t d ", "a\n", "▁a▁▁b", "<s> </s> <unk>", "½ ²³ \x1c é́ 🤖 日本語", "x" * 100000, "\x01", "\x01\x01 a", " \x01", "\n\x01  \x01b", "a▁", "word " * 5000, "\r\n x\r\n"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def test_counts_equal_library(docs_of, documents, model):
    for df in (docs_of(TEXTS), documents):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(df, PIECE_BPE).collect()}
        want = {i: (len(t.encode()), n := len(model.encode(t, num_threads=1)), n > 4096) for i, t in texts.items()}
        assert got == want


def test_random_blanks(model, monkeypatch):
    rnd, own = random.Random(3), token_counts.Counter(PIECE_BPE)
    monkeypatch.setattr(token_counts, "MEMO_PRETOKENS", 50)
    texts = ["".join(rnd.choice("aeth  \n▁.'0É日\t\x01") for _ in range(rnd.randrange(30))) for _ in range(1500)]
    for k in range(0, len(texts), 100):
        assert own.count(texts[k : k + 100]).tolist() == [len(x) for x in model.encode(texts[k : k + 100], num_threads=1)]


def test_empty_table(docs_of):
    assert token_counts.counts(docs_of(["a"]).where("doc_id < 0"), PIECE_BPE).count() == 0


def test_very_long_texts_are_counted_in_parts(model, monkeypatch):
    from graphloom.llm import shared

    rnd, own = random.Random(5), token_counts.Counter(PIECE_BPE)
    monkeypatch.setattr(shared, "CUT", 10)
    monkeypatch.setattr(token_counts, "CUT", 10)
    texts = ["".join(rnd.choice("aeth   \n▁.\t") for _ in range(rnd.randrange(120))) for _ in range(400)]
    assert own.count(texts).tolist() == [len(x) for x in model.encode(texts, num_threads=1)]
