"""Token counts without token ids.

A text's pre-tokens are cut where no piece of the vocabulary reaches across: before a run of blanks,
and around line feeds. Pieces are counted once for each distinct pre-token of a worker's share, the
counts are joined to every document's pre-token frequencies, and the products are summed. Nothing
is shuffled: a corpus-wide join of (document, pre-token) rows would move several times the input.

Defined cases: a null or empty text has no bytes and no tokens; texts of any length are counted
whole, those beyond ``CUT`` characters in parts; an empty table gives an empty result; repeated rows give
repeated results; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import pieces
from graphloom.llm.shared import CUT, cut, text_or_empty, worker_state

LIMIT = 4096
#: A worker forgets its counts beyond so many pre-tokens (they are only a cache).
MEMO_PRETOKENS = 1_000_000
#: Fixed value: how the vocabulary writes a blank.
BLANK = "▁"


class Counter:
    """Counts the pieces of pre-tokens with the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(BLANK in p[1:] and p.strip(BLANK) for p in vocabulary) or any("\n" in p for p in vocabulary) or self.model.encode("\n", out_type=str)[0] != BLANK or self.model.normalize(" a  b") != f"{BLANK * 2}a{BLANK * 2}b":
            raise ValueError("this vocabulary has pieces that reach across pre-tokens")
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.tokens = np.zeros(1 << 12, np.int64)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; the blank before each is left out, and one that starts with a blank had further blanks before it."""
        text = text.replace(BLANK, " ")
        chunks = text.replace("\n", " \n").split(" ")
        if "" not in chunks and chunks[0][0] != "\n":
            return chunks
        # the first blank of a run is the dummy prefix that the library puts before any text; it marks the run
        return re.findall(r" *[^ \n]+| +\n?[^ \n]*|\n[^ \n]*", " " + text)

    def learn(self, new: list[str]) -> None:
        # a pre-token that starts with a line feed has no blank of its own, so the prefix's piece is taken off
        texts = [p[1:] if p[0] == " " else p for p in new]
        counts = np.array([len(x) for x in self.model.encode(texts, num_threads=1)], np.int64)
        counts -= np.array([p[0] == "\n" for p in new], np.int64)
        # a single blank with nothing after it: the library adds no prefix to an empty text
        counts += np.array([p == " " for p in new], np.int64)
        known = len(self.memo)
        while known + len(new) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, self.tokens])
        self.tokens[known : known + len(new)] = counts
        self.memo.update(zip(new, range(known, known + len(new)), strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A very long one is counted in parts, cut at single blanks, which no piece reaches across."""
        if max(map(len, texts), default=0) <= CUT:
            return self._count(texts)
        out = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            # a part but the first starts with a blank, and the library puts one before any text
            for k, part in enumerate(cut(t.replace(BLANK, " "))):
                out[i] += self._count([part[1:] if k else part])[0]
        return out

    def _count(self, texts: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_PRETOKENS:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        memo = self.memo
        new = {p for row in split for p in row if p not in memo}
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(row) for row in split], np.int64)
        pretoken = np.fromiter((memo[p] for row in split for p in row), np.int64, int(sizes.sum()))
        # frequencies of (document, pre-token), joined to the counts
        width = max(1, len(memo))
        keys, frequency = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + pretoken, return_counts=True)
        return np.bincount(keys // width, frequency * self.tokens[keys % width], len(texts)).astype(np.int64)


def counter(path: str) -> Counter:
    """The worker's counter, kept between tasks."""
    return worker_state(("pieces", path), lambda: Counter(path))


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""

    def run(batches):
        own = counter(path)
        for batch in batches:
            for piece in pieces(batch):
                yield pa.record_batch([piece.column(0), piece.column(2), pa.array(own.count(piece.column(1).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
