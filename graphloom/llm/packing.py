"""Sequence packing by harmonic classes.

A length r belongs to the class i = capacity // r, whose bins hold exactly i pieces: lengths above
capacity / (i + 1) and up to capacity / i. Every task fills the bins of its own documents, one open bin
for each class, so no task waits for another, nothing is shuffled, and a task holds less than one sequence
for each of some 2 * sqrt(capacity) classes.

Documents may be cut, which keeps padding small. What is longer than a sequence gives whole sequences first.
A rest that would leave more than ``SLACK`` tokens of its class's bins empty gives up a piece that fits the
next class to the token, and the remainder is looked at again; each cut leaves some r / (i + 1) tokens, so
there are few. At the end of a task its open bins are strung together and cut into whole sequences and, for
what is left of a sequence, into sequences of powers of two, which need no padding.

A packing is a folder with ``sequences`` (Parquet: part, number, width, ids, and for each piece doc_ids,
starts, lengths, doc_tokens), written by Spark's own committer. ``ids`` holds the pieces one after the other as
little-endian unsigned integers of ``width`` bytes. Sequences are numbered from 0 without gaps.

Defined cases: a null text counts as empty and has just its end id; rows that share a ``doc_id``, or have
none, are documents of their own; texts of any length are encoded whole; equal texts are packed each for itself;
an empty table gives a folder without sequences and empty results; columns other than ``doc_id`` and ``text``
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.shared import text_or_empty, worker_state

END = 1
CAPACITY = 2048
#: Tokens of a sequence that may stay empty so that a piece need not be cut.
SLACK = 32
#: Fixed value: the pre-tokenisation pattern of the public vocabulary, as tiktoken takes it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a run of so many characters without a border go through the codec, whose time does not grow with a word's square.
LONG_RUN = re.compile(r"\S{4000}|\s{4000}")
#: Bytes of ids in one batch of sequences.
BATCH_BYTES = 4_000_000
SEQUENCES = "part int, number long, width int, doc_ids array<bigint>, starts array<bigint>, lengths array<int>, doc_tokens array<bigint>, ids binary"


def harmonic_lengths(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """The lengths of the pieces of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        members = capacity // rest
        take = rest if capacity - members * rest <= slack else capacity // (members + 1)
        out.append(take)
        rest -= take
    return out


def leftover_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Whole sequences and the powers of two that add up to ``n``, largest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


class Encoder:
    """Encodes texts by tiktoken where its ids are those of the tokenizer's file, and by the exact codec elsewhere.

    Merging by the rank of what comes out equals merging by the rank of the pair if ids rise with the merges and every
    token comes out of merging its own bytes: two tokens side by side that make up a token are then always its own halves.
    Texts with special tokens, with characters on which the two libraries' patterns might differ, or with very long runs are the codec's.
    """

    def __init__(self, path: str):
        self.codec = bpe.Codec(path, bpe.LEAN_CHUNKS)
        v = self.codec.vocabulary
        self.size, self.special, self.fast = v.size, list(v.special), None
        ranks = {b: i for i, b in enumerate(v.bytes) if b and i not in v.special.values()}
        if len(ranks) == int((v.accept >= 0).sum()) and (np.diff(v.made) > 0).all():
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return self.fast is not None and not bpe.ODD.search(text) and not (len(text) >= 4000 and LONG_RUN.search(text)) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        made: list = [self.fast.encode_to_numpy(t, disallowed_special=()) if self.plain(t) else None for t in texts]
        rest = [i for i, ids in enumerate(made) if ids is None]
        if rest:
            flat, counts = self.codec.encode([texts[i] for i in rest])
            for i, own in zip(rest, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                made[i] = own
        counts = np.array([len(ids) for ids in made], np.int64)
        return (np.concatenate(made).astype(np.int64) if made else np.zeros(0, np.int64)), counts


class Bins:
    """One task's open bins: a class's number of members to its pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, slack: int):
        self.capacity, self.slack, self.open = capacity, slack, {}

    def add(self, doc, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Cut a document's ids and yield the sequences that become full."""
        at, n = 0, len(ids)
        for length in harmonic_lengths(n, self.capacity, self.slack):
            members = self.capacity // length
            held = self.open.setdefault(members, [])
            held.append((doc, at, ids[at : at + length], n))
            at += length
            if len(held) == members:
                yield self.open.pop(members)

    def close(self) -> Iterator[list[tuple]]:
        """What the open bins hold, as sequences without padding."""
        pieces = [p for members in sorted(self.open) for p in self.open[members]]
        self.open = {}
        for room in leftover_lengths(sum(len(p[2]) for p in pieces), self.capacity):
            made = []
            while room:
                doc, start, ids, n = pieces[0]
                made.append((doc, start, ids[:room], n))
                room -= len(made[-1][2])
                if len(made[-1][2]) == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + len(made[-1][2]), ids[len(made[-1][2]) :], n)
            yield made


def write(docs: DataFrame, tokenizer: str, path: str, capacity: int = CAPACITY, slack: int = SLACK, end: int = END) -> None:
    """Encode every text, append the end id, pack, and write the sequences."""

    def run(batches):
        codec = worker_state(("packing", tokenizer), lambda: Encoder(tokenizer))
        part, bins, number = TaskContext.get().partitionId(), Bins(capacity, slack), 0
        width = 2 if max(codec.size, end + 1) <= 1 << 16 else 4

        def batch_of(made):
            nonlocal number
            n = len(made)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int32)
            flat = [p for s in made for p in s]
            kinds = ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()), (3, pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array([len(p[2]) if k == 2 else p[k] for p in flat], kind)) for k, kind in kinds]
            ids = [np.concatenate([p[2] for p in s]).astype(f"<u{width}").tobytes() for s in made]
            number += n
            return pa.record_batch(
                [pa.array([part] * n, pa.int32()), pa.array(range(number - n, number), pa.int64()), pa.array([width] * n, pa.int32()), *lists, pa.array(ids, pa.binary())],
                ["part", "number", "width", "doc_ids", "starts", "lengths", "doc_tokens", "ids"],
            )

        made: list = []
        for batch in batches:
            for piece in bpe.pieces(batch):
                flat, counts = codec.encode(piece.column(1).to_pylist())
                at = np.cumsum(counts)
                flat = np.insert(flat, at, end)
                ends = (at + np.arange(1, len(at) + 1)).tolist()
                for doc, first, last in zip(piece.column(0).to_pylist(), [0, *ends], ends, strict=False):
                    made.extend(bins.add(doc, flat[first:last]))
                if len(made) * capacity * width >= BATCH_BYTES:
                    yield batch_of(made)
                    made = []
                # open bins must not hold on to the ids of whole batches
                for held in bins.open.values():
                    held[:] = [(doc, start, ids.copy() if ids.base is not None else ids, n) for doc, start, ids, n in held]
        made.extend(bins.close())
        if made:
            yield batch_of(made)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts.mapInArrow(run, SEQUENCES).write.mode("errorifexists").parquet(f"{path}/sequences")


def _sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEQUENCES).parquet(f"{path}/sequences")


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """part and base: the sequences in all parts before it. One row for each part, whatever the corpus' size."""
    totals = _sequences(spark, path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    rows = _sequences(spark, path).join(F.broadcast(_bases(spark, path)), "part")
    return rows.withColumn("sequence_id", F.col("base") + F.col("number")).drop("part", "number", "base")


def sequences(spark: SparkSession, path: str, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, and ids (array of int) padded to the capacity, except where the number is a power of two."""

    def run(batches):
        for batch in batches:
            names, sizes, rows = [], [], []
            for name, width, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.frombuffer(data, f"<u{width}").astype(np.int32)
                n = len(ids)
                names.append(name)
                sizes.append(n)
                rows.append(ids if n & (n - 1) == 0 else np.concatenate([ids, np.full(capacity - n, pad, np.int32)]))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["sequence_id", "n_tokens", "ids"])

    return _numbered(spark, path).select("sequence_id", "width", "ids").mapInArrow(run, "sequence_id long, n_tokens int, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Read a packing back: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            docs, starts, lengths, totals = (batch.column(k).flatten() for k in (1, 2, 3, 4))
            widths, names = batch.column(5).to_pylist(), batch.column(6).to_numpy()
            n = lengths.to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first = np.concatenate([[0], ends])[(np.cumsum(sizes) - sizes)[owner]]
            offsets = ends - n - first
            crcs, at = [], offsets.tolist()
            k = 0
            for size, width, data in zip(sizes.tolist(), widths, batch.column(0), strict=True):
                view = memoryview(np.frombuffer(data.as_buffer(), f"<u{width}").astype("<u4").tobytes())
                for j in range(k, k + size):
                    crcs.append(zlib.crc32(view[4 * at[j] : 4 * (at[j] + int(n[j]))]))
                k += size
            yield pa.record_batch(
                [docs, starts, pa.array(n), pa.array(crcs, pa.int64()), totals, pa.array(names[owner], pa.int64()), pa.array(offsets, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    rows = _numbered(spark, path).select("ids", "doc_ids", "starts", "lengths", "doc_tokens", "width", "sequence_id")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
