"""Importance resampling towards a target distribution by n-gram buckets on word tries.

Features of a text are all runs of one to ``GRAM`` words; a feature's bucket is the CRC-32 of its bytes modulo
``BUCKETS``. A task puts the words of its documents in a trie: a node stands for a run of words, holds how often the
run occurs, and the CRC state of its bytes, which is made from the parent's state and the added word alone (the
parent's state moved past the word's bytes, plus the word's own CRC), so no run is spelled out or hashed again. Bucket
totals of all tries are merged by Spark. A bucket's gain compares the target's share with the corpus'. Documents are
then scored on tries of their own words with the gains attached to the nodes: a document walks the path from each of
its words and adds up what lies on it. Documents are drawn by weight plus Gumbel noise from a hash of their id.

A task starts a new trie after ``BLOCK`` words, so memory does not grow with a partition, and very long texts are
walked in slices that overlap by a feature's length; bucket totals and weights are sums, so neither changes a result.

Defined cases: A-Z count as a-z; words are runs of a-z, 0-9 and characters beyond ASCII; null and empty texts have
no words, no features and weight 0; of the documents with ``least`` words or more a share is drawn, best scores
first, ties to the smaller ``doc_id``, repeated rows of an id each for itself; a row without ``doc_id`` has no score and is never
drawn nor counted; an empty target or an empty table gives gains and results by the same formula; columns
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise

BUCKETS = 10_000
GRAM = 3
#: Words in a trie, and bytes of a text that are split at a time.
BLOCK, SLICE = 1_000_000, 8_000_000
#: Fixed value: letters A-Z fold, and ASCII other than letters and digits separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _shift_tables(lengths: np.ndarray) -> np.ndarray:
    """For each number of bytes, what each byte of a CRC state becomes when that many bytes follow: (length, byte place, value)."""
    # one bit at a time, for all bits of a state at once
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = (byte >> np.uint32(1)) ^ np.where(byte & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    step = (bits >> np.uint32(8)) ^ byte[bits & np.uint32(255)]

    def through(columns: np.ndarray, state: np.ndarray) -> np.ndarray:
        out = np.zeros_like(state)
        for k in range(32):
            out ^= np.where(state >> np.uint32(k) & np.uint32(1), columns[k], np.uint32(0))
        return out

    out = np.empty((len(lengths), 32), np.uint32)
    out[:] = bits
    power, left = step, np.asarray(lengths, np.int64).copy()
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = through(power, out[some])
        power, left = through(power, power), left >> 1
    values = np.arange(256, dtype=np.uint32)
    tables = np.zeros((len(lengths), 4, 256), np.uint32)
    for place in range(4):
        for k in range(8):
            tables[:, place] ^= np.where(values >> np.uint32(k) & np.uint32(1), out[:, 8 * place + k, None], np.uint32(0))
    return tables


class Trie:
    """Runs of words of some texts: for each level the nodes' CRC states and counts, and the node that every start reaches.

    ``texts`` are (words, starts): features start at the first so many words only.
    """

    def __init__(self, texts: list[tuple[list[bytes], int]]):
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        sizes = np.array([len(w) for w, _ in texts], np.int64)
        index = np.fromiter((known[w] for words, _ in texts for w in words), np.int64, int(sizes.sum()))
        n = max(len(known), 1)
        alone = np.array([zlib.crc32(w) for w in known], np.uint32)
        after = np.array([zlib.crc32(b" " + w) for w in known], np.uint32)
        lengths, kind = np.unique(np.array([len(w) + 1 for w in known], np.int64), return_inverse=True)
        tables = _shift_tables(lengths)
        ends = np.cumsum(sizes)
        place = np.arange(len(index))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        starts = place[place - (ends - sizes)[self.owner] < np.array([s for _, s in texts], np.int64)[self.owner]]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        node, state = index[starts], alone
        for level in range(GRAM):
            if level:
                going = starts + level < ends[self.owner[starts]]
                starts, node = starts[going], node[going]
                keys, node = np.unique(node * n + index[starts + level], return_inverse=True)
                parent, word = state[keys // n], keys % n
                table = kind[word]
                state = after[word]
                for k in range(4):
                    state = state ^ tables[table, k, parent >> np.uint32(8 * k) & np.uint32(255)]
            self.levels.append((starts, node, state, np.bincount(node, minlength=len(state))))

    def totals(self) -> np.ndarray:
        """How many features lie in each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for _, _, state, count in self.levels:
            np.add.at(out, state % BUCKETS, count)
        return out

    def walk(self, gains: np.ndarray, n: int) -> np.ndarray:
        """The sum of gains along the paths of each of n texts."""
        path = np.zeros(len(self.owner), np.int64)
        for starts, node, state, _ in self.levels:
            path[starts] += gains[state % BUCKETS][node]
        total = np.concatenate([[0], np.cumsum(path)])
        ends = np.cumsum(np.bincount(self.owner, minlength=n))
        return np.diff(np.concatenate([[0], total[ends]]))


def _slices(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text and how many of them start features; a slice's last words lead the next slice."""
    data, at, lead = data.translate(FOLD), 0, []
    while True:
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        words = lead + data[at : end if end >= 0 else len(data)].split()
        if end < 0:
            yield words, len(words)
            return
        starts = max(0, len(words) - GRAM + 1)
        yield words, starts
        lead, at = words[starts:], end


def _blocks(batches) -> Iterator[tuple[list, list[tuple[list[bytes], int]]]]:
    """(ids, texts) of some BLOCK words each; a text in slices has an entry for each of them, its last one told by True."""
    names, texts, held = [], [], 0
    for batch in batches:
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            last = None
            for part in _slices(data.as_py() or b""):
                if last is not None:
                    names.append((doc, False))
                    texts.append(last)
                    held += len(last[0])
                    if held >= BLOCK:
                        yield names, texts
                        names, texts, held = [], [], 0
                last = part
            names.append((doc, True))
            texts.append(last)
            held += len(last[0])
            if held >= BLOCK:
                yield names, texts
                names, texts, held = [], [], 0
    if names:
        yield names, texts


def _texts(docs: DataFrame, *keys) -> DataFrame:
    return docs.select(*keys, F.col("text").cast("string").cast("binary").alias("text"))


def bucket_totals(docs: DataFrame) -> DataFrame:
    """bucket and n: how many features of all texts lie in it (buckets without any have no row)."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in _blocks(batches):
            total += Trie(texts).totals()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return _texts(docs, F.lit(0).alias("doc_id")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """Each bucket's gain. What comes to the driver is a number for each of ``BUCKETS`` buckets, whatever the tables hold."""
    s, t = ({r["bucket"]: r["n"] for r in bucket_totals(x).collect()} for x in (docs, target))
    all_s, all_t = float(sum(s.values()) + BUCKETS), float(sum(t.values()) + BUCKETS)
    return [math.floor(1000 * math.log(float(t.get(k, 0) + 1) * all_s / (float(s.get(k, 0) + 1) * all_t))) for k in range(BUCKETS)]


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    own = np.array(gains(docs, target), np.int64)

    def run(batches):
        words = weight = 0
        for names, texts in _blocks(batches):
            sums = Trie(texts).walk(own, len(texts)).tolist()
            out = []
            for (doc, last), (_, starts), part in zip(names, texts, sums, strict=True):
                words, weight = words + starts, weight + part
                if last:
                    out.append((doc, words, weight))
                    words = weight = 0
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "n_words", "weight"])

    rows = _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_words long, weight long")
    return rows.select("doc_id", "n_words", sum(F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(GRAM)).alias("n_features"), "weight")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn, from 1; null for others) of every document.

    Ranks come from a range shuffle by score: each task numbers its own range, and the sizes of the ranges before it are added.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, target).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = scored.withColumn("open", (F.col("n_words") >= least) & F.col("score").isNotNull())
    order = [F.desc("open"), F.desc("score"), F.asc("doc_id"), F.desc("n_features")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "scored")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("m"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    draw = sizes.agg((F.floor(F.coalesce(F.sum("m"), F.lit(0)) * percent / 100)).alias("draw"))
    # a row for each task, and one
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(before), "part").join(F.broadcast(draw))
    place = F.col("base") + F.col("place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (place <= F.col("draw")), place).cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """The drawn documents with all their columns (rows that share a drawn ``doc_id`` all come)."""
    picked = materialise(resample(docs, target, percent, least, seed).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct(), "drawn")
    return docs.join(picked, docs["doc_id"].cast("long") == picked["__drawn"], "left_semi")
