"""Substring deduplication on a log-structured fingerprint index.

Every window of ``WINDOW`` consecutive words has an anchor: the least hash of the ``GRAM``-word
sequences in it. Equal windows have equal anchors, and a document has few, so of the window hashes the index
keeps these: immutable runs of (anchor, doc_id, windows), bucketed and sorted by anchor. A batch becomes a run
of its own and is merge-joined with the runs of history bucket by bucket (no shuffle). Only windows whose
anchor another document has too are fingerprinted in full (96 bits), in the batch and in those historical
documents that share an anchor with it; the rest of history is not hashed again. A fingerprint's least
doc_id then verifies every window. Runs are compacted by levels: ``FANOUT`` runs of a level become one of
the next, so a row is rewritten a logarithmic number of times.

Result: each word covered by a window whose word sequence also starts in a document with a smaller
``doc_id`` goes. Windows are judged on the texts as they came in.

Defined cases: words are runs of anything but space, tab, line feed, vertical tab, form feed and
carriage return; null and empty texts have none; documents of fewer than ``WINDOW`` words lose
nothing; rows that share a ``doc_id`` do not affect each other; rows without ``doc_id`` lose nothing
and serve as nobody's original; batches may come in any order of ids, but words are only removed
from the batch's own documents; texts may be of any length; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import pieces
from graphloom.llm.shared import batches_of, materialise, scratch, text_or_empty

WINDOW = 50
GRAM = 10
#: At most so many shared anchors (12 bytes each), documents with removals (some 50 bytes each), ids of
#: historical documents (8 bytes each) and window starts (4 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ANCHORS = 2_000_000
BROADCAST_DOCUMENTS, BROADCAST_IDS = 500_000, 2_000_000
BROADCAST_STARTS = 20_000_000
#: Windows of an anchor that has more of them are dealt to several tasks, this many to each.
HOT = 2000
#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Words of more bytes are hashed by a library.
LONG = 4096

_ODD = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and its inverse modulo 2**64, for i from 0 to n at least."""
    have = _POWERS.get(odd)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, odd, np.uint64), np.full(size, pow(odd, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[odd] = np.cumprod(up), np.cumprod(down)
    return have


def ranges(values: np.ndarray, odd: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], which depend on the values and their order alone."""
    up, down = powers(odd, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column without nulls, and each row's number of words.

    Works on the column's UTF-8 bytes; white space and row borders end words.
    """
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~_SPACES[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    return _hashed(data, starts, ends), np.diff(bounds)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words given as ranges of bytes: eight bytes at a time, each step a bijection of what it takes in.

    Words of one length up to eight bytes never collide. Very long words go through a cryptographic hash.
    """
    lens = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(lens.astype(np.uint64) * np.uint64(_ODD) + np.uint64(1))
    for i in np.flatnonzero(lens > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    at, k = np.flatnonzero(lens <= LONG), 0
    while len(at):
        left = lens[at] - k
        taken = eights[starts[at] + k] & _MASKS[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ taken) * np.uint64(0x9FB21C651E98DF25))
        at, k = at[left > 8], k + 8
    return out


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of a[i : i + width] for every full window."""
    n = len(a) - width + 1
    padded = np.concatenate([a, np.full(-len(a) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    head = np.minimum.accumulate(padded, 1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


class Windows:
    """All windows of a string column: their row, start, anchor, and full fingerprints on demand."""

    def __init__(self, column: pa.Array):
        self.hashes, self.counts = word_hashes(column)
        ends = np.cumsum(self.counts)
        windows = np.maximum(self.counts - WINDOW + 1, 0)
        self.row = np.repeat(np.arange(len(self.counts)), windows)
        self.start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = self.start + (ends - self.counts)[self.row]
        if len(self.at):
            first = np.arange(len(self.hashes) - GRAM + 1)
            grams = mix(ranges(self.hashes, 0xBF58476D1CE4E5B9, first, first + GRAM))
            self.anchor = sliding_min(grams, WINDOW - GRAM + 1)[self.at]
        else:
            self.anchor = np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, number of windows), with runs of the same anchor in a row reduced to one."""
        if not len(self.row):
            return self.row, self.anchor, self.row
        new = np.flatnonzero(np.concatenate([[True], (self.row[1:] != self.row[:-1]) | (self.anchor[1:] != self.anchor[:-1])]))
        return self.row[new], self.anchor[new], np.diff(np.append(new, len(self.row)))

    def fingerprints(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[some]
        one = mix(ranges(self.hashes, 0x94D049BB133111EB, at, at + WINDOW))
        two = mix(ranges(self.hashes, 0x2545F4914F6CDD1D, at, at + WINDOW))
        return one.view(np.int64), (two >> np.uint64(33)).astype(np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, doc_id and windows (how many in a row have the anchor) of every document that has an id."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                row, anchor, n = Windows(piece.column(1)).anchors()
                yield pa.record_batch([pa.array(anchor.view(np.int64)), piece.column(0).take(pa.array(row)), pa.array(n.astype(np.int32))], ["anchor", "doc_id", "windows"])

    return _texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, doc_id long, windows int")


WINDOWS = "one long, two int, salt int, doc_id long, version int, start int"


def _window_batch(piece: pa.RecordBatch, w: Windows, some: np.ndarray, salts: np.ndarray) -> pa.RecordBatch:
    """Rows of some windows. ``salts``: into how many parts each one's anchor is cut; -1 marks the uncut.

    Parts go by document and start, so copies of a text and repeats within one are spread alike.
    """
    one, two = w.fingerprints(some)
    versions = np.array([zlib.crc32(t.encode()) for t in piece.column(1).to_pylist()], np.uint32).view(np.int32)
    row = w.row[some]
    ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    place = mix(ids[row] * np.uint64(_ODD) + w.start[some].astype(np.uint64))
    salt = np.where(salts > 1, (place % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64), -1)
    return pa.record_batch(
        [pa.array(one), pa.array(two), pa.array(salt.astype(np.int32)), piece.column(0).take(pa.array(row)), pa.array(versions[row]), pa.array(w.start[some].astype(np.int32))],
        ["one", "two", "salt", "doc_id", "version", "start"],
    )


def shared_windows(docs: DataFrame, shared: DataFrame, places: DataFrame) -> DataFrame:
    """Fingerprints of all windows whose anchor is in ``shared`` (columns anchor and n, its windows).

    ``places`` (anchor, doc_id) tells which documents have which anchors; it is used only when
    there are too many shared anchors to broadcast.
    """
    texts = _texts(docs).where("doc_id IS NOT NULL")
    shared = shared.select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    if shared.count() <= BROADCAST_ANCHORS:
        table = shared.toArrow()
        order = np.argsort(table.column(0).to_numpy())
        known = docs.sparkSession.sparkContext.broadcast((table.column(0).to_numpy()[order], table.column(1).to_numpy()[order]))

        def run(batches):
            own, salts = known.value
            for batch in batches:
                for piece in pieces(batch):
                    w = Windows(piece.column(1))
                    if not len(own):
                        continue
                    found = np.minimum(np.searchsorted(own, w.anchor.view(np.int64)), len(own) - 1)
                    some = np.flatnonzero(own[found] == w.anchor.view(np.int64))
                    yield _window_batch(piece, w, some, salts[found[some]])

        return texts.mapInArrow(run, WINDOWS)

    def run_joined(batches):
        for batch in batches:
            for piece in pieces(batch):
                w = Windows(piece.column(1))
                listed = piece.column(2)
                lens = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
                flat = listed.flatten()
                anchor, salts = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                # a document's windows look for their anchor among its own: pairs of row and anchor, sorted
                names, code = np.unique(anchor, return_inverse=True)
                pair = np.repeat(np.arange(len(lens)), lens) * len(names) + code
                order = np.argsort(pair)
                own = w.anchor.view(np.int64)
                found = np.minimum(np.searchsorted(names, own), len(names) - 1)
                wanted = w.row * len(names) + found
                place = np.minimum(np.searchsorted(pair[order], wanted), len(pair) - 1)
                some = np.flatnonzero((names[found] == own) & (pair[order][place] == wanted))
                yield _window_batch(piece, w, some, salts[order][place[some]])

    by_doc = places.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "salts")).alias("anchors"))
    return texts.join(by_doc, "doc_id").select("doc_id", "text", "anchors").mapInArrow(run_joined, WINDOWS)


def _by_window(windows: DataFrame) -> DataFrame:
    """Windows in a table bucketed by fingerprint: one shuffle serves both the aggregation and the join after it."""
    spark = windows.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, "windows")
    name = "windows_" + path[-12:]
    key = ("one", "two", "salt")
    windows.repartition(n, *key).write.format("parquet").option("path", path).bucketBy(n, *key).sortBy(*key).saveAsTable(name)
    return spark.table(name)


class FingerprintIndex:
    """Runs of anchors under ``path``, each a table bucketed and sorted by anchor.

    ``buckets`` must stay the same over an index's life; at 100 TB use some thousands.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        jvm = spark.sparkContext._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Names of complete runs, oldest first."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if n.startswith("run-") and self._files.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def _table(self, run: str) -> str:
        name = re.sub(r"\W", "_", f"{self.path}/{run}")[-60:].strip("_")
        name = f"anchors_{zlib.crc32(self.path.encode()):08x}_{name}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (anchor BIGINT, doc_id BIGINT, windows INT) USING parquet"
            f" CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
        )
        return name

    def read(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def _write(self, rows: DataFrame, run: str) -> None:
        (
            rows.repartition(self.buckets, "anchor").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(self._table(run))
        )

    def append(self, docs: DataFrame) -> str:
        """Make a batch's anchors a new run."""
        run = f"run-{self._next()}-0"
        self._write(anchors(docs), run)
        return run

    def _next(self) -> str:
        runs = self.runs()
        return f"{int(runs[-1].split('-')[1]) + 1 if runs else 0:06d}"

    def shared(self, run: str) -> DataFrame:
        """Anchors of ``run`` that some other document has too, there or in an earlier run, with their windows (n)."""
        bounds = lambda r: self.read(r).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("windows").alias("n"))
        out = bounds(run)
        for other in self.runs():
            if other < run:
                old = bounds(other).select("anchor", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"), F.col("n").alias("old_n"))
                out = out.join(old.hint("merge"), "anchor", "left").select("anchor", F.least("lo", "old_lo").alias("lo"), F.greatest("hi", "old_hi").alias("hi"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"))
        return out.where("lo < hi").select("anchor", "n")

    def places(self, shared: DataFrame, runs: list[str]) -> DataFrame | None:
        """anchor and doc_id of the rows of some runs whose anchor is in ``shared``: a merge join run by run."""
        out = None
        for run in runs:
            # a union of bucketed scans must not pass for a bucketed scan, so each is joined alone
            part = self.read(run).join(shared.select("anchor").hint("merge"), "anchor", "left_semi").select("anchor", "doc_id")
            out = part if out is None else out.unionByName(part)
        return out

    def compact(self) -> None:
        """Merge the runs of every level that has FANOUT of them into one of the next level."""
        while True:
            levels: dict[int, list[str]] = {}
            for run in self.runs():
                levels.setdefault(int(run.split("-")[2]), []).append(run)
            full = [(level, runs) for level, runs in sorted(levels.items()) if len(runs) >= FANOUT]
            if not full:
                return
            level, runs = full[0]
            merged = self.read(runs[0])
            for run in runs[1:]:
                merged = merged.unionByName(self.read(run))
            self._write(merged, f"run-{self._next()}-{level + 1}")
            for run in runs:
                self.spark.sql(f"DROP TABLE {self._table(run)}")
                self._files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}"), True)


def duplicates(batch: DataFrame, index: FingerprintIndex, history: DataFrame | None = None) -> DataFrame:
    """Window starts to remove from the batch: doc_id, version (checksum of the text) and starts.

    The batch is appended to the index. ``history`` has the documents of earlier batches; only those
    that share an anchor with the batch are fingerprinted.
    """
    run = index.append(batch)
    shared = materialise(index.shared(run), "shared-anchors")
    windows = shared_windows(batch, shared, index.places(shared, [run])).withColumn("fresh", F.lit(True))
    older = [r for r in index.runs() if r < run]
    if history is not None and older:
        places = materialise(index.places(shared, older), "old-places")
        met = materialise(places.select(F.col("doc_id").alias("met")).distinct(), "history-documents")
        side = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
        some = history.join(side, history["doc_id"].cast("long") == met["met"], "left_semi")
        windows = windows.unionByName(shared_windows(some, shared, places).withColumn("fresh", F.lit(False)))
    windows = _by_window(windows)
    first = windows.groupBy("one", "two", "salt").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # windows of common anchors are cut into parts: the parts' bounds meet in a second, small aggregation and go
    # back to every part, so the windows themselves stay in their buckets
    parts = first.where("salt >= 0")
    cut = parts.groupBy("one", "two").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").drop("most")
    cut = parts.select("one", "two", "salt").join(cut, ["one", "two"])
    whole = first.where("salt < 0 AND least < most")
    fresh = windows.where("fresh")
    found = fresh.where("salt < 0").join(whole.drop("most"), ["one", "two", "salt"]).select("doc_id", "version", "start", "least")
    found = found.unionByName(fresh.where("salt >= 0").join(cut, ["one", "two", "salt"]).select("doc_id", "version", "start", "least")).where("doc_id > least")
    found = found.groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"))
    index.compact()
    return found


def removals(batch: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by blanks) of every row of the batch."""
    found = materialise(found, "removals").select(F.col("doc_id"), F.col("version").alias("own"), "starts")
    n, starts = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    small = n <= BROADCAST_DOCUMENTS and starts <= BROADCAST_STARTS

    def run(batches):
        for b in batches:
            for piece in pieces(b):
                n_words, n_removed, kept = [], [], []
                for text, starts in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    words = _WORD.findall(text)
                    n_words.append(len(words))
                    if starts:
                        delta = np.zeros(len(words) + 1, np.int64)
                        np.add.at(delta, starts, 1)
                        np.add.at(delta, np.array(starts) + WINDOW, -1)
                        stay = np.cumsum(delta[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(" ".join(words))
                yield pa.record_batch([piece.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = _texts(batch).withColumn("version", F.crc32(F.encode("text", "UTF-8")))
    signed = F.when(F.col("version") >= 2**31, F.col("version") - 2**32).otherwise(F.col("version")).cast("int")
    rows = rows.withColumn("version", signed)
    side = F.broadcast(found) if small else found
    joined = rows.join(side.withColumnRenamed("own", "version"), ["doc_id", "version"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup(batch: DataFrame, index: FingerprintIndex, history: DataFrame | None = None) -> DataFrame:
    """``duplicates`` and ``removals`` of one batch."""
    return removals(batch, duplicates(batch, index, history))


def report(docs: DataFrame, index: FingerprintIndex, batches: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of a whole table, taken in by ascending ids in some batches."""
    out, history = None, None
    for own in batches_of(docs, batches):
        part = duplicates(own, index, history)
        out = part if out is None else out.unionByName(part)
        history = own if history is None else history.unionByName(own)
    done = removals(docs, out)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
