"""Token-id files with directly addressable codes.

The ids of a segment are cut into chunks of eight bits. Level k holds the k-th chunk of every id
that has one, and a bitmap tells which of the level's entries continue on the next level. A rank
directory counts the set bits before every 512-bit block, so the place of a token's next chunk is a
directory entry plus the set bits of less than a block: any token is read without decoding others.

A token file is a folder with ``segments`` (Parquet: part, first, doc_ids, n_tokens, payload),
written by Spark's own committer, so lost executors and retried tasks leave whole files. Documents
lie in ascending ``doc_id`` order (null ids first, repeated ids by text): parts in order, segments
by ``first``, the token position within the part. A part's start is the sum of the parts before it.

Defined cases: a null text counts as empty and has just its end id; a document's ids are never cut
between segments; empty tables give a folder without segments and empty results.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.shared import text_or_empty

END = 0
#: A segment is closed once it has so many tokens.
SEGMENT_TOKENS = 1 << 17
#: Bits of a rank directory's block.
BLOCK = 512
MAGIC = b"DACW"
SEGMENTS = "part int, first long, doc_ids array<bigint>, n_tokens array<bigint>, total long, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of non-negative ids below 2**32.

    Layout, little-endian: MAGIC, number of levels, then for each level its number of entries, the
    chunks, the continuation bitmap (bit i of byte i // 8, lowest first, padded to whole blocks) and
    one count for every block.
    """
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        chunk, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        blocks = -(-len(chunk) // BLOCK)
        bits = np.zeros(blocks * BLOCK, np.uint8)
        bits[: len(chunk)] = more
        ones = bits.reshape(blocks, BLOCK).sum(1, dtype=np.uint32)
        levels.append(struct.pack("<I", len(chunk)) + chunk.tobytes() + np.packbits(bits, bitorder="little").tobytes() + (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        rest = rest[more]
        if not len(rest):
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Reader:
    """Random access to a packed sequence."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        (n,), at = struct.unpack_from("<I", payload, 4), 8
        self.levels = []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", payload, at)
            blocks = -(-size // BLOCK)
            chunk = np.frombuffer(payload, np.uint8, size, at + 4)
            bitmap = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at + 4 + size)
            at += 4 + size + len(bitmap)
            self.levels.append((chunk, bitmap, np.frombuffer(payload, "<u4", blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places) -> np.ndarray:
        """The ids at some places, by rank directory."""
        place = np.asarray(places, np.int64)
        if len(place) and (place.min() < 0 or place.max() >= len(self)):
            raise IndexError("token position out of range")
        out = np.zeros(len(place), np.uint32)
        who = np.arange(len(place))
        for k, (chunk, bitmap, rank) in enumerate(self.levels):
            out[who] |= chunk[place].astype(np.uint32) << np.uint32(8 * k)
            go = ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
            who, place = who[go], place[go]
            if not len(who):
                break
            block = place // BLOCK
            rows = np.unpackbits(bitmap.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
            before = (rows * (np.arange(BLOCK) < (place % BLOCK)[:, None])).sum(1, dtype=np.int64)
            place = rank[block].astype(np.int64) + before
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, who = np.zeros(len(self), np.uint32), None
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            piece = chunk.astype(np.uint32) << np.uint32(8 * k)
            if who is None:
                out, who = piece, np.arange(len(piece))
            else:
                out[who] |= piece
            who = who[np.unpackbits(bitmap, bitorder="little")[: len(chunk)].astype(bool)]
        return out


def write(docs: DataFrame, tokenizer: str, path: str, parts: int | None = None) -> None:
    """Encode every text, append the end id, and write token files in ascending doc_id order.

    The range shuffle moves texts, which are smaller than their ids; each task then streams its
    range through one open segment at a time.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        codec, part, first = bpe.codec(tokenizer), TaskContext.get().partitionId(), 0
        names, sizes, ids, held = [], [], [], 0

        def segment():
            data = np.concatenate(ids)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([pack(data)], pa.binary())],
                ["part", "first", "doc_ids", "n_tokens", "total", "payload"],
            )

        for batch in batches:
            for piece in bpe.pieces(batch):
                flat, counts = codec.encode(piece.column(1).to_pylist())
                ends = np.cumsum(counts)
                flat, counts = np.insert(flat, ends, END), counts + 1
                ends = ends + np.arange(1, len(counts) + 1)
                for name, n, end in zip(piece.column(0).to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                    names.append(name)
                    sizes.append(n)
                    ids.append(flat[end - n : end])
                    held += n
                    if held >= SEGMENT_TOKENS:
                        yield segment()
                        first += held
                        names, sizes, ids, held = [], [], [], 0
        if held:
            yield segment()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # rows that share an id, or have none, are dealt by a hash of their text
    texts = texts.withColumn("spread", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text")
    texts.select("doc_id", "text").mapInArrow(run, SEGMENTS).write.mode("errorifexists").option("compression", "none").parquet(f"{path}/segments")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """part and base: the tokens in all parts before it. One row per part, whatever the corpus' size."""
    totals = _segments(spark, path).groupBy("part").agg(F.sum("total").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens and ids_crc32 of each document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Reader(row["payload"]).all().astype("<u4")
                sizes = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                data = memoryview(ids.tobytes())
                yield pa.record_batch(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["first"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = _segments(spark, path).join(F.broadcast(_starts(spark, path)), "part").select("base", "first", "doc_ids", "n_tokens", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """position and id for every row of ``places`` (column position: global token position).

    Positions meet segments by an equi-join on position // SEGMENT_TOKENS, listing for each segment
    the few keys that it touches; each segment met is opened once and only asked for its positions.
    Positions beyond the end have no row.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["payload"])
                yield pa.record_batch([pa.array(row["positions"], pa.int64()), pa.array(reader.at(np.array(row["positions"]) - row["start"]), pa.int64())], ["position", "id"])

    spans = _segments(spark, path).drop("payload", "doc_ids", "n_tokens").join(F.broadcast(_starts(spark, path)), "part").select("part", "first", (F.col("base") + F.col("first")).alias("start"), "total")
    width = F.lit(SEGMENT_TOKENS)
    keyed = spans.withColumn("key", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("total") - 1) / width))))
    asked = places.select(F.col("position").cast("long")).where("position >= 0").withColumn("key", F.floor(F.col("position") / width))
    met = asked.join(keyed, "key").where("position >= start AND position < start + total").groupBy("part", "first", "start").agg(F.collect_list("position").alias("positions"))
    return met.join(_segments(spark, path).select("part", "first", "payload"), ["part", "first"]).select("start", "positions", "payload").mapInArrow(run, "position long, id long")
