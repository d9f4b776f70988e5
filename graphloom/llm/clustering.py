"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Every vector keeps an upper bound of the distance to its own centroid, a lower bound for each of its several next
nearest centroids, and one remainder bound for all others. When centroids move, the upper bound grows by the own
centroid's drift, a tracked bound shrinks by its centroid's drift, and the remainder by the largest one. The order
of a vector's centroids is certified as far as needed: if the upper bound (then, the exact distance) lies below all lower bounds, the vector
stays; if it lies below all but the first j tracked ones, only those are measured; otherwise all centroids are
measured and the bounds made anew. Bounds are compared strictly and with a margin for rounding, and whatever is measured
is measured in integers, so assignments and ties are those of measuring everything. The number of tracked
centroids starts at k / 4 and shrinks to what the last round needed, not below k / 8.

Each round is one pass over the table of the round before (no shuffle of vectors), written to the shared folder.
Tasks add up their vectors for each centroid; k rows of sums from each task are merged by Spark, and k centroids come to the driver.

Defined cases: a vector is kept if it has the asked number of components, none null, NaN or infinite (a null vector is
not kept); components become floor(scale * x). Seeds are the kept vectors with the smallest SHA-256 of ``seed:vec_id``;
repeated rows each count, ties by components; rows without ``vec_id`` come last; with fewer vectors than centroids each
vector is a seed. Of equally near centroids the smaller number wins; centroids without vectors stay where they are. An empty table gives an
empty result. Components of 2**27 and more in size (after scaling) raise an error, since squared distances would leave
the range of a long. Columns other than ``vec_id`` and ``embedding`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise

#: Components are smaller than this in size; up to FLOAT, products of vectors are exact in doubles.
LIMIT, FLOAT = 1 << 27, 1 << 21
#: Relative margin of comparisons between bounds.
MARGIN = 1e-9
#: Vectors measured against all centroids at a time.
ROWS = 4096
STATE = "vec_id long, x array<int>, own int, upper double, tracked array<int>, lowers array<double>, rest double, depth int, distance long"


def kept_vectors(rows: DataFrame, components: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and x (integers) of the vectors that are whole."""
    full = F.col("embedding").isNotNull() & (F.size("embedding") == components) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(full, F.lit(False))).select("vec_id", whole.alias("x"))
    fits = F.forall("x", lambda v: F.abs(v) < LIMIT)
    return kept.select("vec_id", F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"components of {LIMIT} and more are too large"))).alias("x"))


def seeds(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The first centroids: k vectors, whatever the table's size."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(h.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in first], np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < FLOAT:
        # every partial sum is below 2**53 for up to 1024 components
        cross = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if x.shape[1] <= 1024 else x @ c.T
        return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * cross
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def _measured(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to its own choice of centroids."""
    return np.stack([((x - c[which[:, j]]) ** 2).sum(1) for j in range(which.shape[1])], 1)


class Bounds:
    """What is known of some vectors: own centroid, upper bound, tracked centroids with lower bounds, remainder."""

    def __init__(self, n: int, tracked: int):
        self.own, self.upper, self.rest = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        self.tracked, self.lowers = np.zeros((n, tracked), np.int32), np.zeros((n, tracked))
        self.depth, self.distance = np.zeros(n, np.int32), np.zeros(n, np.int64)

    def scan(self, x: np.ndarray, c: np.ndarray, rows: np.ndarray) -> None:
        """Measure all centroids for some rows and make their bounds anew."""
        b = self.lowers.shape[1]
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            d = _squared(x[some], c)
            order = np.argsort(d, 1, kind="stable")[:, : b + 2]
            near = np.take_along_axis(d, order, 1)
            self.own[some], self.distance[some], self.upper[some] = order[:, 0], near[:, 0], np.sqrt(near[:, 0])
            self.tracked[some, : order.shape[1] - 1], self.lowers[some] = order[:, 1 : b + 1], np.sqrt(near[:, 1 : b + 1])
            self.rest[some] = np.sqrt(near[:, b + 1]) if near.shape[1] > b + 1 else np.inf
            # depths up to the number of tracked centroids tell how many were needed; beyond them, a full scan
            self.depth[some] = b + 1

    def moved(self, drift: np.ndarray) -> None:
        self.upper += drift[self.own]
        self.lowers -= drift[self.tracked]
        self.rest -= drift.max()

    def keep_tracked(self, b: int) -> None:
        """Track fewer centroids: bounds that are given up go into the remainder."""
        if b < self.lowers.shape[1]:
            self.rest = np.minimum(self.rest, self.lowers[:, b:].min(1))
            self.tracked, self.lowers = self.tracked[:, :b], self.lowers[:, :b]

    def settle(self, x: np.ndarray, c: np.ndarray) -> None:
        """Assign every row, measuring no more centroids than its bounds ask for."""
        b = self.lowers.shape[1]
        # least[:, j]: the least bound of whatever lies beyond the first j tracked centroids
        least = np.minimum.accumulate(np.concatenate([self.lowers, self.rest[:, None]], 1)[:, ::-1], 1)[:, ::-1] * (1 - MARGIN)
        self.depth[:] = 0
        open_rows = np.flatnonzero(~(self.upper * (1 + MARGIN) < least[:, 0]))
        if not len(open_rows):
            return
        self.distance[open_rows] = _measured(x[open_rows], c, self.own[open_rows, None])[:, 0]
        self.upper[open_rows] = np.sqrt(self.distance[open_rows])
        sure = self.upper[open_rows, None] * (1 + MARGIN) < least[open_rows]
        need = np.where(sure.any(1), sure.argmax(1), b + 1)
        for j in range(1, b + 1):
            some = open_rows[need == j]
            if len(some):
                which = np.concatenate([self.own[some, None], self.tracked[some, :j]], 1)
                d = _measured(x[some], c, which)
                order = np.lexsort((which, d), 1)
                which, near = np.take_along_axis(which, order, 1), np.take_along_axis(d, order, 1)
                self.own[some], self.distance[some], self.upper[some] = which[:, 0], near[:, 0], np.sqrt(near[:, 0])
                self.tracked[some, :j], self.lowers[some, :j] = which[:, 1:], np.sqrt(near[:, 1:])
                self.depth[some] = j
        self.scan(x, c, open_rows[need == b + 1])


def _listed(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _arrays(values: np.ndarray, kind) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _assign(rows: DataFrame, components: int, c: np.ndarray, drift: np.ndarray | None, held: int, tracked: int, last: bool) -> DataFrame:
    """One pass: the first (no ``drift``) measures everything, later ones start from the bounds in ``rows``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _listed(batch.column(1), components, np.int64), batch.num_rows
            own = Bounds(n, tracked if drift is None else held)
            if drift is None:
                own.scan(x, c, np.arange(n))
            else:
                own.own, own.upper, own.rest = (batch.column(k).to_numpy().copy() for k in (2, 3, 6))
                own.tracked, own.lowers = _listed(batch.column(4), held, np.int32), _listed(batch.column(5), held, np.float64)
                own.moved(drift)
                own.keep_tracked(tracked)
                own.settle(x, c)
            if last:
                # rows that their bounds certified have not been measured yet
                own.distance = _measured(x, c, own.own[:, None])[:, 0]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(own.own, pa.int32()), pa.array(own.upper), _arrays(own.tracked, pa.int32()), _arrays(own.lowers, pa.float64()),
                    pa.array(own.rest), pa.array(own.depth, pa.int32()), pa.array(own.distance, pa.int64()),
                ],
                ["vec_id", "x", "own", "upper", "tracked", "lowers", "rest", "depth", "distance"],
            )

    return rows.mapInArrow(run, STATE)


def _sums(state: DataFrame, k: int, components: int) -> dict[int, tuple[int, list[int], int]]:
    """For each centroid with vectors: their number, their sum, and the deepest bound that any of them needed. k rows come to the driver."""

    def run(batches):
        n, total, deepest = np.zeros(k, np.int64), np.zeros((k, components), np.int64), np.zeros(k, np.int32)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _listed(batch.column(1), components, np.int64)
            order = np.argsort(own, kind="stable")
            some, first = np.unique(own[order], return_index=True)
            if len(some):
                n[some] += np.bincount(own, minlength=k)[some]
                total[some] += np.add.reduceat(x[order], first, 0)
                np.maximum.at(deepest, own, batch.column(2).to_numpy())
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(deepest[some], pa.int32()), _arrays(total[some], pa.int64())], ["own", "n", "deepest", "total"])

    parts = state.select("own", "x", "depth").mapInArrow(run, "own int, n long, deepest int, total array<bigint>")
    whole = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"t{i}") for i in range(components)]
    rows = parts.groupBy("own").agg(F.sum("n").alias("n"), F.max("deepest").alias("deepest"), *whole).collect()
    return {r["own"]: (r["n"], [int(r[f"t{i}"]) for i in range(components)], r["deepest"]) for r in rows}


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, own, distance) of every kept vector after the last round, and the centroids."""
    vectors = kept_vectors(rows, components, scale)
    c = seeds(vectors, k, seed)
    if not len(c):
        return rows.sparkSession.createDataFrame([], "vec_id long, own int, distance long"), np.zeros((0, components), np.int64)
    k = len(c)
    most, fewest = min(max(1, k // 4), k - 1), min(max(1, k // 8), k - 1)
    state, held, tracked, drift = vectors.withColumns({"own": F.lit(0)}).select("vec_id", "x"), 0, most, None
    for turn in range(rounds + 1):
        state = materialise(_assign(state, components, c, drift, held, tracked, turn == rounds), "clusters")
        held = tracked
        if turn < rounds:
            sums, new = _sums(state, k, components), c.copy()
            for own, (n, total, _) in sums.items():
                new[own] = [t // n for t in total]
            drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
            if turn:
                tracked = max(fewest, min(held, max(d for _, _, d in sums.values())))
            c = new
    return state.select("vec_id", "own", "distance"), c


def report(rows: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    assigned, c = cluster(rows, k, rounds, components, scale, seed)
    digests = [(i, hashlib.sha256(",".join(map(str, one)).encode()).hexdigest()) for i, one in enumerate(c.tolist())]
    names = rows.sparkSession.createDataFrame(digests, "own int, centroid_sha256 string")
    # a row for each centroid
    inertia = assigned.groupBy("own").agg(F.sum("distance").alias("cluster_inertia"))
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    of_cluster = inertia.join(names, "own").join(F.broadcast(whole))
    return assigned.join(F.broadcast(of_cluster), "own").select("vec_id", F.col("own").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
