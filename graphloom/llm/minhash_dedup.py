"""Near-duplicate detection with a MinHash LSH forest and exact confirmation.

A document's set holds its distinct shingles of some words. Documents of equal sets form a class and
go on as one. The forest has ``TREES`` sorted orders of the signatures: tree t sorts by the values of
its own ``DEPTH`` positions, then by those of tree t + 1, and so on round the whole signature. Documents
that share the first ``DEPTH`` values of an order are a region of that tree.

Candidates are neighbours by longest common prefix. Within a region the members lie in the tree's order;
neighbours whose common prefix reaches ``DEEP`` values are chained at once, and the chains are compared
outwards from pivots at the base depth. A region of more than ``BLOCK`` members is dense and is searched
deeper: its members are compared with a few pivots, those close to one leave the region, and what is left is
cut by further values, ``DEPTH`` at a time, of the later trees in which it is left in a dense region too (whoever
shares a sparse region with it meets it there), until all regions are small. Sparse regions thus stay at the
base depth and dense ones go as deep as they must.

Documents that look similar end in one coarse cluster, so the clusters are a superset of all true links.
Each is then settled on the full sets. A cluster that fits one task (``BLOCK`` members and ``SHINGLES``
shingles) is settled there. A larger one is settled by a prefix-filter join: a set's shingles are ordered by how
rare they are in the cluster, linked sets share some of their rarest, and pairs that share as many as a link needs are
compared on the full sets. What shingles many members share is first tied together by a few of them, so near copies of one text are
not listed as pairs; only members that still lie in different components meet in the end.

Chance of missing a link of similarity s: (1 - s**DEPTH)**TREES, 1e-7 at 0.8 and far less above. Shingles
are compared by 64-bit hashes of their words' hashes, which are taken eight bytes at a time through a
multiplication and a shift each, so sums of powers that agree for unlike words do not fool them.

Defined cases: A-Z count as a-z; words are runs of anything but space, tab, line feed, vertical tab,
form feed and carriage return; a text of fewer words than a shingle has its whole sequence as its
one shingle; null and empty texts have an empty set and link with nothing; texts may be of any length;
repeated rows of an id give repeated results (rows of one id with unlike texts too: their links are
united); a row without ``doc_id`` is its own component, null, and kept; of a component the smallest id
stays; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import pieces
from graphloom.llm.components import connected
from graphloom.llm.shared import materialise, text_or_empty
from graphloom.llm.substring_dedup import mix, word_hashes

TREES, DEPTH = 40, 5
#: Equal leading values (of a tree's order) that chain neighbours: about as likely by chance as a 40-fold
#: coincidence, so chained documents are more than 0.9 similar as a rule, and never less than coarsely so.
DEEP = 40
#: Members of a region or cluster, and shingles of a cluster, that one task takes at a time.
BLOCK, SHINGLES = 4000, 4_000_000
#: Pivots of a dense region in a round; share of equal values at which a member counts as close to a pivot
#: and leaves, and at which it is linked with it. A document similar to one that left is within 0.37 + 0.2 of
#: the pivot, four standard deviations allowed, and 0.3 lies another four below that.
PIVOTS, CLOSE, FAR = 32, 0.75, 0.3
#: Members of a large cluster's most common rare shingle that are compared with the others in the first round.
PIVOT_ROWS = 8
#: At most so many cluster members (some 40 bytes each) are broadcast to pick texts; more are joined by shuffle.
BROADCAST_MEMBERS = 1_000_000
_VALUES = TREES * DEPTH
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 2**32, _VALUES, dtype=np.uint32)
_ODD = _RNG.integers(0, 2**32, _VALUES, dtype=np.uint32) | np.uint32(1)


def loose(percent: int) -> float:
    """The share of equal signature values below which a pair is unlike: six standard deviations below its expectation."""
    s = percent / 100
    least = s - 6 * math.sqrt(s * (1 - s) / _VALUES)
    return least + (1 - least) / 256  # a value is kept in one byte, equal by chance in one of 256


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, sorted by both."""
    hashes, counts = word_hashes(column, lower=True)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    own = hashes * np.uint64(0xA24BAED4963EE407) + np.uint64(1)
    total = np.zeros(len(hashes), np.uint64)
    sizes = np.minimum(counts, words)[row]
    left = ends[row] - np.arange(len(hashes))
    # the shingle that starts at each word; shorter texts have theirs at the first word
    for k in range(words):
        reach = (k < sizes) & (k < left)
        at = np.flatnonzero(reach)
        total[at] = mix(total[at] + np.uint64(k + 1)) * np.uint64(0x9FB21C651E98DF25) + own[at + k]
    full = left >= sizes
    row, value = row[full], mix(total[full])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _signatures(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Least permuted hashes, one row per document (zero where the set is empty)."""
    out = np.zeros((n, _VALUES), np.uint32)
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        small = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(_VALUES):
            out[row[starts], k] = np.minimum.reduceat((small ^ _XOR[k]) * _ODD[k], starts)
    return out


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit checksum of the set, the trees' prefixes and the signature."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                n = piece.num_rows
                row, value = shingles(piece.column(1), words)
                sizes = np.bincount(row, minlength=n)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                sums = np.zeros((n, 2), np.uint64)
                if len(full):
                    sums[full, 0] = np.add.reduceat(mix(value), starts)
                    sums[full, 1] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
                signature = _signatures(row, value, n)
                keys = np.zeros((n, TREES), np.uint64)
                for t in range(TREES):
                    key = np.full(n, t, np.uint64)
                    for k in range(DEPTH):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, t * DEPTH + k])
                    keys[:, t] = key
                yield pa.record_batch(
                    [
                        piece.column(0), pa.array(sizes, pa.int64()), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, n * TREES + 1, TREES, dtype=np.int32), pa.array(keys.ravel().view(np.int64))),
                        pa.array([s.tobytes() for s in (signature >> np.uint32(8)).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "sum1", "sum2", "prefixes", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, sum1 long, sum2 long, prefixes array<bigint>, signature binary")


def forest(n: int, alike, chain: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (by position) that connect whatever ``alike`` connects among n members.

    ``alike(i, rest)`` tells which of some members are linked with i. Members that are found leave the
    search, and each of them becomes a pivot for those that remain, so a tight group takes one pass.
    ``chain`` numbers stretches of members that are known to be linked with their neighbours.
    """
    chain = np.arange(n) if chain is None else chain
    near = np.flatnonzero(chain[1:] == chain[:-1])
    out, rest = list(zip(near.tolist(), (near + 1).tolist(), strict=True)), np.arange(n)
    queue: list[int] = []
    while len(rest):
        i = queue.pop() if queue else int(rest[0])
        new = rest[alike(i, rest)]
        out += [(i, int(j)) for j in new if j != i]
        # with every member found its whole chain leaves the search
        leave = np.isin(chain[rest], chain[np.append(new, i)])
        queue += [int(j) for j in rest[leave] if j != i]
        rest = rest[~leave]
    return out


def common_prefixes(signatures: np.ndarray) -> np.ndarray:
    """How many leading values each row of sorted signatures shares with the next one."""
    unlike = signatures[1:] != signatures[:-1]
    return np.where(unlike.any(1), unlike.argmax(1), signatures.shape[1])


def _runs(batches, columns: int):
    """Groups of rows that agree on the first columns, from a sorted stream; lists of later columns."""
    key, held = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:columns] != key:
                if held and len(held) > 1:
                    yield key, held
                key, held = row[:columns], []
            held.append(row[columns:])
    if held and len(held) > 1:
        yield key, held


LINKS = "a long, b long"


def _links(found) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _coarse(least: float):
    """Links within small regions; rows are region, tree, doc_id, signature."""

    def run(batches):
        for (_, tree), group in _runs(batches, 2):
            # the tree's own order: its values first, then those of the trees that follow
            first = tree * DEPTH
            rolled = sorted((r[1][first:] + r[1][:first], r[0]) for r in group)
            ids = [doc for _, doc in rolled]
            s = np.frombuffer(b"".join(own for own, _ in rolled), np.uint8).reshape(len(ids), -1)
            chain = np.concatenate([[0], np.cumsum(common_prefixes(s) < DEEP)])

            def alike(i, rest, s=s):
                return (s[rest] == s[i]).mean(1) >= least

            yield _links([(ids[i], ids[j]) for i, j in forest(len(ids), alike, chain)])

    return run


def _dealt(rows: DataFrame, key: str, pivots: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of large groups in parts of a bounded size, each part led by its group's pivots.

    ``parts`` has the key and how many parts there are; ``rows`` and ``pivots`` have the same columns.
    """
    columns = [c for c in rows.columns if c != key]
    members = rows.join(parts, key).select(key, F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"), *columns)
    leaders = pivots.join(parts, key).select(key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), *columns)
    return members.unionByName(leaders).repartition(key, "part").sortWithinPartitions(key, "part", "place", "doc_id")


def _near_pivots(batches):
    """For members of dense regions, the pivots that look similar, and whether one is very close; rows are region, part, place, tree, doc_id, signature."""
    key, names, pivots = None, [], []
    matrix = None
    for batch in batches:
        out = []
        for region, part, place, tree, doc, signature in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (region, part) != key:
                key, names, pivots, matrix = (region, part), [], [], None
            own = np.frombuffer(signature, np.uint8)
            if place == 0:
                names.append(doc)
                pivots.append(own)
                continue
            if not names:
                out.append((region, tree, doc, [], False))
                continue
            matrix = np.stack(pivots) if matrix is None else matrix
            share = (matrix == own).mean(1)
            out.append((region, tree, doc, [names[i] for i in np.flatnonzero(share >= FAR)], bool(share.max() >= CLOSE)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["region", "tree", "doc_id", "pivots", "close"])


def _few(rows: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """About ``k`` rows of each key (one at least), those with the least hashes of ids; ``n`` is a column with their number."""
    # a threshold by number first, so no task ranks a large group
    place = F.xxhash64(F.lit(key), "doc_id")
    limit = F.when(F.col(n) <= 4 * k, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * (4.0 * k) / F.col(n)).cast("long"))
    ranked = rows.where(place <= limit).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(place, "doc_id")))
    return ranked.where(F.col("rank") <= k).drop("rank")


def _candidates(firsts: DataFrame, percent: int) -> DataFrame:
    """Coarse links (a, b) among documents (doc_id, prefixes, signature)."""
    keys = firsts.select("doc_id", F.posexplode("prefixes").alias("tree", "region"))
    found, base = None, None
    while True:
        sizes = materialise(keys.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "regions")
        signed = keys.join(sizes, "region").join(firsts.select("doc_id", "signature"), "doc_id").select("region", "tree", "doc_id", "signature", "n")
        small = signed.where(F.col("n") <= BLOCK).drop("n").repartition("region").sortWithinPartitions("region", "tree", "doc_id")
        links = small.mapInArrow(_coarse(loose(percent)), LINKS)
        found = links if found is None else found.unionByName(links)
        if sizes.where(F.col("n") > BLOCK).isEmpty():
            return found
        dense = materialise(signed.where(F.col("n") > BLOCK), "dense-regions")
        pivots = _few(dense, "region", "n", PIVOTS).drop("n")
        parts = sizes.where(F.col("n") > BLOCK).select("region", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
        met = materialise(_dealt(dense.drop("n"), "region", pivots, parts).mapInArrow(_near_pivots, "region long, tree int, doc_id long, pivots array<bigint>, close boolean"), "near-pivots")
        found = found.unionByName(met.select(F.col("doc_id").alias("a"), F.explode("pivots").alias("b")).where("a <> b"))
        left = met.where("NOT close").select("doc_id", "tree", "region")
        # trees rise from level to level, so there is an end to it
        base = left if base is None else base
        deeper = left.join(base.select("doc_id", F.col("tree").alias("later"), F.col("region").alias("more")), "doc_id").where("later > tree")
        keys = materialise(deeper.select("doc_id", F.col("later").alias("tree"), F.xxhash64("region", "more").alias("region")), "deeper")


class _Sets:
    """Distinct shingles of some texts, for counting what others share with one of them."""

    def __init__(self, column: pa.Array, words: int, percent: int):
        self.percent = percent
        row, value = shingles(column, words)
        self.sizes = np.bincount(row, minlength=len(column))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.value = value

    def own(self, i: int) -> np.ndarray:
        return self.value[self.starts[i] : self.starts[i] + self.sizes[i]]

    def fitting(self, size: int, rest: np.ndarray) -> np.ndarray:
        """Which sets have a size that can be similar enough."""
        return (self.sizes[rest] * 100 >= size * self.percent) & (size * 100 >= self.sizes[rest] * self.percent)

    def linked(self, other: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Which of some members are linked with a sorted set of shingles."""
        out = np.zeros(len(rest), bool)
        fit = self.fitting(len(other), rest)
        some = rest[fit]
        if len(some) and len(other):
            lens = self.sizes[some]
            ends = np.cumsum(lens)
            flat = self.value[np.repeat(self.starts[some] - (ends - lens), lens) + np.arange(ends[-1])]
            at = np.minimum(np.searchsorted(other, flat), len(other) - 1)
            both = np.add.reduceat((other[at] == flat).astype(np.int64), ends - lens)
            out[fit] = 100 * both >= self.percent * (lens + len(other) - both)
        return out


def _exact(words: int, percent: int):
    """All links of small clusters; rows are component, doc_id, text."""

    def run(batches):
        for _, group in _runs(batches, 1):
            ids = [r[0] for r in group]
            sets = _Sets(pa.array([r[1] for r in group], pa.large_string()), words, percent)
            yield _links([(ids[i], ids[j]) for i, j in forest(len(ids), lambda i, rest, sets=sets: sets.linked(sets.own(i), rest))])

    return run


def _shingle_lists(words: int):
    """The sets of large clusters; rows are component, doc_id, text."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 2):
                row, value = shingles(piece.column(2), words)
                sizes = np.bincount(row, minlength=piece.num_rows)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))], ["component", "doc_id", "n", "shingles"])

    return run


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """component, token, key, doc_id, n and size of prefix for the rarest shingles of every set, without those that no other set of the cluster has.

    Two linked sets share at least one shingle of their prefixes, which are as long as the shingles that a set may lack in
    a smaller partner, and one more.
    """
    posted = sets.select("component", "key", "doc_id", "n", F.explode("shingles").alias("token"))
    held = posted.groupBy("component", "token").agg(F.count(F.lit(1)).alias("held"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = posted.join(held, ["component", "token"]).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("held", "token")))
    return ranked.withColumn("first", first).where("rank <= first AND held > 1").select("component", "token", "key", "doc_id", "n", "first")


def _settled(large: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the large clusters' members as their full sets do; ``large`` has component, doc_id and text.

    A prefix-filter join: members meet where they share a rare shingle, and whoever shares as many as links need is compared
    on the full sets. Before all such pairs are made, a few members (some ``PIVOT_ROWS`` of the most common shingle, then eight times
    as many, and so on up to all) are compared with the rest, and only shingles that still lie in several components go on. A
    tight group of any size is thus tied together by a few members, and whatever is not is compared in full.
    """
    sets = large.select("component", "doc_id", "text").mapInArrow(_shingle_lists(words), "component long, doc_id long, n long, shingles array<bigint>")
    # rows of one id with unlike texts are sets of their own
    sets = materialise(sets.withColumn("key", F.xxhash64("doc_id", F.xxhash64("shingles"))).dropDuplicates(["key"]), "cluster-sets")
    prefixes = materialise(_prefixes(sets, percent), "prefixes")
    most = prefixes.groupBy("component", "token").count().agg(F.max("count")).first()[0]
    links = sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false")
    share = min(1.0, PIVOT_ROWS / most) if most else 0.0
    rows = prefixes.withColumn("own", F.col("doc_id"))
    while share:
        pivot = F.xxhash64("key", F.lit(7)) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
        rows = rows.withColumn("pivot", pivot)
        sides = [rows.select("component", "token", *[F.col(c).alias(c + x) for c in ("key", "doc_id", "n", "first", "own", "pivot")]) for x in "ab"]
        fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
        once = ~F.col("pivotb") | (F.col("keya") < F.col("keyb"))
        met = sides[0].where("pivota").join(sides[1], ["component", "token"]).where(fits & once & (F.col("owna") != F.col("ownb")))
        least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
        need = F.least(F.col("firsta") - F.col("na"), F.col("firstb") - F.col("nb")) + least
        pairs = met.groupBy("keya", "keyb", "doc_ida", "doc_idb", "na", "nb", need.alias("need")).agg(F.count(F.lit(1)).alias("have")).where("have >= need")
        whole = pairs.join(sets.select(F.col("key").alias("keya"), F.col("shingles").alias("sa")), "keya").join(sets.select(F.col("key").alias("keyb"), F.col("shingles").alias("sb")), "keyb")
        both = F.size(F.array_intersect("sa", "sb"))
        links = links.unionByName(materialise(whole.where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")), "prefix-links"))
        if share >= 1:
            break
        share = min(1.0, share * 8)
        joined = materialise(connected(links), "joined").select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
        rows = prefixes.join(joined, "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id"))
        mixed = rows.groupBy("component", "token").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("component", "token")
        rows = materialise(rows.join(mixed, ["component", "token"], "left_semi"), "open-prefixes")
        if rows.isEmpty():
            break
    return links


def components(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sketch = materialise(_sketch(docs, words), "sketches")
    alive = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "sum1", "sum2"]
    classes = alive.groupBy(*same).agg(F.min("doc_id").alias("first"))
    # one member of each class goes on; rows that repeat an id are one
    firsts = alive.join(classes.select(F.col("first").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id"])
    firsts = materialise(firsts.select("doc_id", "n_shingles", "prefixes", "signature"), "classes")
    clusters = materialise(connected(_candidates(firsts.drop("n_shingles"), percent)), "clusters").withColumnRenamed("node", "doc_id")
    clusters = materialise(clusters.join(firsts.select("doc_id", "n_shingles"), "doc_id"), "cluster-members")
    sizes = materialise(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")), "cluster-sizes")
    is_large = (F.col("n") > BLOCK) | (F.col("shingles") > SHINGLES)
    dealt = clusters.join(sizes.select("component", is_large.alias("large")), "component")
    if clusters.count() <= BROADCAST_MEMBERS:
        # few documents have a near copy: their texts are picked in the scan, and the others stay where they are
        dealt = F.broadcast(dealt)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    texts = dealt.join(texts, "doc_id").select("component", "doc_id", "n_shingles", "large", "text")
    found = texts.where("NOT large").select("component", "doc_id", "text").repartition("component").sortWithinPartitions("component", "doc_id").mapInArrow(_exact(words, percent), LINKS)
    if not sizes.where(is_large).isEmpty():
        large = materialise(texts.where("large").drop("large"), "large-clusters")
        found = found.unionByName(_settled(large, words, percent))
    exact = materialise(connected(found), "components")
    of_class = classes.join(exact.withColumnRenamed("node", "first"), "first", "left").select(*same, F.coalesce("component", "first").alias("component"))
    out = sketch.select("doc_id", *same).join(of_class, same, "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns."""
    gone = materialise(components(docs, words, percent).where("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
