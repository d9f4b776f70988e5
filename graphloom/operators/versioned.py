"""Databases of triples as a log of immutable runs.

A database is a folder. ``runs/<id>/adds`` and ``runs/<id>/deletes`` are Parquet tables (s, p, o, seq), sorted by
predicate and subject and never changed. ``log/<version>.json`` names the runs that make up a version. A change
writes its run first and then its log file, which is moved into place under a name that must be new: a change that
fails leaves the version before it, and of two changes on one version the second is refused.

A triple is in the store if it has an add with no later delete, so a version is one scan of all add runs,
anti-joined with one scan of all delete runs: the plan does not grow with the number of changes. An added triple is
written only where it is missing, so no reader has to remove copies; the probe for it is limited to the predicates and
the range of subjects of the new rows, which Parquet's statistics turn into few row groups.

Runs are compacted by levels: ``FANOUT`` runs of a level become one of the next, in which deleted adds are
gone; deletes are kept until a compaction reaches the oldest run. A triple is rewritten a logarithmic number of times and a
version has a logarithmic number of runs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import solutions
from graphloom.operators.closure import edges_of, reach
from graphloom.operators.store import SCHEMA, TripleStore
from graphloom.workspace import Folder, written

RUN = "s string, p string, o string, seq long"
TRIPLE = ["s", "p", "o"]
#: Runs of one level that become one of the next.
FANOUT = 4
#: Predicates of new rows that are named in the probe's filter; with more, only their range is.
PREDICATES = 50


class Conflict(RuntimeError):
    """Another change was committed on the version that this one started from."""


class VersionedStore(TripleStore):
    """A ``TripleStore`` whose changes are commits. ``version`` opens an older one, which can be read but not changed."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, prefixes: dict[str, str] | None = None):
        super().__init__(spark, None, prefixes)
        self.folder, self.fixed = Folder(spark, path), version is not None
        self._open(version)

    # -- versions ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Versions that can be opened, oldest first. Version 0 is the empty store."""
        return sorted({0, *(int(n[:-5]) for n in self.folder.names("log") if n.endswith(".json"))})

    def _entry(self, version: int) -> dict:
        return json.loads(self.folder.text(f"log/{version:012d}.json")) if version else {"runs": []}

    def _open(self, version: int | None = None) -> None:
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        self.version = known[-1] if version is None else version
        self.runs = self._entry(self.version)["runs"]
        self.df = self._live(self.runs).select(*TRIPLE)

    def at(self, version: int) -> VersionedStore:
        return VersionedStore(self.spark, self.folder.path, version, self.prefixes)

    def refresh(self) -> VersionedStore:
        """Go on from the latest version."""
        self._open()
        return self

    def history(self) -> DataFrame:
        """version, operation, adds, deletes and the number of runs of every commit in the log."""
        if self.versions() == [0]:
            return self.spark.createDataFrame([], "version long, operation string, adds long, deletes long, runs int")
        run = "array<struct<id:string>>"
        rows = self.spark.read.schema(f"version long, operation string, adds long, deletes long, runs {run}").json(f"{self.folder.path}/log")
        return rows.select("version", "operation", "adds", "deletes", F.size("runs").alias("runs"))

    def changes(self, since: int) -> DataFrame:
        """Triples that the present version has and ``since`` lacks (change ``added``), and the reverse (``removed``)."""
        old, new = self.at(since).df, self.df
        gone = old.join(new, TRIPLE, "left_anti").select(*TRIPLE, F.lit("removed").alias("change"))
        return new.join(old, TRIPLE, "left_anti").select(*TRIPLE, F.lit("added").alias("change")).unionByName(gone)

    # -- runs ----------------------------------------------------------------------------------

    def _rows(self, runs: list[dict], kind: str) -> DataFrame | None:
        paths = [f"{self.folder.path}/runs/{r['id']}/{kind}" for r in runs if r[kind]]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else None

    def _live(self, runs: list[dict]) -> DataFrame:
        adds, gone = self._rows(runs, "adds"), self._rows(runs, "deletes")
        if adds is None:
            return self.spark.createDataFrame([], RUN)
        if gone is None:
            return adds
        later = gone.select(*[F.col(c).alias(f"__{c}") for c in [*TRIPLE, "seq"]])
        same = [F.col(c) == F.col(f"__{c}") for c in TRIPLE]
        return adds.join(later, [*same, F.col("__seq") > F.col("seq")], "left_anti")

    def _run(self, seq: int, level: int, adds: DataFrame | None, deletes: DataFrame | None) -> dict:
        """Write a run; what it says counts only once a log file names it."""
        run = {"id": f"{seq:012d}-{uuid.uuid4().hex[:8]}", "level": level}
        for kind, rows in (("adds", adds), ("deletes", deletes)):
            n = 0
            if rows is not None:
                path = f"{self.folder.path}/runs/{run['id']}/{kind}"
                rows.repartitionByRange("p", "s").sortWithinPartitions(*TRIPLE).write.parquet(path)
                n = self.spark.read.schema(RUN).parquet(path).count()
            run[kind] = n
        return run

    def _merged(self, runs: list[dict], group: list[dict], seq: int, level: int) -> dict:
        gone = self._rows(group, "deletes")
        if gone is not None:
            # nothing older is left that a delete could hide
            gone = None if len(group) == len(runs) else gone.groupBy(*TRIPLE).agg(F.max("seq").alias("seq"))
        return self._run(seq, level, self._live(group), gone)

    def _compacted(self, runs: list[dict], seq: int) -> list[dict]:
        while len(runs) >= FANOUT and len({r["level"] for r in runs[-FANOUT:]}) == 1:
            group = runs[-FANOUT:]
            runs = [*runs[:-FANOUT], self._merged(runs, group, seq, group[0]["level"] + 1)]
        return runs

    def _commit(self, operation: str, adds: DataFrame | None = None, deletes: DataFrame | None = None) -> VersionedStore:
        if self.fixed:
            raise Conflict(f"version {self.version} was opened to be read")
        seq = self.version + 1
        sequenced = [None if x is None else x.select(*TRIPLE, F.lit(seq).cast("long").alias("seq")) for x in (adds, deletes)]
        run = self._run(seq, 0, *sequenced)
        if run["adds"] or run["deletes"]:
            self._log(operation, run["adds"], run["deletes"], self._compacted([*self.runs, run], seq))
        return self

    def _log(self, operation: str, adds: int, deletes: int, runs: list[dict]) -> None:
        seq = self.version + 1
        entry = {"version": seq, "operation": operation, "adds": adds, "deletes": deletes, "runs": runs}
        if not self.folder.put(f"log/{seq:012d}.json", json.dumps(entry)):
            raise Conflict(f"version {seq} was committed by another writer")
        self._open()

    def compact(self) -> VersionedStore:
        """All runs as one, without anything deleted; a version of its own with the same triples."""
        if len(self.runs) > 1 or any(r["deletes"] for r in self.runs):
            level = max(r["level"] for r in self.runs) + 1
            self._log("compact", 0, 0, [self._merged(self.runs, self.runs, self.version + 1, level)])
        return self

    def vacuum(self, keep: int = 1) -> VersionedStore:
        """Delete log files but the last ``keep``, and runs that no log file left names. No writer may be at work."""
        old = self.versions()[:-keep]
        used = {r["id"] for v in self.versions()[-keep:] for r in self._entry(v)["runs"]}
        for v in old:
            self.folder.remove(f"log/{v:012d}.json")
        for name in self.folder.names("runs"):
            if name not in used:
                self.folder.remove(f"runs/{name}")
        return self

    # -- changes -------------------------------------------------------------------------------

    def _new(self, triples: DataFrame | list) -> DataFrame:
        if isinstance(triples, list):
            triples = self.spark.createDataFrame([tuple(self.term(x) for x in t) for t in triples], SCHEMA)
        return written(triples.select(*TRIPLE).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct(), "new-triples")

    def _missing(self, new: DataFrame, store: DataFrame) -> DataFrame:
        """The rows of ``new`` that the store lacks; only the row groups that may hold them are read."""
        span = new.agg(F.min("s"), F.max("s"), F.min("p"), F.max("p"), F.slice(F.collect_set("p"), 1, PREDICATES + 1)).first()
        if span[0] is None:
            return new
        near = F.col("s").between(span[0], span[1]) & F.col("p").between(span[2], span[3])
        near = near & F.col("p").isin(span[4]) if len(span[4]) <= PREDICATES else near
        known = store.where(near).join(new, TRIPLE, "left_semi")
        return new.join(known, TRIPLE, "left_anti")

    def add(self, triples: DataFrame | list) -> VersionedStore:
        new = self._new(triples)
        return self._commit("add", adds=self._missing(new, self.df))

    def remove(self, s=None, p=None, o=None) -> VersionedStore:
        return self._commit("remove", deletes=self.triples(s, p, o))

    def subtract(self, triples: DataFrame) -> VersionedStore:
        return self._commit("subtract", deletes=self.df.join(self._new(triples), TRIPLE, "left_semi"))

    def set(self, triples: DataFrame | list) -> VersionedStore:
        """Replace all values of each (subject, predicate) of some triples, as one version."""
        new = self._new(triples)
        old = self.df.join(new.select("s", "p").distinct(), ["s", "p"], "left_semi").select(*TRIPLE)
        return self._commit("set", adds=self._missing(new, self.df), deletes=old.join(new, TRIPLE, "left_anti"))

    def update(self, where: solutions.Solutions, delete: list[tuple] = (), insert: list[tuple] = ()) -> VersionedStore:
        """Delete and insert template triples of every solution, both judged on the version as it was, as one version."""
        where = solutions.Solutions(written(where.shown().df, "solutions"))
        new = self._new(where.construct(*insert)) if insert else None
        gone = self._new(where.construct(*delete)) if delete else None
        if gone is not None and new is not None:
            gone = gone.join(new, TRIPLE, "left_anti")
        deletes = None if gone is None else self.df.join(gone, TRIPLE, "left_semi")
        return self._commit("update", adds=None if new is None else self._missing(new, self.df), deletes=deletes)

    def delete(self, resources: DataFrame | str, scope: str = "all") -> VersionedStore:
        """Delete resources with everything reachable from them, or with ``scope="blank"`` only blank nodes below them."""
        first = self.spark.createDataFrame([(self.term(resources),)], "source string") if isinstance(resources, str) else resources.select(F.col("s").alias("source"))
        edges = edges_of(self.df)
        edges = edges.where(F.col("b").startswith("_:")) if scope == "blank" else edges
        nodes = reach(edges, first, include_seeds=True).select(F.col("node").alias("s")).distinct()
        return self._commit("delete", deletes=self.df.join(nodes, "s", "left_semi").select(*TRIPLE))


class Databases:
    """The databases below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def is_available(self) -> bool:
        """Whether the folder can be reached and listed."""
        try:
            self.folder.names("")
        except Exception:  # whatever the file system raises, it is not available
            return False
        return True

    def names(self) -> list[str]:
        return sorted(n for n in self.folder.names("") if self.folder.exists(f"{n}/log"))

    def create(self, name: str, prefixes: dict[str, str] | None = None) -> VersionedStore:
        """A new, empty database; its name must not be taken."""
        if self.folder.exists(f"{name}/log"):
            raise ValueError(f"database {name!r} is there already")
        self.folder.make(f"{name}/log")
        return self.open(name, prefixes=prefixes)

    def open(self, name: str, version: int | None = None, prefixes: dict[str, str] | None = None) -> VersionedStore:
        if not self.folder.exists(f"{name}/log"):
            raise ValueError(f"there is no database {name!r}")
        return VersionedStore(self.spark, f"{self.folder.path}/{name}", version, prefixes)

    def remove(self, name: str) -> None:
        if not self.folder.exists(f"{name}/log"):
            raise ValueError(f"there is no database {name!r}")
        self.folder.remove(name)
