"""Documents and triples.

A document is JSON with ``@id``, ``@type`` and keywords; nested objects become linked resources. A
context maps keywords to predicates and says which values are references or typed literals.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES, iri
from graphloom.operators.closure import edges_of, reach
from graphloom.operators.store import ResourceExistsError, TripleStore
from graphloom.workspace import written

TYPE = PREFIXES["rdf"] + "type"
INDIVIDUAL = PREFIXES["owl"] + "NamedIndividual"


class Context:
    """Keywords: their predicates, datatypes (``@id`` for references), classes with superclasses and mandatory keywords."""

    def __init__(self, keywords: dict[str, dict] | None = None, classes: dict[str, dict] | None = None, prefixes: dict[str, str] | None = None, base: str = ""):
        self.prefixes = dict(PREFIXES) | (prefixes or {})
        self.keywords = {k: {"iri": iri(v["iri"], self.prefixes), "type": iri(v["type"], self.prefixes) if v.get("type") else None} for k, v in (keywords or {}).items()}
        self.classes = {k: {"iri": iri(v["iri"], self.prefixes), "subClassOf": [iri(c, self.prefixes) for c in v.get("subClassOf", [])], "mandatory": v.get("mandatory", [])} for k, v in (classes or {}).items()}
        self.base = base

    def predicate(self, key: str) -> str | None:
        """The predicate of a keyword, a compact or a full IRI; None if it is unknown."""
        if key in self.keywords:
            return self.keywords[key]["iri"]
        full = iri(key, self.prefixes)
        return full if "://" in full else None

    def type_iris(self, name: str) -> list[str]:
        """A type and its direct superclasses."""
        known = self.classes.get(name)
        return [known["iri"], *known["subClassOf"]] if known else [iri(name, self.prefixes)]

    def resource(self, name: str) -> str:
        if name.startswith("_:"):
            return name
        full = iri(name, self.prefixes)
        if "://" in full or full.startswith("urn:"):
            return full
        if not self.base:
            raise ValueError(f"relative IRI without a base: {name}")
        return self.base + full

    def value(self, key: str, value) -> str:
        """A scalar as a term."""
        kind = self.keywords.get(key, {}).get("type")
        if kind == "@id":
            return self.resource(str(value))
        if isinstance(value, dict) and "@value" in value:
            if "@language" in value:
                return terms.term('"' + str(value["@value"]).replace("\\", "\\\\").replace('"', '\\"') + '"@' + value["@language"].lower())
            kind, value = iri(value.get("@type", ""), self.prefixes) or kind, value["@value"]
        if kind:
            text = str(value).lower() if isinstance(value, bool) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)
            return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + f'"^^<{kind}>'
        plain = value if not isinstance(value, str) else None
        return terms.term(plain) if plain is not None else '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


class UnknownKeywordError(ValueError):
    """A document uses a keyword that the context lacks."""


def _flatten(doc: dict, context: Context, unknown: str, place: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The resource of a document and its triples."""
    name = doc.get("@id")
    node = context.resource(name) if name else "_:" + hashlib.sha256((place + json.dumps(doc, sort_keys=True)).encode()).hexdigest()[:24]
    given = doc.get("@type") or [INDIVIDUAL]
    out = [(node, TYPE, t) for g in ([given] if isinstance(given, str) else given) for t in context.type_iris(g)]
    for s, p, o in doc.get("statements", []):
        out.append(tuple(context.resource(x) if not x.startswith('"') else x for x in (s, p, o)))
    for key, values in doc.items():
        if key.startswith("@") or key == "statements" or values is None:
            continue
        predicate = context.predicate(key)
        if predicate is None:
            if unknown == "raise":
                raise UnknownKeywordError(key)
            continue
        for i, v in enumerate(values if isinstance(values, list) else [values]):
            as_json = context.keywords.get(key, {}).get("type") == terms.RDF + "JSON"
            if isinstance(v, dict) and "@value" not in v and not as_json:
                child, more = _flatten(v, context, unknown, f"{node}/{key}/{i}")
                out += [(node, predicate, child), *more]
            else:
                out.append((node, predicate, context.value(key, v)))
    return node, out


def to_triples(docs: DataFrame, context: Context, column: str = "doc", unknown: str = "raise") -> DataFrame:
    """root, s, p and o of JSON documents, one document per row; documents are flattened where they lie.

    Blank nodes are named by content and place, so retried tasks repeat them.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for text in frame[column]:
                root, found = _flatten(json.loads(text), context, unknown, "")
                rows += [(root, *t) for t in found]
            yield pd.DataFrame(rows, columns=["root", "s", "p", "o"])

    return docs.select(column).where(f"{column} IS NOT NULL").mapInPandas(run, "root string, s string, p string, o string").distinct()


def store(target: TripleStore, docs: DataFrame, context: Context, method: str = "merge", unknown: str = "raise", column: str = "doc") -> TripleStore:
    """Add documents to a store; existing resources are told by one semi-join.

    ``merge`` adds to them, ``overwrite`` replaces them, ``ignore`` leaves them alone and adds the
    others, ``raise`` refuses.
    """
    new = written(to_triples(docs, context, column, unknown), "documents")
    roots = new.select("root").where(~F.col("root").startswith("_:")).distinct()
    there = roots.join(target.df.select(F.col("s").alias("root")), "root", "left_semi")
    if method == "raise" and not there.isEmpty():
        raise ResourceExistsError(there.first()[0])
    if method == "overwrite":
        target.delete(there.select(F.col("root").alias("s")), scope="blank")
    elif method == "ignore":
        new = new.join(there, "root", "left_anti")
    elif method not in ("merge", "raise"):
        raise ValueError(f"unknown method {method!r}")
    return target.add(new.select("s", "p", "o"))


def validate(triples: DataFrame, context: Context) -> DataFrame:
    """s, keyword and problem: mandatory keywords that are missing, and literals that their datatype cannot read."""
    out = None
    types = triples.where(F.col("p") == TYPE)
    for spec in context.classes.values():
        for key in spec["mandatory"]:
            members = types.where(F.col("o") == spec["iri"]).select("s").distinct()
            lacking = members.join(triples.where(F.col("p") == context.predicate(key)).select("s"), "s", "left_anti")
            part = lacking.select("s", F.lit(key).alias("keyword"), F.lit("missing").alias("problem"))
            out = part if out is None else out.unionByName(part)
    readers = {n: terms.number for n in terms.INTEGERS + terms.FLOATS} | {"boolean": terms.boolean, "date": terms.date, "dateTime": terms.timestamp}
    for key, spec in context.keywords.items():
        kind = spec["type"]
        if kind and kind.startswith(terms.XSD) and kind[len(terms.XSD) :] in readers:
            rows = triples.where((F.col("p") == spec["iri"]) & (terms.datatype(F.col("o")) == kind))
            part = rows.where(readers[kind[len(terms.XSD) :]](F.col("o")).isNull()).select("s", F.lit(key).alias("keyword"), F.lit("unreadable").alias("problem"))
            out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else triples.select("s", F.lit("").alias("keyword"), F.lit("").alias("problem")).where("false")


def acquire(triples: DataFrame, resources: DataFrame) -> DataFrame:
    """root, s, depth and properties (map of predicate to sorted values) of resources (column s) and the blank nodes below them."""
    below = edges_of(triples).where(F.col("b").startswith("_:"))
    nodes = reach(below, resources.select(F.col("s").alias("source")), include_seeds=True)
    values = triples.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("values"))
    maps = values.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "values")))).alias("properties"))
    return nodes.select(F.col("source").alias("root"), F.col("node").alias("s"), "depth").join(maps, "s").select("root", "s", "depth", "properties")


def nested(rows: list, root: str) -> dict:
    """Collected rows of one resource from ``acquire`` as a nested dict."""
    own = {r.s: r.properties for r in rows if r.root == root}

    def build(node: str, seen: tuple) -> dict:
        out = {"@id": node}
        for p, values in own[node].items():
            made = [build(v, (*seen, v)) if v in own and v not in seen else v for v in values]
            out["@type" if p == TYPE else p] = made[0] if len(made) == 1 else made
        return out

    return build(root, (root,)) if root in own else {}
