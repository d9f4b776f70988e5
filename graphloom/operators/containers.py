"""Nested dictionaries and lists as triples.

A dictionary entry becomes a key-value node, a list an RDF list, and scalars literals; ``null`` is
``owl:Nothing``, an empty dictionary a node typed as one, an empty list ``rdf:nil``. Known keys use
their own predicate. Rows of JSON are taken apart where they lie, and put together again by joins and a
closure over list cells.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES

RDF, OWL, OTEIO = PREFIXES["rdf"], PREFIXES["owl"], PREFIXES["oteio"]
ENTRY, KEY, VALUE, PAIR, DICTIONARY = OTEIO + "hasKeyValuePair", OTEIO + "hasKey", OTEIO + "hasValue", OTEIO + "KeyValuePair", OTEIO + "Dictionary"


def _take_apart(value, node: str, known: dict[str, str], out: list) -> str:
    """The term of a value; triples of nested ones are added to ``out``."""
    below = lambda name: "_:" + hashlib.sha256(f"{node}/{name}".encode()).hexdigest()[:24]
    if value is None:
        return OWL + "Nothing"
    if isinstance(value, dict):
        own = node
        out.append((own, RDF + "type", DICTIONARY))
        for key, v in value.items():
            if key in known:
                out.append((own, known[key], _take_apart(v, below(key), known, out)))
                continue
            pair = below("pair " + key)
            out += [(own, ENTRY, pair), (pair, RDF + "type", PAIR), (pair, KEY, terms.term('"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"')), (pair, VALUE, _take_apart(v, below(key), known, out))]
        return own
    if isinstance(value, list):
        cells = [below(f"cell {i}") for i in range(len(value))] + [RDF + "nil"]
        for i, v in enumerate(value):
            out += [(cells[i], RDF + "first", _take_apart(v, below(f"item {i}"), known, out)), (cells[i], RDF + "rest", cells[i + 1])]
        return cells[0]
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    return terms.term(value)


def to_triples(rows: DataFrame, iri: str = "iri", column: str = "json", known: dict[str, str] | None = None) -> DataFrame:
    """Triples of JSON objects or arrays, each hanging from its row's IRI; a list hangs by ``rdf:value``."""
    known = known or {}

    def run(frames):
        for frame in frames:
            out = []
            for name, text in zip(frame["iri"], frame["json"], strict=True):
                value = json.loads(text)
                if isinstance(value, dict):
                    _take_apart(value, name, known, out)
                else:
                    out.append((name, RDF + "value", _take_apart(value, name, known, out)))
            yield pd.DataFrame(out, columns=["s", "p", "o"])

    picked = rows.select(F.col(iri).alias("iri"), F.col(column).alias("json")).where("iri IS NOT NULL AND json IS NOT NULL")
    return picked.mapInPandas(run, "s string, p string, o string").distinct()


def entries(triples: DataFrame) -> DataFrame:
    """s, key and value (a term) of every dictionary entry."""
    pairs = triples.where(F.col("p") == ENTRY).select("s", F.col("o").alias("pair"))
    keys = triples.where(F.col("p") == KEY).select(F.col("s").alias("pair"), terms.lexical(F.col("o")).alias("key"))
    values = triples.where(F.col("p") == VALUE).select(F.col("s").alias("pair"), F.col("o").alias("value"))
    return pairs.join(keys, "pair").join(values, "pair").select("s", "key", "value")


def collect(triples: DataFrame, iri: str, known: dict[str, str] | None = None):
    """One container as Python values; only what hangs below ``iri`` reaches the driver."""
    from graphloom.operators.closure import edges_of, reach

    spark = triples.sparkSession
    nodes = reach(edges_of(triples), spark.createDataFrame([(iri,)], "source string"), include_seeds=True).select(F.col("node").alias("s"))
    own: dict[str, dict[str, list]] = {}
    for r in triples.join(nodes, "s", "left_semi").collect():
        own.setdefault(r.s, {}).setdefault(r.p, []).append(r.o)
    names = {p: k for k, p in (known or {}).items()}

    def build(term: str):
        if term == OWL + "Nothing":
            return None
        if term == RDF + "nil":
            return []
        if term.startswith('"'):
            lex, kind = term.rsplit('"', 1)
            lex = json.loads(lex + '"')
            kind = kind[3:-1].removeprefix(terms.XSD) if kind.startswith("^^") else ""
            return lex == "true" if kind == "boolean" else int(lex) if kind == "integer" else float(lex) if kind == "double" else lex
        props = own.get(term, {})
        if RDF + "first" in props:
            out, cell = [], term
            while cell != RDF + "nil":
                out.append(build(own[cell][RDF + "first"][0]))
                cell = own[cell][RDF + "rest"][0]
            return out
        if DICTIONARY in props.get(RDF + "type", []):
            out = {build(own[p][KEY][0]): build(own[p][VALUE][0]) for p in props.get(ENTRY, [])}
            return out | {names[p]: build(v[0]) for p, v in props.items() if p in names}
        return term

    return build(own[iri][RDF + "value"][0]) if RDF + "value" in own.get(iri, {}) else build(iri)
