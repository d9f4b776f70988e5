"""Tables and triples: wide rows to triples and back.

A header names a property: ``name[label?sep=;&unit=m]``. Dots nest (``creator.name``), an equal label
keeps columns of one nested resource together, ``sep`` splits cells. Headers may repeat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.documents import TYPE, Context

_HEADER = re.compile(r"^([^\[\]?]+)(?:\[([^\]?]*)(?:\?([^\]]*))?\])?$")


@dataclass
class Header:
    """A parsed header: path of property names with labels, and options."""

    path: list[tuple[str, str]]
    options: dict[str, str]


def parse_header(text: str) -> Header:
    parts, options = [], {}
    whole = [text.strip()] if "://" in text else re.split(r"\.(?![^\[]*\])", text.strip())
    for part in whole:
        m = _HEADER.match(part)
        if not m:
            raise ValueError(f"bad header: {text!r}")
        parts.append((m[1].strip(), m[2] or ""))
        options |= dict(x.split("=", 1) for x in (m[3] or "").split("&") if "=" in x)
    return Header(parts, options)


def to_triples(table: DataFrame, headers: list[str], context: Context) -> DataFrame:
    """Triples of a table whose columns, by position, have some headers.

    One scan: the cells of a row become one array of triples. A nested resource is a blank node
    named by its row's ``@id`` and its path, so equal tables give equal triples. Empty cells give nothing.
    """
    parsed = [parse_header(h) for h in headers]
    df = table.toDF(*[f"c{i}" for i in range(len(headers))])
    keys = [i for i, h in enumerate(parsed) if h.path == [("@id", "")]]
    name = F.col(f"c{keys[0]}") if keys else F.concat(F.lit("_:"), F.sha2(F.concat_ws("\x1f", *[F.col(c) for c in df.columns]), 256))
    subject = _resource(name, context) if keys else name
    made, linked = [], set()
    for i, h in enumerate(parsed):
        node = subject
        cell = F.trim(F.col(f"c{i}").cast("string"))
        full = cell.isNotNull() & (cell != "")
        for depth, (key, label) in enumerate(h.path[:-1]):
            place = "/".join(f"{k}[{x}]" for k, x in h.path[: depth + 1])
            child = F.concat(F.lit("_:"), F.md5(F.concat(subject, F.lit("/" + place))))
            made.append(F.when(full, F.array(_triple(node, F.lit(_predicate(context, key)), child))).otherwise(F.array().cast(_T)))
            linked.add(place)
            node = child
        key = h.path[-1][0]
        if key == "@id" and len(h.path) == 1:
            continue
        parts = F.split(cell, "\\Q" + h.options["sep"] + "\\E") if "sep" in h.options else F.array(cell)
        kind = context.keywords.get(key, {}).get("type")
        if key == "@type":
            value = lambda x: _class(x, context)
            predicate = TYPE
        else:
            value = (lambda x: _resource(x, context)) if kind == "@id" else (lambda x, kind=kind: terms.literal(x, kind)) if kind else terms.parse_object
            predicate = _predicate(context, key)
        made.append(F.when(full, _each(parts, node, predicate, value)).otherwise(F.array().cast(_T)))
    return df.where(subject.isNotNull()).select(F.inline(F.flatten(F.array(*made)))).distinct()


_T = "array<struct<s:string,p:string,o:string>>"


def _each(parts: Column, node: Column, predicate: str, value) -> Column:
    return F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: _triple(node, F.lit(predicate), value(F.trim(x)))).cast(_T)


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


def _predicate(context: Context, key: str) -> str:
    found = context.predicate(key)
    if found is None:
        raise ValueError(f"unknown keyword {key!r}")
    return found


def _resource(name: Column, context: Context) -> Column:
    from graphloom.functions.names import expand

    full = expand(name, context.prefixes)
    return F.when(full.contains("://") | full.startswith("_:"), full).otherwise(F.concat(F.lit(context.base), full))


def _class(name: Column, context: Context) -> Column:
    out = _resource(name, context)
    for k, spec in context.classes.items():
        out = F.when(name == k, spec["iri"]).otherwise(out)
    return out


def from_triples(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """One row per subject: s and, for each name, the sorted values of its predicate (a pivot over known predicates)."""
    rows = triples.where(F.col("p").isin(list(predicates.values())))
    return rows.groupBy("s").agg(*[F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(name) for name, p in predicates.items()])


def unpivot(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column and value (as text) of every non-null cell."""
    return table.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(key, columns, "column", "value").where("value IS NOT NULL")


def unique_headers(headers: list[str]) -> list[str]:
    """Headers with a running number where they repeat."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        seen[h] = seen.get(h, 0) + 1
        out.append(f"{h}[{seen[h]}]" if headers.count(h) > 1 else h)
    return out
