"""Turtle files, one task per file."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.names import PREFIXES

RDF = PREFIXES["rdf"]
XSD = PREFIXES["xsd"]

_TOKENS = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.?[0-9]+[eE][+-]?[0-9]+|\.[0-9]+|[0-9]+)(?![A-Za-z_:]))
    |(?P<blank>_:[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)|(?P<name>[A-Za-z][\w.-]*:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*|:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*|[A-Za-z]+)|(?P<mark>[\[\]();,.])''',
    re.X,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    def one(m):
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "uU" else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def statements(text: str, scope: str) -> list[tuple[str, str, str]]:
    """Triples of one Turtle document. Blank nodes are numbered within ``scope``."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"bad Turtle at {text[at:at + 40]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.reverse()
    prefixes, base, out, counter = {}, "", [], [0]

    def take(mark: str) -> None:
        if not tokens or tokens.pop()[1] != mark:
            raise ValueError(f"{mark!r} expected in Turtle")

    def fresh() -> str:
        counter[0] += 1
        return f"_:{scope}b{counter[0]}"

    def full(token: str) -> str:
        found = _plain(token[1:-1])
        return found if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", found) else base + found

    def node() -> str:
        kind, token = tokens.pop()
        if kind == "iri":
            return full(token)
        if kind == "blank":
            return f"_:{scope}{token[2:]}"
        if kind == "name" and ":" in token:
            prefix, _, local = token.partition(":")
            return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if kind == "name" and token in ("true", "false"):
            return f'"{token}"^^<{XSD}boolean>'
        if kind == "number":
            name = "integer" if re.fullmatch(r"[+-]?[0-9]+", token) else "double" if "e" in token.lower() else "decimal"
            return f'"{token}"^^<{XSD}{name}>'
        if kind in ("text", "long"):
            raw = _plain(token[3:-3] if kind == "long" else token[1:-1])
            lit = '"' + raw.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
            if tokens and tokens[-1][0] == "lang":
                return lit + tokens.pop()[1].lower()
            if tokens and tokens[-1][0] == "type":
                tokens.pop()
                return f"{lit}^^<{node()}>"
            return lit
        if token == "[":
            own = fresh()
            if tokens[-1][1] != "]":
                properties(own)
            take("]")
            return own
        if token == "(":
            items = []
            while tokens[-1][1] != ")":
                items.append(node())
            take(")")
            cells = [fresh() for _ in items] + [RDF + "nil"]
            for cell, after, item in zip(cells, cells[1:], items, strict=False):
                out.extend([(cell, RDF + "first", item), (cell, RDF + "rest", after)])
            return cells[0]
        raise ValueError(f"unexpected {token!r} in Turtle")

    def properties(subject: str) -> None:
        while True:
            if tokens[-1][1] in (".", "]"):
                return
            predicate = RDF + "type" if tokens[-1] == ("name", "a") and tokens.pop() else node()
            while True:
                out.append((subject, predicate, node()))
                if tokens[-1][1] != ",":
                    break
                tokens.pop()
            if tokens[-1][1] != ";":
                return
            while tokens[-1][1] == ";":
                tokens.pop()

    while tokens:
        kind, token = tokens[-1]
        word = token.lower()
        if kind == "lang" and word in ("@prefix", "@base") or kind == "name" and word in ("prefix", "base"):
            tokens.pop()
            if word.endswith("prefix"):
                name = tokens.pop()[1][:-1]
                prefixes[name] = full(tokens.pop()[1])
            else:
                base = full(tokens.pop()[1])
            if kind == "lang":
                take(".")
            continue
        subject = node()
        if tokens[-1][1] != ".":
            properties(subject)
        take(".")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files; a file is parsed whole, so keep large graphs in N-Triples."""

    def run(frames):
        for frame in frames:
            rows = []
            for place, text in zip(frame["place"], frame["value"], strict=True):
                rows += statements(text, f"t{zlib.crc32(place.encode()):08x}_")
            yield pd.DataFrame(rows, columns=["s", "p", "o"])

    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("place"))
    return files.mapInPandas(run, "s string, p string, o string").distinct()


def parse(spark: SparkSession, text: str) -> DataFrame:
    """Triples of a Turtle string."""
    rows = statements(text, f"t{zlib.crc32(text.encode()):08x}_")
    return spark.createDataFrame(rows, "s string, p string, o string").distinct()
