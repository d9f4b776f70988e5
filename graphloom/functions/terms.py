"""RDF terms in single string columns.

An IRI is the plain string, a blank node starts with ``_:``, and a literal is written in the N-Triples
form that starts with a quotation mark. The three never collide, so a term compares, joins and
groups as one string, which is RDF-term equality. Values are taken out by the functions below, which
give NULL where a term has no value of that kind.
"""

from __future__ import annotations

import datetime
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

#: Datatypes by value space.
INTEGERS = (
    "integer", "int", "short", "long", "byte", "nonNegativeInteger", "nonPositiveInteger", "negativeInteger", "positiveInteger",
    "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
)
FLOATS = ("double", "float", "decimal", "real", "rational")
#: Days in a year of a duration.
YEAR_DAYS = 365.2422

#: A whole literal. Possessive repetition keeps the matcher from recursing, so texts may be of any length.
_LITERAL = r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*+|\^\^<?[^>"]*+>?)?$'
#: Escapes in literals, beside the backslash.
_ESCAPES = (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def quote(lexical: Column) -> Column:
    """A quoted and escaped lexical form."""
    for raw, escaped in (("\\", "\\\\"), *_ESCAPES):
        lexical = F.replace(lexical, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), lexical, F.lit('"'))


def literal(lexical: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    """A literal term from a column of lexical forms."""
    out = quote(lexical.cast("string"))
    if lang:
        return F.concat(out, F.lit("@" + lang.lower()))
    return F.concat(out, F.lit(f"^^<{datatype}>")) if datatype else out


#: Spark type to XSD datatype.
_NATIVE = {"boolean": "boolean", "tinyint": "byte", "smallint": "short", "int": "int", "bigint": "integer", "float": "double", "double": "double", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "binary": "hexBinary"}


def from_native(value: Column, kind: str) -> Column:
    """A literal term from a native column of a Spark type (its simple string)."""
    if kind.startswith("decimal"):
        return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}decimal>'))
    if kind in ("timestamp", "timestamp_ntz"):
        return literal(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), XSD + "dateTime")
    if kind == "binary":
        return literal(F.hex(value), XSD + "hexBinary")
    if kind.startswith(("array", "map", "struct")):
        return literal(F.to_json(value), RDF + "JSON")
    if kind in _NATIVE:
        # numbers, booleans and dates have nothing to escape
        return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}{_NATIVE[kind]}>'))
    return literal(value)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_iri(term: Column) -> Column:
    return ~is_literal(term) & ~is_blank(term)


def _suffix(term: Column) -> Column:
    """What follows a literal's last quotation mark; neither tags nor datatypes have one."""
    return F.substring_index(term, '"', -1)


def lexical(term: Column) -> Column:
    """The lexical form of a literal, the string of any other term."""
    body = F.substr(term, F.lit(2), F.greatest(F.length(term) - F.length(_suffix(term)) - 2, F.lit(0)))

    def plain(part: Column) -> Column:
        for raw, escaped in _ESCAPES:
            part = F.replace(part, F.lit(escaped), F.lit(raw))
        return part

    # between doubled backslashes every backslash starts an escape
    unescaped = F.array_join(F.transform(F.split(body, r"\\\\"), plain), "\\")
    return F.when(is_literal(term), F.when(body.contains("\\"), unescaped).otherwise(body)).otherwise(term)


def language(term: Column) -> Column:
    """Language tag of a literal in lower case, or NULL."""
    return F.when(is_literal(term), F.nullif(F.lower(F.regexp_extract(_suffix(term), "^@([A-Za-z]+(?:-[A-Za-z0-9]+)*)$", 1)), F.lit("")))


def datatype(term: Column) -> Column:
    """Datatype IRI of a literal, or NULL where it has none."""
    return F.when(is_literal(term), F.nullif(F.regexp_extract(_suffix(term), r"^\^\^<?([^>]*)>?$", 1), F.lit("")))


def _of(term: Column, names) -> Column:
    return datatype(term).isin([XSD + n for n in names])


def number(term: Column) -> Column:
    """Numeric value as DOUBLE."""
    return F.when(_of(term, INTEGERS + FLOATS), lexical(term).try_cast("double"))


def integer(term: Column) -> Column:
    return F.when(_of(term, INTEGERS), lexical(term).try_cast("bigint"))


def decimal(term: Column) -> Column:
    return F.when(_of(term, INTEGERS + ("decimal",)), lexical(term).try_cast("decimal(38,18)"))


def boolean(term: Column) -> Column:
    """Boolean value; 1, 0 and any case are read."""
    low = F.lower(lexical(term))
    return F.when(_of(term, ("boolean",)), F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False))


def timestamp(term: Column) -> Column:
    return F.when(_of(term, ("dateTime", "dateTimeStamp")), lexical(term).try_cast("timestamp"))


def date(term: Column) -> Column:
    return F.when(_of(term, ("date",)), lexical(term).try_cast("date"))


def binary(term: Column) -> Column:
    """Bytes of hexBinary and base64Binary literals."""
    lex = lexical(term)
    return F.when(_of(term, ("hexBinary",)), F.unhex(F.when(lex.rlike("^([0-9A-Fa-f]{2})*$"), lex))).when(_of(term, ("base64Binary",)), F.try_to_binary(lex, F.lit("base64")))


def parsed_json(term: Column) -> Column:
    """VARIANT of an rdf:JSON literal; NULL if it is not JSON."""
    return F.when(datatype(term) == RDF + "JSON", F.try_parse_json(lexical(term)))


_DURATION = r"^([+-])?P(?:([0-9.]+)Y)?(?:([0-9.]+)M)?(?:([0-9.]+)W)?(?:([0-9.]+)D)?(?:T(?:([0-9.]+)H)?(?:([0-9.]+)M)?(?:([0-9.]+)S)?)?$"


def parse_duration(text: Column) -> Column:
    """Seconds of an ISO 8601 duration (years of 365.2422 days, months of a twelfth), or NULL."""
    day = 86400.0
    weights = (YEAR_DAYS * day, YEAR_DAYS * day / 12, 7 * day, day, 3600.0, 60.0, 1.0)
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.coalesce(F.regexp_extract(text, _DURATION, i + 2).try_cast("double"), F.lit(0.0)) * w
    signed = F.when(F.regexp_extract(text, _DURATION, 1) == "-", -total).otherwise(total)
    return F.when(text.rlike(_DURATION) & text.rlike("[0-9]"), signed)


def format_duration(seconds: Column) -> Column:
    """ISO 8601 duration in days, hours, minutes and seconds; zero parts are left out."""
    left, parts = F.abs(seconds), []
    for unit, size in (("D", 86400), ("H", 3600), ("M", 60)):
        n = F.floor(left / size)
        parts.append(F.when(n >= 1, F.concat(n.cast("string"), F.lit(unit))).otherwise(""))
        left = left - n * size
    rest = F.round(left, 6)
    parts.append(F.when(rest > 0, F.concat(F.regexp_replace(rest.cast("decimal(20,6)").cast("string"), r"\.?0+$", ""), F.lit("S"))).otherwise(""))
    clock = F.concat(*parts[1:])
    body = F.concat(parts[0], F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.lit("P"), F.when(body == "", "T0S").otherwise(body))


def parse_object(text: Column) -> Column:
    """A term guessed from plain text.

    In this order: blank node, absolute IRI, boolean, integer, float, date and time, literal in
    N-Triples form, and a plain string literal.
    """
    t = F.trim(text)
    return (
        F.when(text.isNull(), F.lit(None))
        .when(t.rlike(r"^_:\S+$"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"), t)
        .when(F.lower(t).isin("true", "false"), literal(F.lower(t), XSD + "boolean"))
        .when(t.rlike(r"^[+-]?[0-9]+$"), literal(t, XSD + "integer"))
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][+-]?[0-9]+)?$"), literal(t, XSD + "double"))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}") & t.try_cast("timestamp").isNotNull(), literal(F.replace(t, F.lit(" "), F.lit("T")), XSD + "dateTime"))
        .when(t.rlike(_LITERAL), t)
        .otherwise(literal(text))
    )


def same_value(a: Column, b: Column) -> Column:
    """Equality of values as in filters: numbers by number, times by time, all else by term."""
    return F.coalesce(number(a) == number(b), timestamp(a) == timestamp(b), boolean(a) == boolean(b), a == b)


def loosely_equal(a: Column, b: Column) -> Column:
    """Equality of literals that lets a missing datatype stand for any string, and a missing language for any language."""
    strings = lambda t: F.coalesce(datatype(t), F.lit(XSD + "string")).isin(XSD + "string", RDF + "langString")
    types = F.coalesce(datatype(a) == datatype(b), strings(a) & strings(b))
    return (a == b) | (is_literal(a) & is_literal(b) & (lexical(a) == lexical(b)) & types & F.coalesce(language(a) == language(b), F.lit(True)))


def sort_key(term: Column) -> list[Column]:
    """Columns that order terms: unbound, blank nodes, IRIs, literals (numbers by value)."""
    rank = F.when(term.isNull(), 0).when(is_blank(term), 1).when(is_iri(term), 2).otherwise(3)
    return [rank, number(term), lexical(term)]


def term(value) -> str | None:
    """A term from a Python value; strings are IRIs, blank nodes, literals in N-Triples form, or else plain literals."""
    escape = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if value is None:
        return None
    if isinstance(value, bool):
        return f'"{str(value).lower()}"^^<{XSD}boolean>'
    if isinstance(value, int):
        return f'"{value}"^^<{XSD}integer>'
    if isinstance(value, float):
        shown = repr(value) if math.isfinite(value) else {math.inf: "INF", -math.inf: "-INF"}.get(value, "NaN")
        return f'"{shown}"^^<{XSD}double>'
    if isinstance(value, datetime.datetime):
        return f'"{value.isoformat()}"^^<{XSD}dateTime>'
    if isinstance(value, datetime.date):
        return f'"{value.isoformat()}"^^<{XSD}date>'
    if isinstance(value, datetime.time):
        return f'"{value.isoformat()}"^^<{XSD}time>'
    if isinstance(value, bytes | bytearray):
        return f'"{bytes(value).hex()}"^^<{XSD}hexBinary>'
    if isinstance(value, dict | list):
        return escape(json.dumps(value)) + f"^^<{RDF}JSON>"
    if value.startswith(("_:", '"')) or "://" in value or value.startswith(("urn:", "mailto:")):
        return value
    return escape(value)
