"""Prefixes, compact and split IRIs, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Well-known namespaces.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "http://schema.org/",
    "vann": "http://purl.org/vocab/vann/",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "sh": "http://www.w3.org/ns/shacl#",
    "void": "http://rdfs.org/ns/void#",
    "fno": "https://w3id.org/function/ontology#",
    "map": "http://emmo.info/domain-mappings#",
    "oteio": "https://w3id.org/emmo/domain/oteio#",
    "emmo": "https://w3id.org/emmo#",
}
#: Label predicates by precedence.
LABELS = (PREFIXES["skos"] + "prefLabel", PREFIXES["rdfs"] + "label", PREFIXES["skos"] + "altLabel")

_CURIE = r"^([A-Za-z_][A-Za-z0-9_.-]*|):([^\s/][^\s]*|)$"


def iri(name: str, prefixes: dict[str, str] = PREFIXES, strict: bool = False) -> str:
    """The full IRI of a compact one; other strings stay."""
    if name == "a":
        return PREFIXES["rdf"] + "type"
    prefix, colon, rest = name.partition(":")
    if colon and not rest.startswith("//") and prefix in prefixes:
        return prefixes[prefix] + rest
    if strict and colon and not rest.startswith("//"):
        raise KeyError(f"unknown prefix in {name!r}")
    return name


def expand(name: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """Full IRIs of compact ones; what has no known prefix stays."""
    space = F.lit(None).cast("string")
    for p, ns in prefixes.items():
        space = F.when(F.regexp_extract(name, _CURIE, 1) == p, ns).otherwise(space)
    found = F.concat(space, F.regexp_extract(name, _CURIE, 2))
    return F.when(name.rlike(_CURIE) & space.isNotNull(), found).otherwise(name)


def compact(name: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """Compact IRIs where a namespace fits; the first that is listed wins."""
    out = name
    for p, ns in reversed(prefixes.items()):
        out = F.when(name.startswith(ns), F.concat(F.lit(p + ":"), F.substr(name, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def split_iri(name: Column) -> tuple[Column, Column]:
    """Namespace and local name, cut at the last ``#``, else the last ``/``; NULL where there is neither."""
    at = F.when(name.contains("#"), F.length(F.substring_index(name, "#", -1))).when(name.contains("/"), F.length(F.substring_index(name, "/", -1)))
    return F.left(name, F.length(name) - at), F.right(name, at)


def iri_name(name: Column) -> Column:
    """The local name of an IRI, or what follows a compact one's colon."""
    return F.coalesce(split_iri(name)[1], F.substring_index(name, ":", -1))


def is_uri(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$")


def is_curie(name: Column) -> Column:
    return name.rlike(_CURIE) & ~name.contains("://")


def label_index(triples: DataFrame) -> DataFrame:
    """label and iri: the best-ranked subject of each label (by predicate precedence, then IRI)."""
    from graphloom.functions import terms

    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(LABELS))):
        rank = F.when(F.col("p") == p, i).otherwise(rank)
    rows = triples.where(F.col("p").isin(*LABELS)).select(terms.lexical(F.col("o")).alias("label"), F.col("s").alias("iri"), rank.alias("rank"))
    best = rows.groupBy("label").agg(F.min(F.struct("rank", "iri")).alias("best"))
    return best.select("label", "best.iri")


def labels_of(triples: DataFrame) -> DataFrame:
    """iri and label: the best-ranked label of each subject (then the smallest)."""
    from graphloom.functions import terms

    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(LABELS))):
        rank = F.when(F.col("p") == p, i).otherwise(rank)
    rows = triples.where(F.col("p").isin(*LABELS)).select(F.col("s").alias("iri"), terms.lexical(F.col("o")).alias("label"), rank.alias("rank"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("iri").orderBy("rank", "label"))).where("n = 1").select("iri", "label")
