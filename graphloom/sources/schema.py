"""Keyword schemas: contexts from YAML and tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import PREFIXES, iri
from graphloom.operators.documents import Context


class InvalidSchemaError(ValueError):
    """A schema lacks a part, or defines a keyword twice."""


def from_mapping(schema: dict, base: Context | None = None, redefine: str = "raise") -> Context:
    """A context from ``prefixes`` and ``resources`` (class to iri, subClassOf and keywords with iri, datatype or range, conformance).

    It extends ``base``. A keyword that is there with another IRI is an error, skipped or replaced, as
    ``redefine`` says (``raise``, ``skip``, ``allow``).
    """
    out = Context(base=base.base if base else "", prefixes=(dict(base.prefixes) if base else {}) | schema.get("prefixes", {}))
    if base:
        out.keywords, out.classes = dict(base.keywords), dict(base.classes)
    resources = schema.get("resources")
    if not isinstance(resources, dict):
        raise InvalidSchemaError("a schema needs resources")
    for name, spec in resources.items():
        if not isinstance(spec, dict) or "iri" not in spec:
            raise InvalidSchemaError(f"{name} has no iri")
        parents = spec.get("subClassOf", [])
        mandatory = []
        for key, word in spec.get("keywords", {}).items():
            if "iri" not in word:
                raise InvalidSchemaError(f"{name}.{key} has no iri")
            made = {"iri": iri(word["iri"], out.prefixes), "type": iri(word["datatype"], out.prefixes) if word.get("datatype") else "@id" if word.get("range", "rdfs:Literal") != "rdfs:Literal" else None}
            if key in out.keywords and out.keywords[key]["iri"] != made["iri"]:
                if redefine == "raise":
                    raise InvalidSchemaError(f"{key} is defined twice")
                if redefine == "skip":
                    continue
            out.keywords[key] = made
            if word.get("conformance") == "mandatory":
                mandatory.append(key)
        out.classes[name] = {"iri": iri(spec["iri"], out.prefixes), "subClassOf": [iri(p, out.prefixes) for p in ([parents] if isinstance(parents, str) else parents)], "mandatory": mandatory}
    return out


def load_yaml(spark: SparkSession, path: str, base: Context | None = None, redefine: str = "raise") -> Context:
    """A context from one YAML file."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return from_mapping(yaml.safe_load(text[0]) if text else {}, base, redefine)


def load_table(rows: DataFrame, base: Context | None = None) -> Context:
    """A context from a table with columns id, domain, datatype and conformance, one row per keyword."""
    resources: dict[str, dict] = {}
    prefixes = base.prefixes if base else PREFIXES
    for r in rows.select("id", "domain", "datatype", "conformance").collect():
        name = iri(r.domain, prefixes).rstrip("/#").replace("#", "/").rsplit("/", 1)[-1]
        key = iri(r.id, prefixes).replace("#", "/").rsplit("/", 1)[-1]
        known = base.classes.get(name) if base else None
        spec = resources.setdefault(name, {"iri": known["iri"] if known else r.domain, "subClassOf": known["subClassOf"] if known else [], "keywords": {}})
        spec["keywords"][key] = {"iri": r.id, "datatype": r.datatype, "conformance": r.conformance}
    return from_mapping({"resources": resources}, base)


def as_table(spark: SparkSession, context: Context) -> DataFrame:
    """keyword, iri and datatype of all keywords, sorted by keyword."""
    rows = sorted((k, v["iri"], v["type"]) for k, v in context.keywords.items())
    return spark.createDataFrame(rows, "keyword string, iri string, datatype string").orderBy("keyword")


def as_triples(spark: SparkSession, context: Context) -> DataFrame:
    """The schema itself as triples: classes, superclasses, properties and ranges."""
    rdf, rdfs, owl = PREFIXES["rdf"], PREFIXES["rdfs"], PREFIXES["owl"]
    rows = []
    for spec in context.classes.values():
        rows += [(spec["iri"], rdf + "type", owl + "Class"), *[(spec["iri"], rdfs + "subClassOf", p) for p in spec["subClassOf"]]]
    for key, spec in context.keywords.items():
        rows += [(spec["iri"], rdf + "type", owl + ("ObjectProperty" if spec["type"] == "@id" else "DatatypeProperty")), (spec["iri"], rdfs + "label", f'"{key}"')]
        if spec["type"] and spec["type"] != "@id":
            rows.append((spec["iri"], rdfs + "range", spec["type"]))
    return spark.createDataFrame(rows, "s string, p string, o string").distinct()


def missing(triples: DataFrame, context: Context, classes: bool = False) -> DataFrame:
    """keyword and iri of keywords (and classes) that the triples do not describe: an anti-join with the typed subjects."""
    words = [(k, v["iri"]) for k, v in context.keywords.items()] + ([(k, v["iri"]) for k, v in context.classes.items()] if classes else [])
    table = triples.sparkSession.createDataFrame(words, "keyword string, iri string")
    typed = triples.where(F.col("p") == PREFIXES["rdf"] + "type").select(F.col("s").alias("iri"))
    return table.join(typed, "iri", "left_anti").select("keyword", "iri")


def json_ld_context(context: Context) -> dict:
    """The context as a JSON-LD ``@context``."""
    words = {k: ({"@id": v["iri"], "@type": v["type"]} if v["type"] else v["iri"]) for k, v in context.keywords.items()}
    return {"@context": dict(context.prefixes) | words | {k: v["iri"] for k, v in context.classes.items()}}
