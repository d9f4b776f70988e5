"""Inheritance of keyword schemas.

A schema may be based on others and a class may be below others; both are closures over tables, so schemas come from files,
tables or triples alike. Definitions of a schema are its own and those of all schemas that it is based on, directly or not. Where
two define a keyword with different IRIs the rule decides: ``raise`` refuses, ``skip`` keeps what the base says, ``allow``
takes the definition nearest to the schema. A class has its own keywords and those of its superclasses, the nearest
definition first. A keyword that several classes define has several domains.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.names import PREFIXES, iri
from graphloom.operators.closure import reach

DEFINITIONS = "schema string, theme string, cls string, cls_name string, keyword string, iri string, datatype string, conformance string, description string"
#: Levels of conformance, strongest first.
CONFORMANCE = ("mandatory", "recommended", "optional")


class RedefinitionError(ValueError):
    """A schema defines a keyword of its base with another IRI."""


def tables(spark: SparkSession, schemas: dict[str, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions, based_on (schema, base) and parents (schema, cls, parent) of schemas given as mappings.

    A mapping has ``resources`` (class to iri, subClassOf and keywords) and may have ``basedOn``, ``theme`` and ``prefixes``.
    """
    rows, bases, parents = [], [], []
    for name, schema in schemas.items():
        prefixes = dict(PREFIXES) | schema.get("prefixes", {})
        many = lambda x: [] if x is None else [x] if isinstance(x, str) else list(x)
        bases += [(name, b) for b in many(schema.get("basedOn"))]
        for cls, spec in schema.get("resources", {}).items():
            full = iri(spec["iri"], prefixes)
            parents += [(name, full, iri(p, prefixes)) for p in many(spec.get("subClassOf"))]
            for key, word in (spec.get("keywords") or {"": {}}).items():
                conformance = (word.get("conformance") or "").split(":")[-1].split("#")[-1] or None
                if conformance not in (None, *CONFORMANCE):
                    raise ValueError(f"{name}.{cls}.{key}: unknown conformance {conformance!r}")
                datatype = iri(word["datatype"], prefixes) if word.get("datatype") else "@id" if word.get("range", "rdfs:Literal") != "rdfs:Literal" else None
                rows.append((name, schema.get("theme"), full, cls, key or None, iri(word["iri"], prefixes) if key else None, datatype, conformance, word.get("description")))
    return spark.createDataFrame(rows, DEFINITIONS), spark.createDataFrame(bases, "schema string, base string"), spark.createDataFrame(parents, "schema string, cls string, parent string")


def resolve(definitions: DataFrame, based_on: DataFrame, redefine: str = "raise") -> DataFrame:
    """All definitions that hold in each schema, with ``origin`` (the schema they come from) and ``distance`` (steps to it)."""
    if redefine not in ("raise", "skip", "allow"):
        raise ValueError(f"unknown rule {redefine!r}")
    schemas = definitions.select(F.col("schema").alias("source")).unionByName(based_on.select(F.col("schema").alias("source"))).distinct()
    above = reach(based_on.select(F.col("schema").alias("a"), F.col("base").alias("b")), schemas, include_seeds=True)
    own = definitions.withColumnRenamed("schema", "origin")
    held = above.join(own, above["node"] == own["origin"]).drop("node").withColumnsRenamed({"source": "schema", "depth": "distance"})
    # which IRI a keyword stands for in a schema; what is no keyword (a class without any) has no say
    keyed = Window.partitionBy("schema", "keyword")
    order = [F.desc("distance")] if redefine == "skip" else [F.asc("distance")]
    chosen = F.first("iri").over(keyed.orderBy(*order, "origin", "iri"))
    clash = (F.min("iri").over(keyed) != F.max("iri").over(keyed)) & F.col("keyword").isNotNull()
    if redefine == "raise":
        message = F.concat(F.lit("keyword defined twice: "), F.col("schema"), F.lit(" "), F.col("keyword"))
        chosen = F.when(F.coalesce(clash, F.lit(False)), F.raise_error(message)).otherwise(F.col("iri"))
    held = held.withColumn("__iri", chosen).where("keyword IS NULL OR iri = __iri").drop("__iri")
    # of one class's definitions of a keyword the nearest schema's counts
    nearest = Window.partitionBy("schema", "cls", "keyword").orderBy("distance", "origin")
    return held.withColumn("__n", F.row_number().over(nearest)).where("__n = 1").drop("__n")


def inherit(resolved: DataFrame, parents: DataFrame) -> DataFrame:
    """schema, cls and its keywords, with ``domain`` (the class that defines it) and ``above`` (steps up to that class).

    ``parents`` has cls and parent. A keyword that is met again further up keeps its nearest definition.
    """
    classes = resolved.select(F.col("cls").alias("source")).unionByName(parents.select(F.col("cls").alias("source"))).distinct()
    up = reach(parents.select(F.col("cls").alias("a"), F.col("parent").alias("b")), classes, include_seeds=True)
    words = resolved.where("keyword IS NOT NULL").withColumnRenamed("cls", "domain")
    held = up.withColumnsRenamed({"source": "cls", "depth": "above"}).join(words, F.col("node") == F.col("domain")).drop("node")
    nearest = Window.partitionBy("schema", "cls", "keyword").orderBy("above", "domain")
    return held.withColumn("__n", F.row_number().over(nearest)).where("__n = 1").drop("__n")


def keywords(inherited: DataFrame, schema: str | None = None, classes: list[str] | None = None, themes: list[str] | None = None) -> DataFrame:
    """schema, keyword, iri, datatype, the classes it may be used on (``domains``) and the strongest conformance among them.

    Limited to a schema, to some classes, to definitions of some themes.
    """
    rows = inherited
    rows = rows if schema is None else rows.where(F.col("schema") == schema)
    rows = rows if classes is None else rows.where(F.col("cls").isin(classes))
    rows = rows if themes is None else rows.where(F.col("theme").isin(themes))
    level = F.coalesce(F.array_position(F.array(*map(F.lit, CONFORMANCE)), F.col("conformance")), F.lit(len(CONFORMANCE)))
    out = rows.groupBy("schema", "keyword", "iri").agg(F.min("datatype").alias("datatype"), F.array_sort(F.collect_set("domain")).alias("domains"), F.min(level).cast("int").alias("level"))
    return out.select("schema", "keyword", "iri", "datatype", "domains", F.element_at(F.array(*map(F.lit, CONFORMANCE)), F.col("level")).alias("conformance"))


def lacking(triples: DataFrame, inherited: DataFrame, schema: str) -> DataFrame:
    """s, keyword and conformance of mandatory and recommended keywords that resources of a class (or one below it) lack: one semi- and one anti-join for all of them."""
    asked = inherited.where((F.col("schema") == schema) & F.col("conformance").isin(*CONFORMANCE[:2])).select("cls", "keyword", "iri", "conformance")
    typed = triples.where(F.col("p") == PREFIXES["rdf"] + "type").select("s", F.col("o").alias("cls")).distinct()
    wanted = typed.join(asked, "cls").groupBy("s", "keyword", "iri").agg(F.min("conformance").alias("conformance"))
    have = triples.join(asked.select(F.col("iri").alias("p")).distinct(), "p", "left_semi").select("s", F.col("p").alias("iri")).distinct()
    return wanted.join(have, ["s", "iri"], "left_anti").select("s", "keyword", "conformance")


# -- writers -------------------------------------------------------------------------------------


def as_documents(resolved: DataFrame, parents: DataFrame) -> DataFrame:
    """schema and json: each resolved schema as one document of resources and keywords, which ``tables`` reads back (JSON is YAML)."""
    word = F.struct(F.col("iri").alias("iri"), F.when(F.col("datatype") != "@id", F.col("datatype")).alias("datatype"), F.when(F.col("datatype") == "@id", F.lit("owl:Thing")).alias("range"), "conformance", "description")
    words = resolved.groupBy("schema", "cls", "cls_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("keyword").isNotNull(), F.struct("keyword", word.alias("word")))))).alias("keywords"))
    up = parents.groupBy("cls").agg(F.array_sort(F.collect_set("parent")).alias("subClassOf"))
    classes = words.join(up, "cls", "left").select("schema", F.struct(F.col("cls_name").alias("name"), F.struct(F.col("cls").alias("iri"), "subClassOf", "keywords").alias("spec")).alias("c"))
    return classes.groupBy("schema").agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list("c"), lambda x, y: F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))).alias("resources"))).alias("json"))


def from_documents(documents: list) -> dict[str, dict]:
    """Mappings from collected rows of ``as_documents``, as ``tables`` takes them."""
    return {r["schema"]: json.loads(r["json"]) for r in documents}


def as_triples(resolved: DataFrame, parents: DataFrame) -> DataFrame:
    """s, p and o: classes, superclasses, and properties with their domains, ranges, labels and comments."""
    rdf, rdfs, owl, xsd = PREFIXES["rdf"], PREFIXES["rdfs"], PREFIXES["owl"], PREFIXES["xsd"]
    cell = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    word, cls = F.col("iri"), F.col("cls")
    cells = F.array(
        cell(cls, rdf + "type", F.lit(owl + "Class")), cell(cls, rdfs + "label", text(F.col("cls_name"))),
        cell(word, rdf + "type", F.when(F.col("datatype") == "@id", owl + "ObjectProperty").otherwise(owl + "DatatypeProperty")), cell(word, rdfs + "domain", cls), cell(word, rdfs + "label", text(F.col("keyword"))),
        cell(word, rdfs + "range", F.when(F.col("datatype").startswith(xsd), F.col("datatype"))), cell(word, rdfs + "comment", text(F.col("description"))),
    )
    flat = resolved.select(F.inline(cells)).where("s IS NOT NULL AND o IS NOT NULL")
    return flat.unionByName(parents.select(F.col("cls").alias("s"), F.lit(rdfs + "subClassOf").alias("p"), F.col("parent").alias("o"))).distinct()
