"""Functions, mappings and data sources as triples, and restrictions and schemas taken from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES
from graphloom.operators import routes

TYPE = PREFIXES["rdf"] + "type"
RDF, RDFS, OWL, FNO, EMMO = (PREFIXES[k] for k in ("rdf", "rdfs", "owl", "fno", "emmo"))


def _flat(rows: DataFrame, cells: list[tuple]) -> DataFrame:
    made = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in cells])
    return rows.select(F.inline(made)).where("s IS NOT NULL AND o IS NOT NULL")


def map_triples(rows: DataFrame, maps_to: str = routes.MAPS_TO) -> DataFrame:
    """Mapping edges from columns source, target and cost (NULL: the default); a cost hangs on the source."""
    return _flat(rows, [(F.col("source"), maps_to, F.col("target")), (F.col("source"), routes.HAS_COST, terms.from_native(F.col("cost").cast("double"), "double"))]).distinct()


def function_triples(rows: DataFrame, standard: str = "emmo") -> DataFrame:
    """Descriptions of functions (function, name, inputs array, output, cost) in one of two vocabularies.

    ``emmo`` states inputs and outputs directly; ``fno`` orders the inputs in an RDF list.
    """
    common = _flat(rows, [
        (F.col("function"), RDFS + "label", terms.literal(F.col("name"), lang="en")),
        (F.col("function"), routes.HAS_COST, terms.from_native(F.col("cost").cast("double"), "double")),
        (F.col("function"), TYPE, F.lit(EMMO + "Computation" if standard == "emmo" else FNO + "Function")),
    ])
    if standard == "emmo":
        ins = rows.select(F.col("function").alias("s"), F.lit(EMMO + "hasInput").alias("p"), F.explode("inputs").alias("o"))
        outs = _flat(rows, [(F.col("function"), EMMO + "hasOutput", F.col("output"))])
        return common.unionByName(ins).unionByName(outs).distinct()
    if standard != "fno":
        raise ValueError(f"unknown vocabulary {standard!r}")
    cell = lambda n: F.concat(F.lit("_:in_"), F.md5("function"), F.lit("_"), n.cast("string"))
    outs = _flat(rows, [(F.col("function"), FNO + "expects", cell(F.lit(0))), (F.col("function"), FNO + "returns", F.col("output"))])
    placed = rows.select("function", F.size("inputs").alias("size"), F.posexplode("inputs").alias("n", "input"))
    ins = _flat(placed, [
        (cell(F.col("n")), RDF + "first", F.col("input")),
        (cell(F.col("n")), RDF + "rest", F.when(F.col("n") + 1 == F.col("size"), RDF + "nil").otherwise(cell(F.col("n") + 1))),
    ])
    return common.unionByName(outs).unionByName(ins).distinct()


def functions_of(store) -> DataFrame:
    """function, inputs, output and cost of all functions of a store, in either vocabulary; listed inputs keep their order."""
    triples = store.df
    plain = routes.functions_of(triples)
    heads = triples.where(F.col("p") == FNO + "expects").select(F.col("s").alias("function"), F.col("o").alias("head"))
    items = store.list_items(heads.select(F.col("head").alias("s")).distinct())
    ordered = items.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda x: x["item"]).alias("inputs"))
    outs = triples.where(F.col("p") == FNO + "returns").select(F.col("s").alias("function"), F.col("o").alias("output"))
    cost = triples.where(F.col("p") == routes.HAS_COST).groupBy(F.col("s").alias("function")).agg(F.min(terms.number(F.col("o"))).alias("cost"))
    listed = heads.join(ordered, "head").join(outs, "function").join(cost, "function", "left").select("function", "inputs", "output", "cost")
    return plain.unionByName(listed)


def data_triples(rows: DataFrame, value: str = EMMO + "hasNumericalValue", unit: str = EMMO + "hasMeasurementUnit") -> DataFrame:
    """Data sources (iri, type, value, unit) as individuals that a value hangs on."""
    return _flat(rows, [
        (F.col("iri"), TYPE, F.col("type")),
        (F.col("iri"), value, terms.from_native(F.col("value").cast("double"), "double")),
        (F.col("iri"), unit, F.col("unit")),
    ]).distinct()


def class_restrictions(documents: DataFrame) -> DataFrame:
    """cls, property, type, value and cardinality that relations of documented classes stand for.

    ``documents`` has cls, property, value and quantifier. The quantifier's words decide: ``some``, ``only``,
    ``value``, or ``exactly``, ``min`` or ``max`` with a number; without one a literal or an individual is a
    ``value`` and a class a ``some`` restriction.
    """
    words = F.split(F.trim(F.coalesce("quantifier", F.lit(""))), r"\s+")
    given = F.lower(words[0])
    guessed = F.when(F.col("value").startswith('"'), "value").otherwise("some")
    kind = F.when(given == "", guessed).when(given.isin("some", "only", "value", "exactly", "min", "max"), given)
    number = F.get(words, F.lit(1)).try_cast("bigint")
    counted = kind.isin("exactly", "min", "max")
    good = kind.isNotNull() & (counted == number.isNotNull())
    checked = F.when(good, kind).otherwise(F.raise_error(F.concat(F.lit("no restriction: "), F.coalesce("quantifier", F.lit("")))))
    return documents.select("cls", "property", checked.alias("type"), "value", F.when(counted, number).alias("cardinality"))


def schema_of(triples: DataFrame) -> DataFrame:
    """Keywords of a schema given as triples: iri, name, domain, range, label and comment of every property.

    A property is what has one of the property types; a name is its label, else its local name.
    """
    kinds = [RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"]
    named = triples.where((F.col("p") == TYPE) & F.col("o").isin(kinds)).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("kind"))
    text = terms.lexical(F.col("o"))
    pick = lambda p, c: F.min(F.when(F.col("p") == p, c))
    facts = triples.where(F.col("p").isin(*[RDFS + x for x in ("domain", "range", "label", "comment")])).groupBy(F.col("s").alias("iri")).agg(
        pick(RDFS + "domain", F.col("o")).alias("domain"), pick(RDFS + "range", F.col("o")).alias("range"), pick(RDFS + "label", text).alias("label"), pick(RDFS + "comment", text).alias("comment"),
    )
    out = named.join(facts, "iri", "left")
    local = F.regexp_extract("iri", "([^/#]*)$", 1)
    return out.select("iri", F.coalesce("label", local).alias("name"), F.substring_index("kind", "#", -1).alias("kind"), "domain", "range", "label", "comment")


def keywords_by(schema: DataFrame, parents: DataFrame, classes: list[str] | None = None, namespace: str | None = None) -> DataFrame:
    """Keywords whose domain is one of some classes or a class above one (``parents`` has a and b, from class to parent), in a namespace."""
    from graphloom.operators.closure import reach

    out = schema if namespace is None else schema.where(F.col("iri").startswith(namespace))
    if classes is None:
        return out
    above = reach(parents, schema.sparkSession.createDataFrame([(c,) for c in classes], "source string"), include_seeds=True)
    return out.join(above.select(F.col("node").alias("domain")).distinct(), "domain", "left_semi").select(*out.columns)


#: SPARQL's JSON form of a bound term.
BINDING = "type string, value string, `xml:lang` string, datatype string"


def from_binding(json: Column) -> Column:
    """A term from the JSON form of a query result's binding."""
    b = F.from_json(json, BINDING)
    kind = b["type"]
    lit = terms.quote(b["value"])
    literal = F.when(b["xml:lang"].isNotNull(), F.concat(lit, F.lit("@"), F.lower(b["xml:lang"]))).when(b["datatype"].isNotNull(), F.concat(lit, F.lit("^^<"), b["datatype"], F.lit(">"))).otherwise(lit)
    blank = F.when(b["value"].startswith("_:"), b["value"]).otherwise(F.concat(F.lit("_:"), b["value"]))
    return F.when(kind == "uri", b["value"]).when(kind == "bnode", blank).when(kind.isin("literal", "typed-literal"), literal)
