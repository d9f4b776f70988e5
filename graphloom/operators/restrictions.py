"""OWL restrictions on triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES

OWL, RDF, RDFS, XSD = (PREFIXES[p] for p in ("owl", "rdf", "rdfs", "xsd"))

#: Predicates that carry the target and the cardinality of each type. The second target
#: spellings of "some" and "only" are read, never written.
TARGETS = {
    "some": (OWL + "someValuesFrom", OWL + "someValueFrom"), "only": (OWL + "allValuesFrom", OWL + "allValueFrom"), "value": (OWL + "hasValue",),
    "exactly": (OWL + "onClass",), "min": (OWL + "onClass",), "max": (OWL + "onClass",),
}
CARDINALITIES = {"exactly": OWL + "qualifiedCardinality", "min": OWL + "minQualifiedCardinality", "max": OWL + "maxQualifiedCardinality"}


def restrictions(triples: DataFrame, cls=None, property=None, value=None, type: str | None = None, cardinality: int | None = None) -> DataFrame:
    """iri, cls, property, type, value and cardinality of every restriction that a class is below.

    One grouped scan of the restriction nodes replaces a probe for each: wide rows are built by
    conditional aggregation over the handful of OWL predicates, then joined to the classes.
    """
    if cardinality is not None and type not in CARDINALITIES:
        raise ValueError("a cardinality goes with exactly, min or max")
    wanted = [OWL + "onProperty", *{p for t in TARGETS.values() for p in t}, *CARDINALITIES.values()]
    rows = triples.where(F.col("p").isin(wanted))
    pick = lambda *ps: F.max(F.when(F.col("p").isin(*ps), F.col("o")))
    wide = rows.groupBy("s").agg(
        pick(OWL + "onProperty").alias("property"), *[pick(*TARGETS[t]).alias(t) for t in ("some", "only", "value")], pick(OWL + "onClass").alias("on"),
        *[pick(p).alias("n_" + t) for t, p in CARDINALITIES.items()],
    )
    kinds = F.coalesce(
        F.when(F.col("some").isNotNull(), "some"), F.when(F.col("only").isNotNull(), "only"), F.when(F.col("value").isNotNull(), "value"),
        *[F.when(F.col("n_" + t).isNotNull(), t) for t in CARDINALITIES],
    )
    number = terms.integer(F.coalesce(*[F.col("n_" + t) for t in CARDINALITIES]))
    found = wide.where("property IS NOT NULL").select(F.col("s").alias("iri"), "property", kinds.alias("type"), F.coalesce("some", "only", "value", "on").alias("value"), number.alias("cardinality"))
    below = triples.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("cls"), F.col("o").alias("iri"))
    out = found.join(below, "iri")
    for column, wish in (("cls", cls), ("property", property), ("value", value), ("type", type), ("cardinality", cardinality)):
        if wish is not None:
            out = out.where(F.col(column) == wish)
    return out.where("type IS NOT NULL").select("iri", "cls", "property", "type", "value", "cardinality")


def restriction_triples(rows: DataFrame, type: str) -> DataFrame:
    """Triples that put each row's class below a restriction (columns cls, property, value and, if counted, cardinality).

    The restriction's blank node is named by a digest of its parts, so equal ones coincide.
    """
    counted = type in CARDINALITIES
    parts = [F.col("cls"), F.col("property"), F.col("value"), F.lit(type)] + ([F.col("cardinality").cast("string")] if counted else [])
    node = F.concat(F.lit("_:restriction_"), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32)))
    made = [
        (F.col("cls"), RDFS + "subClassOf", node), (node, RDF + "type", F.lit(OWL + "Restriction")),
        (node, OWL + "onProperty", F.col("property")), (node, TARGETS[type][0], F.col("value")),
    ]
    if counted:
        made.append((node, CARDINALITIES[type], terms.literal(F.col("cardinality"), XSD + "nonNegativeInteger")))
    return rows.select(F.inline(F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in made]))).distinct()
