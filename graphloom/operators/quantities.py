"""Units and quantities described by an ontology.

Units are classes below a root class; their symbols, codes, dimensions and conversions are literals of
the class. The tables below are one scan of the triples each: closure, anti-join and one pivot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms, units
from graphloom.functions.names import PREFIXES
from graphloom.operators.closure import edges_of, reach
from graphloom.workspace import written

SUB_CLASS = PREFIXES["rdfs"] + "subClassOf"
TYPE = PREFIXES["rdf"] + "type"


@dataclass
class Vocabulary:
    """Predicates and classes that describe units and quantities."""

    unit: str = PREFIXES["emmo"] + "DimensionalUnit"
    quantity: str = PREFIXES["emmo"] + "Quantity"
    label: str = PREFIXES["skos"] + "prefLabel"
    other_label: str = PREFIXES["skos"] + "altLabel"
    symbol: str = PREFIXES["emmo"] + "unitSymbol"
    code: str = PREFIXES["emmo"] + "uneceCommonCode"
    dimension: str = PREFIXES["emmo"] + "hasDimensionString"
    multiplier: str = PREFIXES["emmo"] + "hasSIConversionMultiplier"
    offset: str = PREFIXES["emmo"] + "hasSIConversionOffset"
    value: str = PREFIXES["emmo"] + "hasNumericalValue"
    has_unit: str = PREFIXES["emmo"] + "hasMeasurementUnit"


EMMO = Vocabulary()


def classes_below(triples: DataFrame, root: str, without: list[str] = ()) -> DataFrame:
    """iri of every named class below ``root`` that is not below one of ``without``."""
    down = edges_of(triples, [SUB_CLASS], inverse=True)
    spark = triples.sparkSession
    found = reach(down, spark.createDataFrame([(root,)], "source string")).select(F.col("node").alias("iri"))
    found = found.where(~F.col("iri").startswith("_:")).distinct()
    if without:
        gone = reach(down, spark.createDataFrame([(x,) for x in without], "source string"), include_seeds=True).select(F.col("node").alias("iri"))
        found = found.join(gone, "iri", "left_anti")
    return found


def unit_table(triples: DataFrame, vocabulary: Vocabulary = EMMO, without: list[str] = ()) -> DataFrame:
    """One row per unit: iri, name, aliases, symbols, codes, dimension, multiplier and offset (1 and 0 where not stated).

    The table has the columns that ``units.convert`` and ``units.simplest`` need.
    """
    v = vocabulary
    wanted = [v.label, v.other_label, v.symbol, v.code, v.dimension, v.multiplier, v.offset]
    rows = triples.where(F.col("p").isin(wanted)).join(classes_below(triples, v.unit, without).withColumnRenamed("iri", "s"), "s", "left_semi")
    text = terms.lexical(F.col("o"))
    some = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, text)))
    one = lambda p: F.min(F.when(F.col("p") == p, text))
    out = rows.groupBy(F.col("s").alias("iri")).agg(
        one(v.label).alias("name"), some(v.other_label).alias("aliases"), some(v.symbol).alias("symbols"), some(v.code).alias("codes"),
        units.parse_dimension(one(v.dimension)).alias("dimension"), one(v.multiplier).try_cast("double").alias("multiplier"), one(v.offset).try_cast("double").alias("offset"),
    )
    return out.withColumns({"symbol": F.get("symbols", F.lit(0)), "multiplier": F.coalesce("multiplier", F.lit(1.0)), "offset": F.coalesce("offset", F.lit(0.0))})


def quantity_table(triples: DataFrame, vocabulary: Vocabulary = EMMO) -> DataFrame:
    """One row per quantity class: iri, name, aliases and dimension."""
    v = vocabulary
    rows = triples.where(F.col("p").isin(v.label, v.other_label, v.dimension)).join(classes_below(triples, v.quantity).withColumnRenamed("iri", "s"), "s", "left_semi")
    text = terms.lexical(F.col("o"))
    return rows.groupBy(F.col("s").alias("iri")).agg(
        F.min(F.when(F.col("p") == v.label, text)).alias("name"), F.array_sort(F.collect_set(F.when(F.col("p") == v.other_label, text))).alias("aliases"),
        units.parse_dimension(F.min(F.when(F.col("p") == v.dimension, text))).alias("dimension"),
    )


def find_unit(names: DataFrame, table: DataFrame, name: str = "unit") -> DataFrame:
    """Each row of ``names`` with the ``iri`` of the unit that its text names, or NULL.

    A unit is meant by its IRI, name, alias, symbol or code, in this order, and else by its name in any
    case; of several the one with the least IRI.
    """
    kinds = [F.array("iri"), F.array("name"), F.col("aliases"), F.col("symbols"), F.col("codes"), F.transform(F.array("name"), F.lower)]
    ranked = lambda k, i: F.transform(k, lambda x: F.struct(F.lit(i).alias("rank"), x.alias("key")))
    keys = F.flatten(F.array(*[ranked(k, i) for i, k in enumerate(kinds)]))
    flat = table.select("iri", F.inline(keys)).where("key IS NOT NULL")
    # written, so that joins know their sizes
    best = written(flat.groupBy("rank", "key").agg(F.min("iri").alias("iri")), "unit-keys")
    asked = written(names.select(F.col(name).alias("asked")).distinct(), "asked")
    hits = asked.join(best.where("rank < 5"), F.col("asked") == F.col("key")).select("asked", "rank", "iri")
    hits = hits.unionByName(asked.join(best.where("rank = 5"), F.lower("asked") == F.col("key")).select("asked", "rank", "iri"))
    first = hits.groupBy("asked").agg(F.min(F.struct("rank", "iri")).alias("b")).select("asked", F.col("b.iri").alias("iri"))
    return names.join(first, F.col(name) == F.col("asked"), "left").drop("asked")


#: Decimal prefixes of unit names.
FACTORS = {"Quetta": 1e30, "Ronna": 1e27, "Yotta": 1e24, "Zetta": 1e21, "Exa": 1e18, "Peta": 1e15, "Tera": 1e12, "Giga": 1e9, "Mega": 1e6, "Kilo": 1e3, "Hecto": 1e2, "Deca": 1e1, "Deci": 1e-1, "Centi": 1e-2, "Milli": 1e-3, "Micro": 1e-6, "Nano": 1e-9, "Pico": 1e-12, "Femto": 1e-15, "Atto": 1e-18, "Zepto": 1e-21, "Yocto": 1e-24, "Ronto": 1e-27, "Quecto": 1e-30}
#: Words for powers in unit names, which stand before the unit they raise.
POWERS = {"Square": 2, "Cube": 3, "Cubic": 3, "Quartic": 4, "Quintic": 5, "Sextic": 6, "Septic": 7, "Heptic": 7, "Octic": 8, "Nonic": 9}


def parse_unit_name(name: Column) -> Column:
    """A struct of factor and parts (unit, power) of a name in camel case, such as ``KiloGramPerCubicMetre``.

    What is no prefix, power, ``Per`` or ``Reciprocal`` counts as a unit; ``UnitRegistry.resolve`` asks a table instead.
    """
    words = F.regexp_extract_all(name, F.lit("[A-Z][a-z0-9]*"), F.lit(0))
    table = F.create_map(*[x for k, v in FACTORS.items() for x in (F.lit(k), F.lit(v))])
    powers = F.create_map(*[x for k, v in POWERS.items() for x in (F.lit(k), F.lit(v))])
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(1).alias("sign"), F.lit(1).alias("power"), F.array().cast("array<struct<unit:string,power:int>>").alias("parts"))

    def step(acc: Column, w: Column) -> Column:
        inverse = w.isin("Per", "Reciprocal")
        sign = F.when(inverse, F.lit(-1)).otherwise(acc["sign"])
        raised = powers[w]
        is_prefix = table[w].isNotNull()
        unit = ~inverse & raised.isNull() & ~is_prefix
        # a prefix counts as often as the unit that follows is raised
        factor = F.when(is_prefix, acc["factor"] * F.pow(table[w], acc["power"] * sign)).otherwise(acc["factor"])
        parts = F.when(unit, F.concat(acc["parts"], F.array(F.struct(w.alias("unit"), (acc["power"] * sign).cast("int").alias("power"))))).otherwise(acc["parts"])
        return F.struct(factor.alias("factor"), sign.alias("sign"), F.when(unit | inverse, 1).otherwise(F.coalesce(raised, acc["power"])).alias("power"), parts.alias("parts"))

    return F.aggregate(words, start, step, lambda acc: F.struct(acc["factor"].alias("factor"), acc["parts"].alias("parts")))


def quantity_triples(rows: DataFrame, vocabulary: Vocabulary = EMMO) -> DataFrame:
    """Triples of quantities (columns iri, type, value, unit; iris in the first two and the last): individuals with a numerical value and a unit."""
    v = vocabulary
    cells = F.array(
        F.struct(F.lit(TYPE).alias("p"), F.col("type").alias("o")),
        F.struct(F.lit(v.value).alias("p"), terms.from_native(F.col("value").cast("double"), "double").alias("o")),
        F.struct(F.lit(v.has_unit).alias("p"), F.col("unit").alias("o")),
    )
    # rows are dealt out before each becomes three: a table may be one row group, which one task would sort alone
    return rows.repartition("iri").select(F.col("iri").alias("s"), F.inline(cells)).where("s IS NOT NULL AND o IS NOT NULL")


def quantities(triples: DataFrame, vocabulary: Vocabulary = EMMO) -> DataFrame:
    """iri, type, value and unit of all individuals with a numerical value and a unit."""
    v = vocabulary
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    rows = triples.where(F.col("p").isin(TYPE, v.value, v.has_unit)).groupBy(F.col("s").alias("iri")).agg(pick(TYPE).alias("type"), pick(v.value).alias("value"), pick(v.has_unit).alias("unit"))
    return rows.where("value IS NOT NULL AND unit IS NOT NULL").withColumn("value", terms.number(F.col("value")))


def unit_lines(table: DataFrame) -> DataFrame:
    """Lines of a unit definition file (column value): ``name = multiplier * base units; offset: x = symbol = aliases``."""
    base = units.base_expression(F.col("dimension"))
    offset = F.when(F.col("offset") != 0, F.concat(F.lit("; offset: "), F.col("offset").cast("string"))).otherwise("")
    head = F.concat(F.col("name"), F.lit(" = "), F.col("multiplier").cast("string"), F.lit(" * "), base, offset, F.lit(" = "), F.coalesce("symbol", F.lit("_")))
    more = F.array_join(F.transform("aliases", lambda x: F.concat(F.lit(" = "), F.regexp_replace(x, r"\s+", "_"))), "")
    return table.where("name IS NOT NULL AND dimension IS NOT NULL").select(F.concat(head, more).alias("value"))
