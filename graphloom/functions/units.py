"""Units as a table, and conversion as column arithmetic.

A unit is a row: name, symbol, dimension (seven integer exponents of time, length, mass, current,
temperature, amount and luminous intensity), multiplier and offset to the base unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "TLMIΘNJ"
#: Base unit names in the order of the exponents.
BASE_UNITS = ("Second", "Metre", "Kilogram", "Ampere", "Kelvin", "Mole", "Candela")
SCHEMA = "name string, symbol string, dimension array<int>, multiplier double, offset double"

#: A small set of common units.
COMMON = [
    ("Metre", "m", [0, 1, 0, 0, 0, 0, 0], 1.0, 0.0), ("Centimetre", "cm", [0, 1, 0, 0, 0, 0, 0], 0.01, 0.0), ("Kilometre", "km", [0, 1, 0, 0, 0, 0, 0], 1000.0, 0.0),
    ("Inch", "in", [0, 1, 0, 0, 0, 0, 0], 0.0254, 0.0), ("Second", "s", [1, 0, 0, 0, 0, 0, 0], 1.0, 0.0), ("Minute", "min", [1, 0, 0, 0, 0, 0, 0], 60.0, 0.0),
    ("Hour", "h", [1, 0, 0, 0, 0, 0, 0], 3600.0, 0.0), ("Kilogram", "kg", [0, 0, 1, 0, 0, 0, 0], 1.0, 0.0), ("Gram", "g", [0, 0, 1, 0, 0, 0, 0], 0.001, 0.0),
    ("Ampere", "A", [0, 0, 0, 1, 0, 0, 0], 1.0, 0.0), ("Kelvin", "K", [0, 0, 0, 0, 1, 0, 0], 1.0, 0.0), ("DegreeCelsius", "°C", [0, 0, 0, 0, 1, 0, 0], 1.0, 273.15),
    ("DegreeFahrenheit", "°F", [0, 0, 0, 0, 1, 0, 0], 5.0 / 9.0, 459.67 * 5.0 / 9.0), ("Mole", "mol", [0, 0, 0, 0, 0, 1, 0], 1.0, 0.0), ("Candela", "cd", [0, 0, 0, 0, 0, 0, 1], 1.0, 0.0),
    ("Newton", "N", [-2, 1, 1, 0, 0, 0, 0], 1.0, 0.0), ("Joule", "J", [-2, 2, 1, 0, 0, 0, 0], 1.0, 0.0), ("Watt", "W", [-3, 2, 1, 0, 0, 0, 0], 1.0, 0.0),
    ("Volt", "V", [-3, 2, 1, -1, 0, 0, 0], 1.0, 0.0), ("Pascal", "Pa", [-2, -1, 1, 0, 0, 0, 0], 1.0, 0.0), ("Bar", "bar", [-2, -1, 1, 0, 0, 0, 0], 1e5, 0.0),
]


def table(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(COMMON if rows is None else rows, SCHEMA)


def parse_dimension(text: Column) -> Column:
    """Exponents of a dimension string such as ``T-2 L+1 M+1 I0 Θ0 N0 J0``; NULL if one is missing."""
    parts = [F.regexp_extract(text, s + r"([+-]?[0-9]+)", 1).try_cast("int") for s in SYMBOLS]
    whole = F.array(*parts)
    return F.when(F.forall(whole, lambda x: x.isNotNull()), whole)


def base_expression(dimension: Column) -> Column:
    """A dimension as a product of base units, such as ``Metre * Second**-2``; ``1`` without any."""
    powers = F.transform(dimension, lambda p, i: F.when(p == 1, F.element_at(F.array(*map(F.lit, BASE_UNITS)), i + 1)).when(p != 0, F.concat(F.element_at(F.array(*map(F.lit, BASE_UNITS)), i + 1), F.lit("**"), p.cast("string"))))
    out = F.array_join(F.filter(powers, lambda x: x.isNotNull()), " * ")
    return F.when(out == "", "1").otherwise(out)


def convert(df: DataFrame, units: DataFrame, value: str, source: str, target: str, out: str = "converted") -> DataFrame:
    """``value`` of unit ``source`` in unit ``target`` (columns of names or symbols); NULL where they do not fit.

    The unit table is small by nature; it is broadcast only if it is.
    """
    flat = units.select(F.explode(F.array_distinct(F.array("name", "symbol"))).alias("unit"), "dimension", "multiplier", "offset")
    if flat.count() <= 100_000:
        flat = F.broadcast(flat)
    side = lambda n: flat.select(F.col("unit").alias(f"__{n}"), *[F.col(c).alias(f"__{n}_{c}") for c in ("dimension", "multiplier", "offset")])
    joined = df.join(side("a"), F.col(source) == F.col("__a"), "left").join(side("b"), F.col(target) == F.col("__b"), "left")
    base = F.col(value) * F.col("__a_multiplier") + F.col("__a_offset")
    result = F.when(F.col("__a_dimension") == F.col("__b_dimension"), (base - F.col("__b_offset")) / F.col("__b_multiplier"))
    return joined.withColumn(out, result).select(*df.columns, out)


def simplest(df: DataFrame, units: DataFrame, magnitude: str, dimension: str, out: str = "unit") -> DataFrame:
    """The unit of the same dimension in which a magnitude (in base units) is nearest to 5, by order of size, then name."""
    flat = units.where("offset = 0 AND multiplier > 0").select(F.col("dimension").alias("__d"), F.col("name").alias("__name"), F.col("multiplier").alias("__m"))
    by_dim = flat.groupBy("__d").agg(F.collect_list(F.struct("__name", "__m")).alias("__units"))
    score = lambda u: F.struct(F.abs(F.log10(F.abs(F.col(magnitude)) / u["__m"] / 5)).alias("score"), u["__name"].alias("name"))
    best = F.array_min(F.transform("__units", score))
    return df.join(by_dim, df[dimension] == F.col("__d"), "left").withColumn(out, F.when(F.col(magnitude) == 0, F.array_min(F.transform("__units", lambda u: u["__name"]))).otherwise(best["name"])).select(*df.columns, out)


def parse_quantity(text: Column) -> Column:
    """A struct of magnitude and unit from text such as ``2.5 m/s``."""
    return F.struct(F.regexp_extract(text, r"^\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double").alias("magnitude"), F.trim(F.regexp_extract(text, r"^\s*[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?\s*(.*)$", 1)).alias("unit"))
