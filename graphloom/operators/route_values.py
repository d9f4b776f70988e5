"""Values of targets through mapping routes, with units.

A route is a list of steps from the target back to its sources, each input after the step that takes it. Read from its
end it is a program for a stack: a value is pushed, a function takes its arguments from the top and pushes its result, a
mapping passes what is there. All targets are evaluated at once by one column expression over their routes, in which each
registered function is a branch. Quantities are held in base units with their dimension, so an argument is converted to the
unit that the function expects, and the result to the one that was asked for; where dimensions don't fit the value is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.compound import UnitRegistry
from graphloom.functions.registry import Entry, Registry
from graphloom.functions.units import base_expression
from graphloom.operators import quantities
from graphloom.workspace import written

ELEMENT = "struct<v:double,d:array<int>>"


def sources_of(triples: DataFrame, vocabulary: quantities.Vocabulary = quantities.EMMO) -> DataFrame:
    """node, value and unit of all individuals that have a value, as ``evaluate`` takes them."""
    return quantities.quantities(triples, vocabulary).select(F.col("iri").alias("node"), "value", F.element_at(F.split("unit", "[/#]"), -1).alias("unit"))


def _constants(registry: Registry, units: UnitRegistry, spark) -> dict[str, tuple]:
    """Dimension, multiplier and offset of the units that functions name: as many as there are in the registry."""
    names = {u for e in registry.entries.values() for u in [*(e.input_units or ()), e.output_unit] if u}
    if not names:
        return {}
    rows = units.resolve(spark.createDataFrame([(n,) for n in sorted(names)], "unit string"), "unit").collect()
    bad = [r["unit"] for r in rows if r["meaning"] is None or r["meaning"]["multiplier"] is None]
    if bad:
        raise ValueError(f"unknown units: {bad}")
    return {r["unit"]: (list(r["meaning"]["dimension"]), r["meaning"]["multiplier"], r["meaning"]["offset"]) for r in rows}


def _applied(entry: Entry, stack: Column, known: dict[str, tuple]) -> Column:
    """The element that a function makes of the stack's first elements."""
    args = []
    for i in range(len(entry.inputs)):
        element, unit = F.get(stack, F.lit(i)), (entry.input_units or [None] * len(entry.inputs))[i]
        if unit:
            dimension, multiplier, offset = known[unit]
            same = element["d"] == F.array(*map(F.lit, dimension))
            args.append(F.when(same, (element["v"] - offset) / multiplier))
        else:
            args.append(element["v"])
    made = entry.call(*args).cast("double")
    if entry.output_unit:
        dimension, multiplier, offset = known[entry.output_unit]
        return F.struct((made * multiplier + offset).alias("v"), F.array(*map(F.lit, dimension)).cast("array<int>").alias("d")).cast(ELEMENT)
    return F.struct(made.alias("v"), F.lit(None).cast("array<int>").alias("d")).cast(ELEMENT)


def evaluate(routes: DataFrame, sources: DataFrame, registry: Registry, units: UnitRegistry, targets: DataFrame | None = None) -> DataFrame:
    """target, rank, value and unit of every route (as ``routes.cheapest`` gives them: target, rank, route).

    ``sources`` has node, value and unit (NULL: a plain number). ``targets`` may name a unit for each target (node, unit);
    without one a value comes in base units, whose product is told. A value without a unit stays a plain number.
    """
    known = _constants(registry, units, routes.sparkSession)
    routes = written(routes, "found")
    given = units.resolve(sources.select("node", F.col("value").cast("double").alias("value"), "unit"), "unit")
    plain = F.col("unit").isNull()
    base = F.when(plain, F.col("value")).otherwise(F.col("value") * F.col("meaning.multiplier") + F.col("meaning.offset"))
    given = given.select(F.col("node").alias("__node"), F.struct(base.alias("v"), F.when(~plain, F.col("meaning.dimension")).alias("d")).cast(ELEMENT).alias("element"))
    steps = routes.select("target", "rank", F.posexplode("route").alias("place", "step")).where(F.col("step").startswith("value "))
    met = steps.withColumn("__node", F.substr("step", F.lit(7))).join(given, "__node").groupBy("target", "rank").agg(F.map_from_entries(F.collect_list(F.struct("place", "element"))).alias("given"))
    rows = routes.select("target", "rank", "route").join(met, ["target", "rank"], "left")

    def turn(stack: Column, place: Column) -> Column:
        step = F.get("route", place)
        name = F.substr(step, F.instr(step, " ") + 1)
        out = F.when(F.substring_index(step, " ", 1) == "value", F.concat(F.array(F.try_element_at("given", place)), stack))
        for iri, entry in registry.entries.items():
            taken = len(entry.inputs)
            rest = F.slice(stack, F.lit(taken + 1), F.greatest(F.size(stack) - taken, F.lit(0)))
            out = out.when((F.substring_index(step, " ", 1) == "function") & (name == iri), F.concat(F.array(_applied(entry, stack, known)), rest))
        # a function that is not registered has no value
        return out.when(F.substring_index(step, " ", 1) == "function", F.array(F.lit(None).cast(ELEMENT))).otherwise(stack)

    places = F.sequence(F.size("route") - 1, F.lit(0), F.lit(-1))
    rows = rows.select("target", "rank", F.get(F.aggregate(places, F.array().cast(f"array<{ELEMENT}>"), turn), F.lit(0)).alias("e"))
    if targets is not None:
        rows = units.resolve(rows.join(targets.select(F.col("node").alias("target"), F.col("unit").alias("asked")), "target", "left"), "asked", "m")
    else:
        rows = rows.withColumns({"asked": F.lit(None).cast("string"), "m": F.lit(None).cast("struct<dimension:array<int>,multiplier:double,offset:double>")})
    fits = F.when(F.col("e.d") == F.col("m.dimension"), (F.col("e.v") - F.col("m.offset")) / F.col("m.multiplier"))
    value = F.when(F.col("asked").isNull() | F.col("e.d").isNull(), F.col("e.v")).otherwise(fits)
    unit = F.when(F.col("e.d").isNull(), F.lit(None)).otherwise(F.coalesce("asked", base_expression(F.col("e.d"))))
    return rows.select("target", "rank", value.alias("value"), unit.alias("unit"))
