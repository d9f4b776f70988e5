"""Steps whose plans must hold for large tables."""

from pyspark.sql import functions as F

from graphloom.operators import jsonld, quantities
from graphloom.workspace import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compressible_tables_are_not_broadcast(spark):
    rows = spark.range(150_000).select(F.concat(F.lit("http://example.com/" + "a" * 100), F.col("id").cast("string")).alias("s"), F.lit("p" * 100).alias("p"))
    joined = written(rows, "one").join(written(rows, "two").withColumnRenamed("p", "q"), "s")
    assert "BroadcastHashJoin" not in plan(joined)
    assert joined.count() == 150_000


def test_documents_are_dealt_before_they_are_parsed(spark):
    docs = spark.createDataFrame([(i, '{"@id": "a"}') for i in range(10)], "id int, doc string").coalesce(1)
    text = plan(jsonld._roots(docs, "id", "doc"))
    assert text.index("Generate") < text.index("Exchange hashpartitioning(id")


def test_quantities_are_dealt_before_they_become_triples(spark):
    rows = spark.createDataFrame([("a", "t", 1.0, "u"), ("b", "t", 2.0, "u")], "iri string, type string, value double, unit string")
    out = quantities.quantities(quantities.quantity_triples(rows))
    text = plan(out)
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")
    assert sorted(map(tuple, out.collect())) == [("a", "t", 1.0, "u"), ("b", "t", 2.0, "u")]


def test_keys_of_units_have_a_known_size(spark):
    table = spark.createDataFrame([("i", "Metre", ["m."], ["m"], [])], "iri string, name string, aliases array<string>, symbols array<string>, codes array<string>")
    out = quantities.find_unit(spark.createDataFrame([("metre",), ("x",)], "unit string"), table)
    assert "unit-keys-" in plan(out) and "asked-" in plan(out)
    assert sorted(map(tuple, out.collect())) == [("metre", "i"), ("x", None)]
