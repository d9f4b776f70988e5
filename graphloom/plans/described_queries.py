"""Queries for units, functions, mappings, schemas, terms and names over the relational test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names, terms, units
from graphloom.operators import described, quantities, restrictions, routes, store
from graphloom.operators.closure import edges_of, path_pairs
from graphloom.operators.lift import Lifted
from graphloom.operators.route_counts import route_counts

X = "http://example.com"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _iri(kind: str, column: str):
    return F.concat(F.lit(f"{X}/{kind}/"), F.col(column).cast("string"))


def _unit_ontology(spark, sf):
    """Parts as units, brands as the classes between them and the root; sizes give multipliers."""
    v, part = quantities.EMMO, _read(spark, sf, "part").repartition("p_partkey")
    cells = [
        (_iri("brand", "p_brand"), quantities.SUB_CLASS, F.lit(v.unit)),
        (_iri("unit", "p_partkey"), quantities.SUB_CLASS, _iri("brand", "p_brand")),
        (_iri("unit", "p_partkey"), v.label, terms.literal(F.concat(F.lit("Unit"), F.col("p_partkey").cast("string")), lang="en")),
        (_iri("unit", "p_partkey"), v.symbol, terms.literal(F.concat(F.lit("u"), F.col("p_partkey").cast("string")))),
        (_iri("unit", "p_partkey"), v.other_label, terms.literal(F.col("p_name"), lang="en")),
        (_iri("unit", "p_partkey"), v.dimension, terms.literal(F.concat(F.lit("T-2 L+1 M"), F.when(F.col("p_size") % 2 == 0, "+1").otherwise("0"), F.lit(" I0 Θ0 N0 J0")))),
        (_iri("unit", "p_partkey"), v.multiplier, terms.from_native(F.col("p_size").cast("double"), "double")),
    ]
    return described._flat(part, cells).distinct()


@query(f"""SELECT '{X}/unit/' || p_partkey AS iri, 'Unit' || p_partkey AS name, 'u' || p_partkey AS symbol, p_name AS alias, CASE WHEN p_size % 2 = 0 THEN 'Second**-2 * Metre * Kilogram' ELSE 'Second**-2 * Metre' END AS base,
    CAST(p_size AS DOUBLE) AS multiplier FROM part WHERE p_brand <> 'Brand#2'""")
def q58_unit_table(spark, sf):
    table = quantities.unit_table(_unit_ontology(spark, sf), without=[f"{X}/brand/Brand#2"])
    return table.select("iri", "name", "symbol", F.col("aliases")[0].alias("alias"), units.base_expression(F.col("dimension")).alias("base"), "multiplier")


@query(f"""WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'unit' || p_partkey WHEN 1 THEN 'u' || p_partkey WHEN 2 THEN 'Unit' || p_partkey ELSE 'nothing' || p_partkey END AS asked FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN '{X}/unit/' || p_partkey END AS iri FROM a""")
def q59_find_unit(spark, sf):
    key = F.col("p_partkey").cast("string")
    asked = _read(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 4 == 0, "unit").when(F.col("p_partkey") % 4 == 1, "u").when(F.col("p_partkey") % 4 == 2, "Unit").otherwise("nothing"), key).alias("unit"))
    return quantities.find_unit(asked, quantities.unit_table(_unit_ontology(spark, sf))).select("p_partkey", "iri")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1e-6 ELSE 1.0 END AS factor,
    CASE p_partkey % 3 WHEN 0 THEN 'Gram:1 Metre:-3' WHEN 1 THEN 'Metre:2' ELSE 'Newton:1 Metre:1' END AS parts FROM part""")
def q60_unit_names(spark, sf):
    k = F.col("p_partkey") % 3
    made = quantities.parse_unit_name(F.when(k == 0, "KiloGramPerCubicMetre").when(k == 1, "SquareMilliMetre").otherwise("NewtonMetre"))
    shown = F.array_join(F.transform(F.col("u.parts"), lambda x: F.concat_ws(":", x["unit"], x["power"].cast("string"))), " ")
    return _read(spark, sf, "part").select("p_partkey", made.alias("u")).select("p_partkey", F.col("u.factor").alias("factor"), shown.alias("parts"))


@query(f"SELECT '{X}/price/' || p_partkey AS iri, '{X}/type/' || p_type AS type, p_retailprice AS value, '{X}/unit/' || p_size AS unit FROM part")
def q61_quantities(spark, sf):
    rows = _read(spark, sf, "part").select(_iri("price", "p_partkey").alias("iri"), _iri("type", "p_type").alias("type"), F.col("p_retailprice").alias("value"), _iri("unit", "p_size").alias("unit"))
    return quantities.quantities(quantities.quantity_triples(rows))


@query(f"SELECT '{X}/f/' || n_nationkey AS function, '{X}/in/' || n_regionkey || ' {X}/in/a' || n_nationkey AS inputs, '{X}/out/' || n_nationkey AS output, CAST(n_nationkey AS DOUBLE) AS cost FROM nation")
def q62_functions_described(spark, sf):
    rows = _read(spark, sf, "nation")
    second = F.concat(F.lit(f"{X}/in/a"), F.col("n_nationkey").cast("string"))
    calls = rows.select(_iri("f", "n_nationkey").alias("function"), F.col("n_name").alias("name"), F.array(_iri("in", "n_regionkey"), second).alias("inputs"), _iri("out", "n_nationkey").alias("output"), F.col("n_nationkey").alias("cost"), F.col("n_nationkey").alias("n"))
    # half in either vocabulary
    made = described.function_triples(calls.where("n % 2 = 0")).unionByName(described.function_triples(calls.where("n % 2 = 1"), "fno"))
    out = described.functions_of(store.TripleStore(spark, made))
    return out.select("function", F.array_join("inputs", " ").alias("inputs"), "output", "cost")


@query(f"SELECT '{X}/region/' || n_regionkey AS node, CAST(count(*) AS DOUBLE) AS routes FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def q63_route_counts(spark, sf):
    g = Lifted(spark, sf)
    up = g.star("customer", "a", b="c_nationkey").select("a", "b").unionByName(g.star("nation", "a", b="n_regionkey").select("a", "b"))
    steps = up.select(F.col("b").alias("output"), F.col("a").alias("step"), F.lit("mapsTo").alias("kind"), F.col("a").alias("input"), F.lit(0).alias("position"), F.lit(2.0).alias("cost"))
    out = route_counts(steps, g.star("customer", "node").select("node"), g.star("region", "node").select("node"))
    return out.where("routes > 0").select("node", F.col("routes").cast("double").alias("routes"))


@query(f"""SELECT '{X}/customer/' || c_custkey AS s, '{routes.MAPS_TO}' AS p, '{X}/nation/' || c_nationkey AS o FROM customer
    UNION ALL SELECT '{X}/customer/' || c_custkey, '{routes.HAS_COST}', c_acctbal::VARCHAR FROM customer""")
def q64_mappings(spark, sf):
    rows = Lifted(spark, sf).star("customer", "source", target="c_nationkey", cost="c_acctbal").select("source", "target", "cost")
    return described.map_triples(rows).select("s", "p", terms.lexical(F.col("o")).alias("o"))


@query(f"""SELECT DISTINCT '{X}/brand/' || p_brand AS cls, CASE WHEN p_size < 10 THEN 'some' WHEN p_size < 30 THEN 'exactly' ELSE 'max' END AS type, '{X}/type/' || p_type AS value, CASE WHEN p_size >= 10 THEN CAST(p_size AS BIGINT) END AS cardinality
    FROM part""")
def q65_restrictions_from_documents(spark, sf):
    quantifier = F.when(F.col("p_size") < 10, "").when(F.col("p_size") < 30, F.concat(F.lit("exactly "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("max "), F.col("p_size").cast("string")))
    rows = _read(spark, sf, "part").select("p_brand", "p_type", "p_size").distinct()
    found = described.class_restrictions(rows.select(_iri("brand", "p_brand").alias("cls"), F.lit(f"{X}#has").alias("property"), _iri("type", "p_type").alias("value"), quantifier.alias("quantifier")))
    made = None
    for kind in ("some", "exactly", "max"):
        part = restrictions.restriction_triples(found.where(F.col("type") == kind).select("cls", "property", "value", "cardinality"), kind)
        made = part if made is None else made.unionByName(part)
    return restrictions.restrictions(made).select("cls", "type", "value", "cardinality")


def _schema(spark, sf):
    """Brands as properties of types, types as classes below others."""
    rows = _read(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    p = F.concat(F.lit(f"{X}#"), F.replace("p_brand", F.lit("#"), F.lit("")))
    return described._flat(rows, [
        (p, described.TYPE, F.lit(described.OWL + "DatatypeProperty")), (p, described.RDFS + "domain", _iri("type", "p_type")), (p, described.RDFS + "label", terms.literal(F.lower("p_brand"), lang="en")),
    ])


@query(f"SELECT '{X}#' || replace(p_brand, '#', '') AS iri, lower(p_brand) AS name, 'DatatypeProperty' AS kind, '{X}/type/' || min(p_type) AS domain FROM part GROUP BY p_brand")
def q66_schema_from_triples(spark, sf):
    return described.schema_of(_schema(spark, sf)).select("iri", "name", "kind", "domain")


@query(f"SELECT '{X}#' || replace(p_brand, '#', '') AS iri FROM part GROUP BY p_brand HAVING min(p_type) = 'ECONOMY'")
def q67_keywords_of_a_class(spark, sf):
    parents = spark.createDataFrame([(f"{X}/type/narrow", f"{X}/type/ECONOMY")], "a string, b string")
    return described.keywords_by(described.schema_of(_schema(spark, sf)), parents, [f"{X}/type/narrow"]).select("iri")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'http://a.b/' || event_type WHEN 1 THEN '_:' || event_type WHEN 2 THEN '"' || event_type || '"@en' ELSE '"' || value || '"^^<http://www.w3.org/2001/XMLSchema#double>' END AS term FROM events""")
def q68_json_bindings(spark, sf):
    k, s = F.col("event_id") % 4, lambda x: F.lit(x).alias("type")
    made = (
        F.when(k == 0, F.to_json(F.struct(s("uri"), F.concat(F.lit("http://a.b/"), "event_type").alias("value"))))
        .when(k == 1, F.to_json(F.struct(s("bnode"), F.col("event_type").alias("value"))))
        .when(k == 2, F.to_json(F.struct(s("literal"), F.col("event_type").alias("value"), F.lit("EN").alias("xml:lang"))))
        .otherwise(F.to_json(F.struct(s("literal"), F.col("value").cast("string").alias("value"), F.lit(terms.XSD + "double").alias("datatype"))))
    )
    return _read(spark, sf, "events").select("event_id", described.from_binding(made).alias("term"))


@query("SELECT page_id, url, contains(url, '://') AS uri, regexp_extract(url, '([^/#]*)$', 1) AS name FROM pages")
def q69_iri_tests(spark, sf):
    return _read(spark, sf, "pages").select("page_id", "url", names.is_uri(F.col("url")).alias("uri"), names.iri_name(F.col("url")).alias("name"))


@query(f"SELECT '{X}/part/' || p_partkey AS iri, p_name AS label FROM part")
def q70_labels_of(spark, sf):
    rows = Lifted(spark, sf).star("part", "s", name="p_name", brand="p_brand").select("s", "name", "brand")
    both = F.array(F.struct(F.lit(names.LABELS[0]).alias("p"), terms.literal(F.col("name")).alias("o")), F.struct(F.lit(names.LABELS[1]).alias("p"), terms.literal(F.col("brand")).alias("o")))
    return names.labels_of(rows.select("s", F.inline(both)))


@query(f"SELECT DISTINCT '{X}/region/' || n_regionkey AS source, '{X}/customer/' || c_custkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q71_inverse_path(spark, sf):
    g = Lifted(spark, sf)
    triples = g.triples("customer", ["c_nationkey"]).unionByName(g.triples("nation", ["n_regionkey"]))
    seeds = g.star("region", "source").select("source")
    return path_pairs(edges_of(triples, inverse=True), "+", seeds).where(F.col("node").startswith(f"{X}/customer/"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def q72_typed_aggregates(spark, sf):
    rows = _read(spark, sf, "events").select("event_type", terms.from_native(F.get_json_object("props", "$.k").cast("bigint"), "bigint").alias("k"), terms.from_native(F.col("value"), "double").alias("v"))
    k, v = terms.integer(F.col("k")), terms.number(F.col("v"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 1000.0 ELSE CAST(p_size AS DOUBLE) END AS magnitude, CASE WHEN p_size % 3 = 0 THEN 'km' ELSE 'm/s' END AS unit FROM part""")
def q73_parse_quantity(spark, sf):
    made = F.concat(F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("e3 km"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0 m/s"))))
    return _read(spark, sf, "part").select("p_partkey", units.parse_quantity(made).alias("q")).select("p_partkey", "q.magnitude", "q.unit")
