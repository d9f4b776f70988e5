"""Queries for versioned stores, route counts, property paths, compound units, values of routes, JSON-LD and schemas over the relational test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import terms, units
from graphloom.functions.compound import UnitRegistry
from graphloom.functions.registry import Registry
from graphloom.operators import described, inheritance, jsonld, paths, quantities, route_values, routes
from graphloom.operators.lift import Lifted
from graphloom.operators.route_counts import route_counts
from graphloom.operators.versioned import Databases
from graphloom.workspace import shared_path, written

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


# -- versioned stores ----------------------------------------------------------------------------

def _changed_database(spark, sf):
    """Customers and suppliers of every nation come in commits of their own; then some are removed, set anew and added again."""
    g = Databases(spark, shared_path(spark, "databases")).create("customers")
    lifted = Lifted(spark, sf)
    customers = lifted.triples("customer", ["c_nationkey", "c_mktsegment"])
    suppliers = lifted.triples("supplier", ["s_nationkey"])
    nations = [r["s"] for r in lifted.triples("nation", ["n_regionkey"]).select("s").distinct().orderBy("s").collect()]
    by_nation = customers.join(customers.where(F.col("o").isin(nations)).select("s", F.col("o").alias("nation")), "s").unionByName(suppliers.withColumn("nation", F.col("o")))
    # joined once, not for every nation; sorted, so that a nation's rows are few row groups
    by_nation = written(by_nation.repartitionByRange("nation").sortWithinPartitions("nation"), "by-nation")
    for nation in nations:
        g.add(by_nation.where(F.col("nation") == nation))
    g.remove(None, f"{X}/customer#c_mktsegment", '"MACHINERY"')
    g.set(g.triples(None, f"{X}/customer#c_mktsegment", '"BUILDING"').select("s", "p", F.lit('"HOUSEHOLD"').alias("o")))
    g.update(g.match(("?c", f"{X}/customer#c_mktsegment", '"FURNITURE"'), ("?c", f"{X}/customer#c_nationkey", "?n")), delete=[("?c", f"{X}/customer#c_nationkey", "?n")], insert=[("?n", f"{X}#furnishes", "?c")])
    g.subtract(g.triples(None, f"{X}/supplier#s_nationkey", nations[0]))
    g.add(customers.where(F.col("o") == '"MACHINERY"'))
    return g


@query(f"""WITH c AS (SELECT '{X}/customer/' || c_custkey AS s, '{X}/nation/' || c_nationkey AS n, c_mktsegment AS m FROM customer)
    SELECT s, '{X}/customer#c_mktsegment' AS p, CASE m WHEN 'BUILDING' THEN 'HOUSEHOLD' ELSE m END AS o FROM c
    UNION ALL SELECT s, '{X}/customer#c_nationkey', n FROM c WHERE m <> 'FURNITURE'
    UNION ALL SELECT n, '{X}#furnishes', s FROM c WHERE m = 'FURNITURE'
    UNION ALL SELECT '{X}/supplier/' || s_suppkey, '{X}/supplier#s_nationkey', '{X}/nation/' || s_nationkey FROM supplier WHERE s_nationkey <> 0""")
def q74_versioned_store(spark, sf):
    return _changed_database(spark, sf).df.select("s", "p", terms.lexical(F.col("o")).alias("o"))


@query(f"""WITH c AS (SELECT '{X}/customer/' || c_custkey AS s, '{X}/nation/' || c_nationkey AS n, c_mktsegment AS m FROM customer)
    SELECT s, 'removed' AS change, m AS o FROM c WHERE m = 'BUILDING' UNION ALL SELECT s, 'added', 'HOUSEHOLD' FROM c WHERE m = 'BUILDING'
    UNION ALL SELECT s, 'removed', n FROM c WHERE m = 'FURNITURE' UNION ALL SELECT n, 'added', s FROM c WHERE m = 'FURNITURE'
    UNION ALL SELECT '{X}/supplier/' || s_suppkey, 'removed', '{X}/nation/' || s_nationkey FROM supplier WHERE s_nationkey = 0""")
def q75_changes_between_versions(spark, sf):
    g = _changed_database(spark, sf)
    # version 25 had every nation's rows; what was removed and came back is no change
    return g.changes(25).select("s", "change", terms.lexical(F.col("o")).alias("o"))


# -- route counts --------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), s AS (SELECT n_regionkey AS r, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
    r AS (SELECT r_regionkey AS r FROM region)
    SELECT '{X}/region/' || r.r AS node, coalesce(c.n, 0) AS routes FROM r LEFT JOIN c USING (r) UNION ALL SELECT '{X}/share/' || r.r, coalesce(c.n, 0) * coalesce(s.n, 0) FROM r LEFT JOIN c USING (r) LEFT JOIN s USING (r)""")
def q76_route_counts_two_way(spark, sf):
    """Customers map to nations and nations to regions in both directions; a share is derived from a region and its market together."""
    g = Lifted(spark, sf)
    up = g.star("customer", "a", b="c_nationkey").select("a", "b").unionByName(g.star("nation", "a", b="n_regionkey").select("a", "b"))
    markets = g.star("supplier", "a", n="s_nationkey").join(g.star("nation", "n", r="n_regionkey")).select("a", "r").select("a", F.regexp_replace("r", "/region/", "/market/").alias("b"))
    both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(markets)
    mapped = both.select(F.col("b").alias("output"), F.concat_ws(" ", F.lit("mapsTo"), "a").alias("step"), F.lit("mapsTo").alias("kind"), F.col("a").alias("input"), F.lit(0).alias("position"), F.lit(2.0).alias("cost"))
    regions = g.star("region", "node").select("node")
    other = lambda kind: F.regexp_replace("node", "/region/", f"/{kind}/")
    calls = regions.select(other("share").alias("output"), F.lit("function share").alias("step"), F.lit("function").alias("kind"), F.posexplode(F.array("node", other("market"))).alias("position", "input"), F.lit(10.0).alias("cost"))
    steps = mapped.unionByName(calls.select(mapped.columns))
    sources = g.star("customer", "node").select("node").unionByName(g.star("supplier", "node").select("node"))
    targets = regions.unionByName(regions.select(other("share").alias("node")))
    return route_counts(steps, sources, targets).select("node", F.col("routes").cast("bigint").alias("routes"))


# -- property paths ------------------------------------------------------------------------------

NATION, REGION, SUPPLIES = f"{X}/customer#c_nationkey", f"{X}/nation#n_regionkey", f"{X}/supplier#s_nationkey"


def _places(spark, sf):
    g = Lifted(spark, sf)
    return g.triples("customer", ["c_nationkey"]).unionByName(g.triples("supplier", ["s_nationkey"])).unionByName(g.triples("nation", ["n_regionkey"]))


@query(f"""SELECT '{X}/customer/' || c_custkey AS source, '{X}/nation/' || c_nationkey AS node FROM customer
    UNION ALL SELECT '{X}/customer/' || c_custkey, '{X}/region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def q77_path_sequence_optional(spark, sf):
    return paths.pairs(_places(spark, sf), paths.p(NATION) / paths.p(REGION).optional())


@query(f"""SELECT s.source, '{X}/supplier/' || s_suppkey AS node FROM (SELECT '{X}/customer/' || c_custkey AS source, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000) s
    JOIN nation n ON n.n_regionkey = s.r JOIN supplier ON s_nationkey = n.n_nationkey""")
def q78_path_through_inverse_steps(spark, sf):
    """From rich customers to all suppliers of their region: up and down again."""
    rich = Lifted(spark, sf).star("customer", "source", balance="c_acctbal").filter("balance > 9000").select("source")
    return paths.pairs(_places(spark, sf), paths.p(NATION) / paths.p(REGION) / ~paths.p(REGION) / ~paths.p(SUPPLIES), rich)


@query(f"""SELECT DISTINCT '{X}/nation/' || a.n_nationkey AS source, '{X}/nation/' || b.n_nationkey AS node FROM nation a JOIN nation b USING (n_regionkey)
    UNION SELECT '{X}/nation/' || n_nationkey, '{X}/customer/' || c_custkey FROM nation a JOIN (SELECT n_regionkey, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey) c USING (n_regionkey)""")
def q79_path_repeated_group(spark, sf):
    """Any number of turns over a region, or down to a customer: a repetition of a nested path."""
    nations = Lifted(spark, sf).star("nation", "source").select("source")
    turn = paths.p(REGION) / ~paths.p(REGION)
    return paths.pairs(_places(spark, sf), (turn | turn / ~paths.p(NATION)).plus(), nations)


@query(f"""SELECT '{X}/nation/' || n_nationkey AS source, '{X}/region/' || n_regionkey AS node FROM nation
    UNION ALL SELECT '{X}/nation/' || s_nationkey, '{X}/supplier/' || s_suppkey FROM supplier""")
def q80_path_negated(spark, sf):
    """What nations are linked with, but not by the customers' nation, in either direction."""
    out = paths.pairs(_places(spark, sf), paths.negated([NATION], [NATION]))
    return out.where(F.col("source").startswith(f"{X}/nation/"))


# -- units and values ----------------------------------------------------------------------------


def _registry(spark):
    extra = [("NewtonMetre", "N⋅m", [-2, 2, 1, 0, 0, 0, 0], 1.0, 0.0), ("WattHour", "Wh", [-2, 2, 1, 0, 0, 0, 0], 3600.0, 0.0)]
    return UnitRegistry(units.table(spark, [*units.COMMON, *extra]))


@query("""SELECT p_partkey, round(CASE p_size % 5 WHEN 0 THEN p_size * 1000.0 / 3600.0 WHEN 1 THEN p_size * 1e-6 WHEN 2 THEN p_size * 1.0 WHEN 3 THEN p_size * 1e3 END, 9) AS si,
    CASE p_size % 5 WHEN 0 THEN 'Second**-1 * Metre' WHEN 1 THEN 'Metre**2' WHEN 2 THEN 'Second**-2 * Metre * Kilogram' WHEN 3 THEN 'Second**' || (-1 - p_size % 3) || ' * Kilogram' END AS base FROM part""")
def q81_compound_units(spark, sf):
    """Unit texts made from columns: symbols with prefixes, camel names, powers, and one that means nothing."""
    k, part = F.col("p_size") % 5, spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    text = F.when(k == 0, "km/h").when(k == 1, "SquareMilliMetre").when(k == 2, "(kg·m)/s²").when(k == 3, F.concat(F.lit("Mg/s**"), (F.col("p_size") % 3 + 1).cast("string"))).otherwise(F.concat(F.lit("unknown"), F.col("p_partkey").cast("string")))
    out = _registry(spark).resolve(part.withColumn("text", text), "text", "m")
    return out.select("p_partkey", F.round(F.col("p_size") * F.col("m.multiplier"), 9).alias("si"), units.base_expression(F.col("m.dimension")).alias("base"))


@query("""WITH u(name, f) AS (VALUES ('Joule', 1.0), ('WattHour', 3600.0)), s AS (SELECT event_id, value, name, abs(log10(abs(value) / f / 5)) + CASE name WHEN 'WattHour' THEN 100 ELSE 0 END AS score FROM events, u WHERE value <> 0),
    z AS (SELECT event_id, value, 'Joule' AS name, 0 AS score FROM events WHERE value = 0)
    SELECT event_id, name AS unit FROM (SELECT * FROM s UNION ALL SELECT * FROM z) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score, name) = 1""")
def q82_simplest_unit(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", F.array(*map(F.lit, [-2, 2, 1, 0, 0, 0, 0])).alias("dimension"))
    return _registry(spark).simplest(events, "value", "dimension").select("event_id", "unit")


@query(f"""SELECT '{X}/density/' || p_partkey AS target, round(p_retailprice * 10 / (p_size * CASE WHEN p_size % 2 = 0 THEN 1 ELSE 10 END), 6) AS value, 'g/cm' AS unit FROM part""")
def q83_route_values(spark, sf):
    """A part's density by a function of its mass and length, which come in other units than the function takes."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("k"), "p_size", "p_retailprice")
    iri = lambda kind: F.concat(F.lit(f"{X}/{kind}/"), F.col("k"))
    mass = part.select(iri("mass").alias("iri"), F.lit(f"{X}#Mass").alias("type"), F.col("p_retailprice").alias("value"), F.lit(f"{X}/unit/g").alias("unit"))
    length = part.select(iri("size").alias("iri"), F.lit(f"{X}#Length").alias("type"), F.col("p_size").alias("value"), F.when(F.col("p_size") % 2 == 0, f"{X}/unit/mm").otherwise(f"{X}/unit/cm").alias("unit"))
    triples = quantities.quantity_triples(mass.unionByName(length)).unionByName(described.map_triples(part.select(iri("size").alias("source"), iri("length").alias("target"), F.lit(None).cast("double").alias("cost"))))
    triples = written(triples, "triples")
    calls = part.select(F.lit("density").alias("function"), F.array(iri("mass"), iri("length")).alias("inputs"), iri("density").alias("output"), F.lit(None).cast("double").alias("cost"))
    functions = Registry()
    functions.add("density", lambda m, l: m / l, ["mass", "length"], "density", input_units=["kg", "m"], output_unit="kg/m")  # noqa: E741
    sources = written(route_values.sources_of(triples), "sources")
    targets = part.select(iri("density").alias("node"))
    found = routes.cheapest(routes.steps(triples, functions=calls), sources.select("node", F.lit(0.0).alias("cost")), targets, k=1)
    out = route_values.evaluate(found, sources, functions, _registry(spark), targets.withColumn("unit", F.lit("g/cm")))
    return out.select("target", F.round("value", 6).alias("value"), "unit")


# -- JSON-LD -------------------------------------------------------------------------------------

LD = {
    "x": f"{X}#", "xsd": "http://www.w3.org/2001/XMLSchema#", "@base": f"{X}/", "name": "x:name", "nation": {"@id": "x:nation", "@type": "@id"}, "balance": {"@id": "x:balance", "@type": "xsd:double"},
    "contact": {"@id": "x:contact", "@context": {"name": "x:contactName"}}, "segments": {"@id": "x:segment", "@container": "@language"}, "Customer": "x:Customer",
}


def _customer_documents(spark, sf):
    """A JSON-LD document of every customer, with a nested contact and a language map."""
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    contact = F.struct(F.concat(F.lit("contact/"), key).alias("@id"), F.concat(F.lit("Agent of "), "c_name").alias("name"))
    doc = F.struct(
        F.concat(F.lit("customer/"), key).alias("@id"), F.lit("Customer").alias("@type"), F.col("c_name").alias("name"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("nation"),
        F.array(contact).alias("contact"), F.struct(F.lower("c_mktsegment").alias("en"), F.col("c_mktsegment").alias("EN-us")).alias("segments"), F.lit("left out").alias("remark"),
    )
    return rows.select(F.col("c_custkey").alias("id"), F.to_json(doc).alias("doc"))


@query(f"""WITH c AS (SELECT '{X}/customer/' || c_custkey AS s, * FROM customer)
    SELECT s, '{terms.RDF}type' AS p, '{X}#Customer' AS o FROM c UNION ALL SELECT s, '{X}#name', c_name FROM c UNION ALL SELECT s, '{X}#nation', '{X}/nation/' || c_nationkey FROM c
    UNION ALL SELECT s, '{X}#contact', '{X}/contact/' || c_custkey FROM c UNION ALL SELECT '{X}/contact/' || c_custkey, '{X}#contactName', 'Agent of ' || c_name FROM c
    UNION ALL SELECT s, '{X}#segment', lower(c_mktsegment) || ' en' FROM c UNION ALL SELECT s, '{X}#segment', c_mktsegment || ' en-us' FROM c""")
def q84_json_ld_triples(spark, sf):
    out = jsonld.triples(_customer_documents(spark, sf), jsonld.LdContext(LD))
    return out.select("s", "p", F.concat_ws(" ", terms.lexical(F.col("o")), terms.language(F.col("o"))).alias("o"))


@query(f"""SELECT c_custkey AS doc, '{{"@id":"{X}/customer/' || c_custkey || '","@type":["{X}#Customer"],"{X}#contact":[{{"@id":"{X}/contact/' || c_custkey || '","{X}#contactName":[{{"@value":"Agent of ' || c_name || '"}}]}}],"{X}#name":[{{"@value":"' || c_name
    || '"}}],"{X}#nation":[{{"@id":"{X}/nation/' || c_nationkey || '"}}]}}' AS json FROM customer""")
def q85_json_ld_expanded(spark, sf):
    docs = _customer_documents(spark, sf).withColumn("doc", F.regexp_replace("doc", r',"segments":\{[^}]*\}', ""))
    out = jsonld.expand(docs, jsonld.LdContext(LD))
    return out.select("doc", F.regexp_extract("json", r"^\[(.*)\]$", 1).alias("json"))


@query(f"""SELECT c_custkey AS doc, '{{"@id":"{X}/customer/' || c_custkey || '","@type":"Customer","contact":{{"@id":"{X}/contact/' || c_custkey || '","x:contactName":"Agent of ' || c_name || '"}},"name":"' || c_name || '","nation":"{X}/nation/' || c_nationkey || '"}}' AS json FROM customer""")
def q86_json_ld_compacted(spark, sf):
    context = jsonld.LdContext(LD)
    docs = _customer_documents(spark, sf).withColumn("doc", F.regexp_replace("doc", r',"segments":\{[^}]*\}', ""))
    return jsonld.compact(jsonld.expand(docs, context).withColumnsRenamed({"doc": "id", "json": "doc"}), context)


# -- schema inheritance --------------------------------------------------------------------------


def _nation_schemas(spark, sf):
    """Every nation's schema is based on its region's, those on one root; customers' segments are classes, suppliers give keywords."""
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    region = spark.read.parquet(f"{sf}/region.parquet")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    based_on = nation.select(name("nation", "n_nationkey").alias("schema"), name("region", "n_regionkey").alias("base")).unionByName(region.select(name("region", "r_regionkey").alias("schema"), F.lit("root").alias("base")))
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    word = lambda schema, cls, key, iri, level: (schema.alias("schema"), F.lit(None).cast("string").alias("theme"), cls.alias("cls"), cls.alias("cls_name"), key.alias("keyword"), iri.alias("iri"), F.lit(None).cast("string").alias("datatype"), level.alias("conformance"), F.lit(None).cast("string").alias("description"))
    own = supplier.select(*word(name("nation", "s_nationkey"), F.lit(f"{X}#Supplier"), name("k", "s_suppkey"), name(f"{X}#k", "s_suppkey"), F.lit("optional")))
    # every region says "name" again, and the root has it first
    regions = region.select(*word(name("region", "r_regionkey"), F.lit(f"{X}#Place"), F.lit("name"), name(f"{X}#name", "r_regionkey"), F.lit("recommended")))
    root = region.limit(1).select(*word(F.lit("root"), F.lit(f"{X}#Thing"), F.lit("name"), F.lit(f"{X}#name"), F.lit("mandatory")))
    parents = spark.createDataFrame([(f"{X}#Supplier", f"{X}#Place"), (f"{X}#Place", f"{X}#Thing")], "cls string, parent string")
    return own.unionByName(regions).unionByName(root), based_on, parents


@query(f"""SELECT 'nation' || s_nationkey AS schema, 'k' || s_suppkey AS keyword, '{X}#k' || s_suppkey AS iri, '{X}#Supplier' AS domain, 0 AS above, 'optional' AS conformance FROM supplier
    UNION ALL SELECT 'nation' || n_nationkey, 'name', '{X}#name' || n_regionkey, '{X}#Place', 1, 'recommended' FROM nation
    UNION ALL SELECT 'region' || r_regionkey, 'name', '{X}#name' || r_regionkey, '{X}#Place', 1, 'recommended' FROM region UNION ALL SELECT 'root', 'name', '{X}#name', '{X}#Thing', 2, 'mandatory'""")
def q87_schema_inheritance(spark, sf):
    """What holds for suppliers in every schema: the nearest schema's and the nearest class's definition of each keyword."""
    definitions, based_on, parents = _nation_schemas(spark, sf)
    held = inheritance.inherit(inheritance.resolve(definitions, based_on, "allow"), parents)
    return held.where(F.col("cls") == f"{X}#Supplier").select("schema", "keyword", "iri", "domain", "above", "conformance")
