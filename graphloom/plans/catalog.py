"""One query for each operator over the relational test tables, lifted to triples, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names, registry, terms, units
from graphloom.operators import closure, restrictions, routes, search, store, tables
from graphloom.operators.lift import Lifted
from graphloom.operators.documents import Context
from graphloom.operators.solutions import Solutions, match
from graphloom.sources import ntriples

X = "http://example.com"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(column: str):
    return terms.lexical(F.col(column)).alias(column)


# -- scans and lookups ---------------------------------------------------------------------------


@query(f"SELECT '{X}/nation/' || n_nationkey AS s, n_name AS o FROM nation")
def q01_scan_predicate(spark, sf):
    g = store.TripleStore(spark, Lifted(spark, sf).by_column("nation"))
    return g.triples(None, f"{X}/nation#n_name").select("s", text("o"))


@query(f"""
    SELECT p, o FROM (SELECT '{X}/customer#c_custkey' AS p, c_custkey::VARCHAR AS o FROM customer WHERE c_custkey = 7
    UNION ALL SELECT '{X}/customer#c_name', c_name FROM customer WHERE c_custkey = 7
    UNION ALL SELECT '{X}/customer#c_nationkey', '{X}/nation/' || c_nationkey FROM customer WHERE c_custkey = 7
    UNION ALL SELECT '{X}/customer#c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 7
    UNION ALL SELECT '{X}/customer#c_acctbal', c_acctbal::VARCHAR FROM customer WHERE c_custkey = 7
    UNION ALL SELECT '{names.PREFIXES["rdf"]}type', '{X}/customer')""")
def q02_scan_subject(spark, sf):
    g = store.TripleStore(spark, Lifted(spark, sf).triples("customer", key=7))
    return g.predicate_objects(f"{X}/customer/7").select("p", text("o"))


@query(f"SELECT '{X}/customer/' || c_custkey AS s, '{X}/customer#c_mktsegment' AS p FROM customer WHERE c_mktsegment = 'BUILDING'")
def q03_scan_object(spark, sf):
    return store.TripleStore(spark, Lifted(spark, sf).triples("customer")).subject_predicates('"BUILDING"')


@query("SELECT o_orderpriority AS o FROM orders")
def q04_objects_keep_duplicates(spark, sf):
    return store.TripleStore(spark, Lifted(spark, sf).by_column("orders")).objects(None, f"{X}/orders#o_orderpriority").select(text("o"))


@query(f"""
    SELECT '{X}/supplier#' || c AS p, n FROM (SELECT 's_suppkey' AS c, count(s_suppkey) AS n FROM supplier UNION ALL SELECT 's_name', count(s_name) FROM supplier
    UNION ALL SELECT 's_nationkey', count(s_nationkey) FROM supplier UNION ALL SELECT 's_acctbal', count(s_acctbal) FROM supplier)
    UNION ALL SELECT '{names.PREFIXES["rdf"]}type', count(*) FROM supplier""")
def q05_predicate_counts(spark, sf):
    return Lifted(spark, sf).triples("supplier").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT '{X}/customer/' || c_custkey AS s FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q06_has_for_all(spark, sf):
    lifted = Lifted(spark, sf)
    orders = store.TripleStore(spark, lifted.by_column("orders")).objects(None, f"{X}/orders#o_custkey").withColumnRenamed("o", "s")
    return store.TripleStore(spark, lifted.by_column("customer")).subjects(names.PREFIXES["rdf"] + "type").join(orders, "s", "left_semi")


@query(f"SELECT '{X}/customer/' || o_custkey AS s, min(o_orderstatus) AS value FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def q07_unique_values(spark, sf):
    rows = Lifted(spark, sf).star("orders", "order", s="o_custkey", o="o_orderstatus").select("s", "o")
    g = store.TripleStore(spark, rows.select("s", F.lit("status").alias("p"), terms.literal(F.col("o")).alias("o")))
    return g.values("status").select("s", text("value"))


@query(f"SELECT '{X}/nation/' || n_nationkey AS s, CASE WHEN n_regionkey = 3 THEN upper(n_name) || '!' ELSE n_name END AS o FROM nation")
def q08_set_upsert(spark, sf):
    lifted = Lifted(spark, sf)
    new = lifted.star("nation", "s", region="n_regionkey", o="n_name").filter("region = 3").select("s", "o")
    new = new.select("s", F.lit(f"{X}/nation#n_name").alias("p"), terms.literal(F.concat(F.upper("o"), F.lit("!"))).alias("o"))
    return store.TripleStore(spark, lifted.triples("nation", ["n_name"])).set(new).df.select("s", text("o"))


@query(f"SELECT '{X}/customer/' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def q09_remove(spark, sf):
    g = store.TripleStore(spark, Lifted(spark, sf).triples("customer", ["c_mktsegment"]))
    return g.remove(None, f"{X}/customer#c_mktsegment", '"MACHINERY"').df.select("s", text("o"))


@query(f"SELECT '{X}/customer/' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def q10_filter_in(spark, sf):
    return store.TripleStore(spark, Lifted(spark, sf).by_column("customer")).triples(None, [f"{X}/customer#c_mktsegment"], ['"BUILDING"', '"FURNITURE"']).select("s", text("o"))


# -- joins and pattern algebra -------------------------------------------------------------------


@query(f"SELECT '{X}/customer/' || c_custkey AS customer, c_name AS name, c_mktsegment AS segment, '{X}/nation/' || c_nationkey AS nation FROM customer")
def q11_star(spark, sf):
    return Lifted(spark, sf).star("customer", "customer", name="c_name", segment="c_mktsegment", nation="c_nationkey").select()


@query("""
    SELECT r_name AS region, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q12_chain(spark, sf):
    g = Lifted(spark, sf)
    out = g.rows("lineitem", order="l_orderkey->orders", price="l_extendedprice").join(g.star("orders", "order", customer="o_custkey"))
    out = out.join(g.star("customer", "customer", nation="c_nationkey")).join(g.star("nation", "nation", r="n_regionkey")).join(g.star("region", "r", region="r_name"))
    return out.group("region", n=F.count(F.lit(1)), total=F.round(F.sum("price"), 2)).select()


@query(f"SELECT '{X}/documents/' || d.doc_id AS doc, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q13_optional(spark, sf):
    g = Lifted(spark, sf)
    return g.star("documents", "doc", source="source").optional(g.rows("labels", doc="doc_id->documents", quality="quality")).select()


@query(f"SELECT '{X}/documents/' || d.doc_id AS doc, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 AND n_chars > 1000")
def q14_optional_filter(spark, sf):
    g = Lifted(spark, sf)
    left = g.star("documents", "doc", n="n_chars")
    return left.optional(g.rows("labels", doc="doc_id->documents", quality="quality", toxic="toxic"), (F.col("quality") == 1) & (F.col("n") > 1000)).select("doc", "quality", "toxic")


@query(f"SELECT '{X}/customer/' || c_custkey AS who, c_name AS name FROM customer WHERE c_nationkey = 3 UNION ALL SELECT '{X}/supplier/' || s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def q15_union(spark, sf):
    g = Lifted(spark, sf)
    a = g.star("customer", "who", name="c_name", nation="c_nationkey").filter("nation = 3")
    return a.union(g.star("supplier", "who", name="s_name", nation="s_nationkey").filter("nation = 3")).select("who", "name")


@query(f"SELECT '{X}/orders/' || l_orderkey AS \"order\", l_quantity AS quantity FROM lineitem WHERE l_quantity > 45")
def q16_filter_number(spark, sf):
    return Lifted(spark, sf).rows("lineitem", order="l_orderkey->orders", quantity="l_quantity").filter("quantity > 45").select()


@query(f"SELECT '{X}/part/' || p_partkey AS part, p_name AS name FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*g$')")
def q17_filter_regex(spark, sf):
    return Lifted(spark, sf).star("part", "part", name="p_name").filter(F.col("name").rlike("(?i)^[a-m].*g$")).select()


@query(f"SELECT '{X}/customer/' || c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q18_exists(spark, sf):
    g = Lifted(spark, sf)
    return g.star("customer", "customer").exists(g.star("orders", "order", customer="o_custkey", price="o_totalprice").filter("price > 300000")).select()


@query(f"SELECT '{X}/documents/' || doc_id AS doc FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q19_not_exists(spark, sf):
    g = Lifted(spark, sf)
    return g.star("documents", "doc").not_exists(g.rows("labels", doc="doc_id->documents")).select()


@query(f"SELECT '{X}/nation/' || n_nationkey AS nation, n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 24)")
def q20_values(spark, sf):
    return Lifted(spark, sf).star("nation", "nation", name="n_name").values("nation", [f"{X}/nation/1", f"{X}/nation/3", f"{X}/nation/24"]).select()


@query(f"SELECT '{X}/customer/' || c_custkey AS customer, c_acctbal AS balance, round(c_acctbal * 2 + 1, 2) AS double FROM customer")
def q21_bind(spark, sf):
    return Lifted(spark, sf).star("customer", "customer", balance="c_acctbal").bind("double", F.round(F.col("balance") * 2 + 1, 2)).select()


@query(f"SELECT DISTINCT '{X}/nation/' || c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def q22_distinct(spark, sf):
    return Lifted(spark, sf).star("customer", "customer", nation="c_nationkey", segment="c_mktsegment").project("nation", "segment").distinct().select()


@query("""
    SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most,
    count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority HAVING count(*) > 10""")
def q23_group(spark, sf):
    out = Lifted(spark, sf).star("orders", "order", priority="o_orderpriority", price="o_totalprice", customer="o_custkey")
    out = out.group("priority", n=F.count(F.lit(1)), total=F.round(F.sum("price"), 2), mean=F.round(F.avg("price"), 4), least=F.min("price"), most=F.max("price"), customers=F.count_distinct("customer"))
    return out.filter("n > 10").select()


@query(f"SELECT '{X}/orders/' || o_orderkey AS \"order\", o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q24_top(spark, sf):
    return Lifted(spark, sf).star("orders", "order", price="o_totalprice").order(F.desc("price"), "order").limit(10).select()


@query(f"SELECT '{X}/nation/' || n_nationkey AS nation FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def q25_minus(spark, sf):
    g = Lifted(spark, sf)
    return g.star("nation", "nation").minus(g.star("supplier", "supplier", nation="s_nationkey", balance="s_acctbal").filter("balance > 9000")).select()


@query(f"SELECT '{X}/customer/' || c_custkey AS customer, c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15) ON o_custkey = c_custkey")
def q26_subquery(spark, sf):
    g = Lifted(spark, sf)
    inner = g.star("orders", "order", customer="o_custkey").group("customer", n=F.count(F.lit(1))).filter("n >= 15")
    return g.star("customer", "customer", name="c_name").join(inner).select()


# -- closure -------------------------------------------------------------------------------------


def _containment(spark, sf):
    """Edges of customer in nation, nation in region."""
    g = Lifted(spark, sf)
    return g.star("customer", "a", b="c_nationkey").union(g.star("nation", "a", b="n_regionkey")).select("a", "b")


_EDGES = f"""WITH RECURSIVE e AS (SELECT '{X}/customer/' || c_custkey AS a, '{X}/nation/' || c_nationkey AS b FROM customer
    UNION ALL SELECT '{X}/nation/' || n_nationkey, '{X}/region/' || n_regionkey FROM nation)"""


@query(_EDGES + ", r AS (SELECT a AS source, b AS node FROM e UNION SELECT r.source, e.b FROM r JOIN e ON r.node = e.a) SELECT DISTINCT source, node FROM r")
def q27_path_plus(spark, sf):
    return closure.path_pairs(_containment(spark, sf), "+")


@query(_EDGES + f", r AS (SELECT DISTINCT a AS source, a AS node FROM e WHERE a LIKE '{X}/nation/%' UNION SELECT r.source, e.b FROM r JOIN e ON r.node = e.a) SELECT DISTINCT source, node FROM r")
def q28_path_star(spark, sf):
    edges = _containment(spark, sf)
    return closure.path_pairs(edges, "*", edges.select(F.col("a").alias("source")).where(F.col("a").startswith(f"{X}/nation/")).distinct())


@query(f"""WITH RECURSIVE e AS (SELECT '{X}/customer/' || c_custkey AS a, '{X}/nation/' || c_nationkey AS b FROM customer
    UNION ALL SELECT '{X}/nation/' || n_nationkey, '{X}/region/' || n_regionkey FROM nation UNION ALL SELECT '{X}/orders/' || o_orderkey, '{X}/customer/' || o_custkey FROM orders),
    r AS (SELECT '{X}/orders/' || min(o_orderkey) AS node, 0 AS depth FROM orders UNION SELECT e.b, depth + 1 FROM r JOIN e ON r.node = e.a) SELECT node, depth FROM r""")
def q29_any_path(spark, sf):
    g = Lifted(spark, sf)
    first = g.star("orders", "source").df.agg(F.min("source").alias("k")).select(F.concat(F.lit(f"{X}/orders/"), F.col("k").cast("string")).alias("source"))
    edges = _containment(spark, sf).unionByName(g.star("orders", "a", b="o_custkey").select("a", "b"))
    return closure.reach(edges, first, include_seeds=True).select("node", F.col("depth").cast("int").alias("depth"))


@query("SELECT conv_id::VARCHAR AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role AS item FROM conversations")
def q30_lists(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", terms.literal(F.col("role")).alias("role"))
    g = store.TripleStore(spark, store.lists(rows, "conv_id", "turn", "role"))
    heads = rows.select("conv_id", F.concat(F.lit("_:list_"), F.md5(F.col("conv_id").cast("string")), F.lit("_1")).alias("s")).distinct()
    return g.list_items(heads).join(heads.withColumnRenamed("s", "head"), "head").select(F.col("conv_id").cast("string").alias("head"), F.col("position").cast("long").alias("position"), text("item"))


# -- other result forms and updates --------------------------------------------------------------


@query(f"""SELECT '{X}/supplier/' || s_suppkey AS s, '{X}#label' AS p, s_name AS o FROM supplier
    UNION ALL SELECT '{X}/supplier/' || s_suppkey, '{X}#in', '{X}/nation/' || s_nationkey FROM supplier""")
def q31_construct(spark, sf):
    out = Lifted(spark, sf).star("supplier", "s", name="s_name", nation="s_nationkey")
    return out.construct(("?s", f"{X}#label", terms.literal(F.col("name"))), ("?s", f"{X}#in", "?nation")).select("s", "p", text("o"))


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS answer")
def q32_ask(spark, sf):
    return Lifted(spark, sf).star("orders", "order", price="o_totalprice").filter("price > 100000").ask()


@query(f"""SELECT p, o FROM (SELECT '{X}/nation#n_nationkey' AS p, n_nationkey::VARCHAR AS o FROM nation WHERE n_nationkey = 4 UNION ALL SELECT '{X}/nation#n_name', n_name FROM nation WHERE n_nationkey = 4
    UNION ALL SELECT '{X}/nation#n_regionkey', '{X}/region/' || n_regionkey FROM nation WHERE n_nationkey = 4 UNION ALL SELECT '{names.PREFIXES["rdf"]}type', '{X}/nation')""")
def q33_describe(spark, sf):
    return store.TripleStore(spark, Lifted(spark, sf).graph("nation", "region")).describe(f"{X}/nation/4").select("p", text("o"))


@query("SELECT n_name AS o FROM nation UNION SELECT 'ATLANTIS'")
def q34_insert(spark, sf):
    g = store.TripleStore(spark, Lifted(spark, sf).triples("nation", ["n_name"]))
    return g.add([(f"{X}/nation/99", f"{X}/nation#n_name", '"ATLANTIS"'), (f"{X}/nation/99", f"{X}/nation#n_name", '"ATLANTIS"')]).objects().select(text("o")).distinct()


@query(f"SELECT '{X}/customer/' || c_custkey AS s, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS o FROM customer")
def q35_update(spark, sf):
    lifted = Lifted(spark, sf)
    g = store.TripleStore(spark, lifted.triples("customer", ["c_mktsegment"]))
    where = lifted.star("customer", "s", balance="c_acctbal", segment="c_mktsegment").filter("balance < 0").bind("old", terms.literal(F.col("segment")))
    p = f"{X}/customer#c_mktsegment"
    return g.update(where, delete=[("?s", p, "?old")], insert=[("?s", p, '"debtor"')]).df.select("s", text("o"))


@query(f"""SELECT '{X}/supplier/' || s_suppkey AS s, p, o FROM (SELECT s_suppkey, '{X}#title' AS p, s_name AS o FROM supplier
    UNION ALL SELECT s_suppkey, '{X}#balance', s_acctbal::VARCHAR FROM supplier UNION ALL SELECT s_suppkey, '{X}#in', '{X}/nation/' || s_nationkey FROM supplier)""")
def q36_unpivot(spark, sf):
    context = Context({"title": {"iri": f"{X}#title", "type": terms.XSD + "string"}, "balance": {"iri": f"{X}#balance", "type": terms.XSD + "double"}, "in": {"iri": f"{X}#in", "type": "@id"}}, base=f"{X}/")
    rows = spark.read.parquet(f"{sf}/supplier.parquet")
    rows = rows.select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")), "s_name", F.col("s_acctbal").cast("string"), F.concat(F.lit(f"{X}/nation/"), F.col("s_nationkey").cast("string")))
    return tables.to_triples(rows, ["@id", "title", "balance", "in"], context).select("s", "p", text("o"))


@query(f"SELECT '{X}/supplier/' || s_suppkey AS s, s_name AS name, '{X}/nation/' || s_nationkey AS nation FROM supplier")
def q37_pivot(spark, sf):
    out = tables.from_triples(Lifted(spark, sf).triples("supplier"), {"name": f"{X}/supplier#s_name", "nation": f"{X}/supplier#s_nationkey"})
    return out.select("s", terms.lexical(F.col("name")[0]).alias("name"), F.col("nation")[0].alias("nation"))


# -- terms ---------------------------------------------------------------------------------------


@query(r"SELECT url, CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)([^#]*)$', 1) ELSE regexp_extract(url, '^(.*/)([^/]*)$', 1) END AS space, CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)([^#]*)$', 2) ELSE regexp_extract(url, '^(.*/)([^/]*)$', 2) END AS name FROM pages")
def q38_split_iri(spark, sf):
    space, name = names.split_iri(F.col("url"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("url", space.alias("space"), name.alias("name"))


@query(f"SELECT 'nation:' || n_nationkey AS short, '{X}/nation/' || n_nationkey AS full_iri FROM nation")
def q39_curie(spark, sf):
    prefixes = {"nation": f"{X}/nation/", "x": X}
    short = names.compact(F.concat(F.lit(f"{X}/nation/"), F.col("n_nationkey").cast("string")), prefixes)
    return spark.read.parquet(f"{sf}/nation.parquet").select(short.alias("short")).select("short", names.expand(F.col("short"), prefixes).alias("full_iri"))


_MIXED = "CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS {s}) WHEN 2 THEN '.5e3' WHEN 3 THEN 'http://a.b/c' WHEN 4 THEN '2022-12-01 12:30' WHEN 5 THEN '_:b1' ELSE 'some text' END"


@query(f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '"true"^^<{terms.XSD}boolean>' WHEN 1 THEN '"' || event_id || '"^^<{terms.XSD}integer>' WHEN 2 THEN '".5e3"^^<{terms.XSD}double>'
    WHEN 3 THEN 'http://a.b/c' WHEN 4 THEN '"2022-12-01T12:30"^^<{terms.XSD}dateTime>' WHEN 5 THEN '_:b1' ELSE '"some text"' END AS term FROM events""")
def q40_parse_object(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", terms.parse_object(F.expr(_MIXED.format(s="STRING"))).alias("term"))


@query(f"SELECT DISTINCT '{X}/customer/' || c_custkey AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING' AND r_name = 'ASIA'")
def q41_search(spark, sf):
    g = Lifted(spark, sf).view("customer", "nation", "region")
    path = {"c_nationkey": f"{X}/customer#c_nationkey", "n_regionkey": f"{X}/nation#n_regionkey", "r_name": f"{X}/region#r_name", "segment": f"{X}/customer#c_mktsegment"}
    return search.search(g, f"{X}/customer", {"segment": "BUILDING", "c_nationkey.n_regionkey.r_name": "ASIA"}, name=path.__getitem__)


@query(f"""SELECT '{X}/customer/' || c_custkey AS s FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def q42_search_list(spark, sf):
    rows = Lifted(spark, sf).star("orders", "order", s="o_custkey", o="o_orderstatus").select("s", "o")
    g = rows.select("s", F.lit("status").alias("p"), terms.literal(F.col("o")).alias("o"))
    return search.search(g, None, {"status": ["F", "O"]}, name=lambda k: k)


@query(f"SELECT DISTINCT '{X}/brand/' || p_brand AS cls, 'exactly' AS type, '{X}/type/' || p_type AS value, CAST(max(p_size) AS BIGINT) AS cardinality FROM part GROUP BY p_brand, p_type HAVING max(p_size) > 30")
def q43_restrictions(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand", "p_type").agg(F.max("p_size").cast("long").alias("cardinality"))
    rows = rows.select(F.concat(F.lit(f"{X}/brand/"), "p_brand").alias("cls"), F.lit(f"{X}#has").alias("property"), F.concat(F.lit(f"{X}/type/"), "p_type").alias("value"), "cardinality")
    g = restrictions.restriction_triples(rows, "exactly").unionByName(restrictions.restriction_triples(rows, "some"))
    return restrictions.restrictions(g, type="exactly").where("cardinality > 30").select("cls", "type", "value", "cardinality")


@query(f"""WITH c AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), via AS (SELECT r, n, 2.0 + n AS cost FROM c), best AS (SELECT r, n, cost, row_number() OVER (PARTITION BY r ORDER BY cost, n) AS rank FROM via)
    SELECT '{X}/region/' || r AS target, CAST(rank AS INTEGER) AS rank, CAST(cost AS DOUBLE) AS cost FROM best WHERE rank <= 3""")
def q44_routes(spark, sf):
    g = Lifted(spark, sf)
    edges = g.star("nation", "s", o="n_regionkey").select("s", "o").select("s", F.lit(routes.MAPS_TO).alias("p"), "o")
    sources = g.star("nation", "node", key="n_nationkey").select("node", "key").select("node", F.col("key").cast("double").alias("cost"))
    targets = g.star("region", "node").select("node")
    return routes.cheapest(routes.steps(edges), sources, targets, k=3).select("target", "rank", "cost")


@query("SELECT p_partkey, round(p_size * 0.0254 / 0.01, 4) AS cm, round(CAST(p_size AS DOUBLE) + 273.15, 4) AS kelvin, CAST(NULL AS DOUBLE) AS none FROM part")
def q45_convert_units(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.lit("in").alias("a"), F.lit("cm").alias("b"), F.lit("°C").alias("c"), F.lit("K").alias("d"))
    u = units.table(spark)
    out = units.convert(rows, u, "x", "a", "b", "cm")
    out = units.convert(out, u, "x", "c", "d", "kelvin")
    return units.convert(out, u, "x", "a", "d", "none").select("p_partkey", F.round("cm", 4).alias("cm"), F.round("kelvin", 4).alias("kelvin"), "none")


@query(f"""WITH l AS (SELECT p_type AS label, 0 AS rank, '{X}/part/' || p_partkey AS iri FROM part WHERE p_size < 5 UNION ALL SELECT p_type, 1, '{X}/part/' || p_partkey FROM part WHERE p_size >= 5)
    SELECT label, iri FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank, iri) = 1""")
def q46_label_index(spark, sf):
    rows = Lifted(spark, sf).star("part", "s", label="p_type", size="p_size").select("s", "label", "size")
    p = F.when(F.col("size") < 5, names.LABELS[0]).otherwise(names.LABELS[1])
    return names.label_index(rows.select("s", p.alias("p"), terms.literal(F.col("label"), lang="en").alias("o")))


@query("""SELECT p_partkey, round(CASE WHEN x < 10 THEN 1.0 WHEN x <= 20 THEN 1.0 + (x - 10) * 0.3 WHEN x <= 45 THEN 4.0 - (x - 20) * 0.1 ELSE 9.0 END, 6) AS y FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)""")
def q47_interpolate(spark, sf):
    y = registry.interpolate(F.col("p_size").cast("double"), [10, 20, 45], [1, 4, 1.5], right=9.0)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.round(y, 6).alias("y"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q48_json_literal(spark, sf):
    rows = Lifted(spark, sf).star("events", "event", props="props").df.select("event", terms.literal(F.col("props"), terms.RDF + "JSON").alias("o"))
    return rows.select(F.col("event").alias("event_id"), terms.parsed_json(F.col("o")).alias("v")).selectExpr("event_id", "try_variant_get(v, '$.k', 'bigint') AS k")


@query("SELECT event_id, event_id * 61 AS seconds FROM events")
def q49_durations(spark, sf):
    shown = terms.format_duration(F.col("event_id") * 61)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(terms.parse_duration(shown)).cast("long").alias("seconds"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total, CAST(max(p_size) AS DOUBLE) AS most FROM part")
def q50_literal_values(spark, sf):
    rows = Lifted(spark, sf).triples("part", ["p_size"]).where(terms.number(F.col("o")).isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(terms.integer(F.col("o"))).alias("total"), F.max(terms.number(F.col("o"))).alias("most"))


@query(f"SELECT '{X}/supplier/' || s_suppkey AS s FROM supplier WHERE regexp_matches(s_name, '[05]$')")
def q51_search_regex(spark, sf):
    return search.search(Lifted(spark, sf).triples("supplier"), None, regex={f"{X}/supplier#s_name": "[05]$"})


@query(f"SELECT '{X}/nation/' || n_nationkey AS s FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT '{X}/region/' || r_regionkey FROM region WHERE r_regionkey NOT IN (2)")
def q52_delete_reachable(spark, sf):
    g = Lifted(spark, sf)
    contains = g.star("nation", "o", s="n_regionkey").select("s", "o").select("s", F.lit(f"{X}#contains").alias("p"), "o")
    g2 = store.TripleStore(spark, g.triples("nation", ["n_name"]).unionByName(g.triples("region", ["r_name"])).unionByName(contains))
    return g2.delete(f"{X}/region/2").df.where(F.col("p") != f"{X}#contains").select("s")


@query("SELECT DISTINCT r_name AS region FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9500")
def q53_basic_graph_pattern(spark, sf):
    g = Lifted(spark, sf).view("supplier", "nation", "region")
    out = match(g, ("?s", f"{X}/supplier#s_acctbal", "?b"), ("?s", f"{X}/supplier#s_nationkey", "?n"), ("?n", f"{X}/nation#n_regionkey", "?r"), ("?r", f"{X}/region#r_name", "?region"))
    return out.filter(terms.number(F.col("b")) > 9500).project("region").distinct().select().select(text("region"))


@query(f"""SELECT '{X}/documents/' || d.doc_id AS doc, x.quality AS quality, x.grade AS grade FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    JOIN (SELECT 0 AS quality, 'low' AS grade UNION ALL SELECT 1, 'high') x ON l.quality IS NULL OR l.quality = x.quality""")
def q54_maybe_unbound_join(spark, sf):
    g = Lifted(spark, sf)
    left = g.star("documents", "doc").optional(g.rows("labels", doc="doc_id->documents", quality="quality"))
    return left.join(Solutions(spark.createDataFrame([(0, "low"), (1, "high")], "quality int, grade string"))).select("doc", "quality", "grade")


@query(f"""SELECT '{X}/documents/' || doc_id AS s, '{X}/documents#text' AS p, length(text) AS n_chars, md5(text) AS digest, '{terms.XSD}string' AS datatype, regexp_matches(text, '(?i)license') AS found FROM documents""")
def q55_text_literals(spark, sf):
    rows = Lifted(spark, sf).triples("documents", ["text"])
    typed = rows.select("s", "p", F.concat("o", F.lit(f"^^<{terms.XSD}string>")).alias("o"))
    back = ntriples.parse(ntriples.lines(typed))
    plain = terms.lexical(F.col("o"))
    return back.select("s", "p", F.length(plain).alias("n_chars"), F.md5(plain).alias("digest"), terms.datatype(F.col("o")).alias("datatype"), plain.rlike("(?i)license").alias("found"))


@query(f"""SELECT '{X}/region/' || n_regionkey AS target, CAST(rank AS INTEGER) AS rank, CAST(c_custkey + 4.0 AS DOUBLE) AS cost, '{X}/customer/' || c_custkey AS source
    FROM (SELECT n_regionkey, c_custkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE rank <= 4""")
def q56_routes_of_two_steps(spark, sf):
    g = Lifted(spark, sf)
    nations = g.star("nation", "s", o="n_regionkey").select("s", "o")
    edges = g.star("customer", "s", o="c_nationkey").select("s", "o").unionByName(nations).select("s", F.lit(routes.MAPS_TO).alias("p"), "o")
    sources = g.star("customer", "node", key="c_custkey").select("node", "key").select("node", F.col("key").cast("double").alias("cost"))
    out = routes.cheapest(routes.steps(edges), sources, g.star("region", "node").select("node"), k=4)
    return out.select("target", "rank", "cost", F.substring_index(F.element_at("route", -1), " ", -1).alias("source"))


@query(f"""SELECT '{X}/nation/' || n_nationkey || '#density' AS target, CAST(10 + n_regionkey + 3 + n_nationkey AS DOUBLE) AS cost, '{X}/nation/' || n_nationkey || '#area' AS first_input FROM nation""")
def q57_routes_by_functions(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit(f"{X}/nation/"), F.col("n_nationkey").cast("string")).alias("n"), F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"))
    part = lambda x: F.concat("n", F.lit("#" + x))
    calls = n.select(F.lit(f"{X}#divide").alias("function"), F.array(part("people"), part("area")).alias("inputs"), part("density").alias("output"), F.lit(None).cast("double").alias("cost"))
    # the area is mapped from a survey, the number of people is a value
    edges = n.select(part("survey").alias("s"), F.lit(routes.MAPS_TO).alias("p"), part("area").alias("o"))
    sources = n.select(part("survey").alias("node"), (F.col("key") + 1.0).alias("cost")).unionByName(n.select(part("people").alias("node"), F.col("region").cast("double").alias("cost")))
    out = routes.cheapest(routes.steps(edges, functions=calls), sources, n.select(part("density").alias("node")), k=1)
    mapped = F.filter("route", lambda x: x.startswith("mapsTo "))
    return out.select("target", "cost", F.replace(F.substring_index(mapped[0], " ", -1), F.lit("#survey"), F.lit("#area")).alias("first_input"))


def flagship(spark, sf):
    """Customers and balance per region: a chain of four patterns and a group."""
    g = Lifted(spark, sf)
    out = g.star("customer", "customer", nation="c_nationkey", balance="c_acctbal").join(g.star("nation", "nation", r="n_regionkey")).join(g.star("region", "r", region="r_name"))
    return out.group("region", customers=F.count(F.lit(1)), balance=F.round(F.sum("balance"), 2)).select()


QUERIES["q00_flagship"] = flagship
ORACLES["q00_flagship"] = "SELECT r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


from graphloom.plans import described_queries, graph_queries  # noqa: E402

for module in (described_queries, graph_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
