"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_lifted_chain_reads_only_what_it_needs(spark):
    plan = catalog.q11_star(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "c_acctbal" not in plan
    # a bound predicate leaves one branch of six; without one, all cells come from one scan
    optimized = lambda q: q(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized(catalog.q01_scan_predicate).count("Relation [") == 1
    assert optimized(catalog.q03_scan_object).count("Relation [") == 1
    assert "EqualTo(c_custkey,7)" in catalog.q02_scan_subject(spark, SF)._jdf.queryExecution().executedPlan().toString()
