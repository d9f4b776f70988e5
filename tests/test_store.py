import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.names import PREFIXES
from graphloom.operators import restrictions, store
from graphloom.operators.store import TripleStore, UniquenessError
from graphloom.sources import files, ntriples, turtle

EX = "http://ex.org/"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def g(spark):
    return TripleStore(spark, prefixes={"ex": EX}).add(
        [("ex:ann", "ex:name", '"Ann"'), ("ex:ann", "ex:knows", "ex:bob"), ("ex:bob", "ex:name", '"Bob"@en'), ("ex:bob", "ex:name", '"Bo"@da'), ("ex:bob", "ex:age", 42), ("ex:ann", "ex:name", '"Ann"')]
    )


def test_set_semantics_and_scans(g):
    assert g.df.count() == 5
    assert rows(g.objects("ex:ann", "ex:name")) == [('"Ann"',)]
    assert rows(g.subjects("ex:knows", "ex:bob")) == [(EX + "ann",)]
    assert g.triples("ex:bob", ["ex:name", "ex:age"]).count() == 3
    assert g.has("ex:ann") and not g.has("ex:eve") and g.has(o=42)


def test_value(g):
    assert g.value("ex:ann", "ex:name") == '"Ann"'
    assert g.value("ex:eve", "ex:name", default="none") == "none"
    with pytest.raises(UniquenessError):
        g.value("ex:bob", "ex:name")
    assert g.value("ex:bob", "ex:name", lang="DA") == '"Bo"@da'
    assert g.value("ex:bob", "ex:name", any=True) in ('"Bo"@da', '"Bob"@en')
    with pytest.raises(ValueError):
        g.value("ex:bob")
    assert rows(g.values(EX + "name")) == [(EX + "ann", '"Ann"')]


def test_set_remove_subtract(g):
    g.set([("ex:bob", "ex:name", '"Robert"')])
    assert rows(g.objects("ex:bob", "ex:name")) == [('"Robert"',)]
    g.remove("ex:bob", "ex:age")
    assert not g.has("ex:bob", "ex:age")
    assert g.remove().df.count() == 0


def test_update_sees_the_old_store(g):
    where = g.match(("?a", "ex:knows", "?b"))
    g.update(where, delete=[("?a", EX + "knows", "?b")], insert=[("?b", EX + "knows", "?a")])
    assert rows(g.subject_objects("ex:knows")) == [(EX + "bob", EX + "ann")]


def test_describe_and_delete_follow_blank_nodes(spark):
    g = TripleStore(spark).add([("http://a", "http://p", "_:x"), ("_:x", "http://p", "_:y"), ("_:y", "http://q", '"v"'), ("http://a", "http://p", "http://b"), ("http://b", "http://q", '"w"'), ("_:x", "http://r", "_:x")])
    assert {r.s for r in g.describe("http://a").collect()} == {"http://a", "_:x", "_:y"}
    assert {r.s for r in TripleStore(spark, g.df).delete("http://a", scope="blank").df.collect()} == {"http://b"}
    assert TripleStore(spark, g.df).delete("http://a").df.count() == 0


def test_saved_store_is_partitioned_by_predicate(spark, g, tmp_path):
    g.save(str(tmp_path / "store"))
    back = TripleStore.load(spark, str(tmp_path / "store"), {"ex": EX})
    assert rows(back.df) == rows(g.df)
    plan = back.triples(None, "ex:age")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p#" in plan


def test_lists_round_trip(spark):
    rnd = random.Random(1)
    items = [(o, i, f'"{rnd.randrange(100)}"') for o in range(5) for i in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame(items, "owner int, n int, item string")
    g = TripleStore(spark, store.lists(df, "owner", "n", "item"))
    heads = df.select("owner", F.concat(F.lit("_:list_"), F.md5(F.col("owner").cast("string")), F.lit("_1")).alias("s")).distinct()
    got = g.list_items(heads).join(heads.withColumnRenamed("s", "head"), "head").select("owner", "position", "item")
    assert rows(got) == sorted(items)


def test_restrictions(spark):
    make = lambda *r: spark.createDataFrame(list(r), "cls string, property string, value string, cardinality int")
    g = restrictions.restriction_triples(make(("c", "p", "v", None)), "some").unionByName(restrictions.restriction_triples(make(("c", "p", "v", 3)), "exactly")).unionByName(restrictions.restriction_triples(make(("d", "q", "w", 1)), "min"))
    owl, rdfs = PREFIXES["owl"], PREFIXES["rdfs"]
    old = spark.createDataFrame([("e", rdfs + "subClassOf", "_:r"), ("_:r", owl + "onProperty", "p"), ("_:r", owl + "someValueFrom", "v")], "s string, p string, o string")
    g = g.unionByName(old)
    parts = lambda **kw: rows(restrictions.restrictions(g, **kw).select("cls", "property", "type", "value", "cardinality"))
    assert parts(type="some") == [("c", "p", "some", "v", None), ("e", "p", "some", "v", None)]
    assert parts(type="exactly", cardinality=3) == [("c", "p", "exactly", "v", 3)] and parts(type="exactly", cardinality=2) == []
    assert parts(type="min") == [("d", "q", "min", "w", 1)] and parts(cls="d", property="q") == parts(type="min")
    with pytest.raises(ValueError):
        parts(type="some", cardinality=1)


TURTLE = """
@prefix ex: <http://ex.org/> . # comment
@base <http://base.org/> .
ex:a a ex:Class ; ex:p "x", "y"@EN , 'z'^^ex:t ; ex:n 1 , 2.5, 1e3, true .
<rel> ex:q [ ex:r ( 1 "two" ex:three ) ; ex:s [] ] .
_:b ex:long \"\"\"line "quoted"
next\"\"\" .
ex:dotted.name ex:p ex:a\\,b .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(TURTLE)
    got = {(r.p, r.o) for r in turtle.read(spark, str(tmp_path / "x.ttl")).collect()}
    xsd = PREFIXES["xsd"]
    assert {(EX + "p", '"x"'), (EX + "p", '"y"@en'), (EX + "p", f'"z"^^<{EX}t>'), (EX + "n", f'"1"^^<{xsd}integer>'), (EX + "n", f'"2.5"^^<{xsd}decimal>'), (EX + "n", f'"1e3"^^<{xsd}double>'), (EX + "n", f'"true"^^<{xsd}boolean>')} <= got
    assert (EX + "long", '"line \\"quoted\\"\\nnext"') in got and (EX + "p", EX + "a,b") in got
    df = turtle.parse(spark, TURTLE)
    assert rows(df.where(F.col("s") == "http://base.org/rel").select("p")) == [(EX + "q",)]
    g = TripleStore(spark, df)
    head = g.value(None, PREFIXES["rdf"] + "first", f'"1"^^<{xsd}integer>')
    assert [r.item for r in g.list_items(head).orderBy("position").collect()] == [f'"1"^^<{xsd}integer>', '"two"', EX + "three"]
    with pytest.raises(ValueError):
        turtle.parse(spark, "ex:a ex:b ~ .")


def test_ntriples_and_turtle_round_trip(spark, tmp_path):
    df = turtle.parse(spark, TURTLE)
    ntriples.write(df, str(tmp_path / "nt"))
    assert rows(ntriples.read(spark, str(tmp_path / "nt"), scope="")) == rows(df)
    ntriples.write_turtle(df, str(tmp_path / "ttl"), {"ex": EX})
    back = turtle.read(spark, str(tmp_path / "ttl"))
    named = lambda d: rows(d.where("NOT startswith(s, '_:') AND NOT startswith(o, '_:')"))
    assert back.count() == df.count() and named(back) == named(df)
    bad = spark.createDataFrame([("<http://a> <http://b> .",), ("# note",), ("",)], "value string")
    assert ntriples.parse(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="not a statement"):
        ntriples.parse(bad).collect()


def test_prefixes_and_bytes(spark, tmp_path):
    assert {tuple(r) for r in files.load_prefixes(files.save_prefixes(spark, {"ex": EX})).collect()} == {("ex", EX)}
    (tmp_path / "data.bin").write_bytes(b"\x00\x01")
    dcat = PREFIXES["dcat"]
    g = spark.createDataFrame([("http://d", dcat + "distribution", "_:x"), ("_:x", dcat + "downloadURL", f"file://{tmp_path}/data.bin")], "s string, p string, o string")
    got = files.read_bytes(spark, g, spark.createDataFrame([("http://d",)], "s string")).collect()
    assert [bytes(r.content) for r in got] == [b"\x00\x01"]
