import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import collections
from graphloom.functions.names import PREFIXES
from graphloom.operators import containers
from graphloom.session import Session
from graphloom.sources import schema

EX = "http://ex.org/"
SCHEMA = {
    "prefixes": {"ex": EX},
    "resources": {"Thing": {"iri": "ex:Thing", "subClassOf": "owl:Thing", "keywords": {"size": {"iri": "ex:size", "datatype": "xsd:integer", "conformance": "mandatory"}, "part": {"iri": "ex:part", "range": "ex:Thing"}, "note": {"iri": "ex:note"}}}},
}


def test_schema_from_mapping_and_back(spark):
    c = schema.from_mapping(SCHEMA)
    assert c.keywords["size"]["type"] == PREFIXES["xsd"] + "integer" and c.keywords["part"]["type"] == "@id" and c.keywords["note"]["type"] is None
    assert c.classes["Thing"] == {"iri": EX + "Thing", "subClassOf": [PREFIXES["owl"] + "Thing"], "mandatory": ["size"]}
    assert [r.keyword for r in schema.as_table(spark, c).collect()] == ["note", "part", "size"]
    g = schema.as_triples(spark, c)
    assert schema.missing(g, c, classes=True).count() == 0
    assert [r.keyword for r in schema.missing(g.where(F.col("s") != EX + "note"), c).collect()] == ["note"]
    assert schema.json_ld_context(c)["@context"]["part"] == {"@id": EX + "part", "@type": "@id"}


def test_schema_errors_and_extension():
    c = schema.from_mapping(SCHEMA)
    other = {"resources": {"Other": {"iri": "ex:Other", "keywords": {"size": {"iri": "ex:length"}}}}}
    for bad in ({}, {"resources": {"A": {}}}, {"resources": {"A": {"iri": "ex:A", "keywords": {"k": {}}}}}):
        with pytest.raises(schema.InvalidSchemaError):
            schema.from_mapping(bad)
    with pytest.raises(schema.InvalidSchemaError):
        schema.from_mapping(other, c)
    assert schema.from_mapping(other, c, "skip").keywords["size"]["iri"] == EX + "size"
    assert schema.from_mapping(other, c, "allow").keywords["size"]["iri"] == EX + "length"


def test_schema_from_table(spark):
    rows = spark.createDataFrame([("ex:depth", "ex:Thing", "xsd:double", "mandatory")], "id string, domain string, datatype string, conformance string")
    c = schema.load_table(rows, schema.from_mapping(SCHEMA))
    assert c.keywords["depth"] == {"iri": EX + "depth", "type": PREFIXES["xsd"] + "double"} and c.classes["Thing"]["mandatory"] == ["depth"]


VALUES = [{"a": 1, "b": {"c": [1, 2.5, "x", None, True, [], {}]}, "t": 'quote " and \\ \n'}, [1, [2, [3]], {"k": "v"}], {}]


def test_containers_round_trip(spark):
    df = spark.createDataFrame([(f"http://c/{i}", json.dumps(v)) for i, v in enumerate(VALUES)], "iri string, json string")
    g = containers.to_triples(df)
    for i, v in enumerate(VALUES):
        assert containers.collect(g, f"http://c/{i}") == v
    assert {(r.s, r.key) for r in containers.entries(g).where("startswith(s, 'http')").collect()} == {("http://c/0", "a"), ("http://c/0", "b"), ("http://c/0", "t")}
    known = {"a": EX + "a"}
    g = containers.to_triples(df, known=known)
    assert g.where(F.col("p") == EX + "a").count() == 1 and containers.collect(g, "http://c/0", known) == VALUES[0]


def test_collections(spark):
    df = spark.createDataFrame([(["b", "a"], ["c", "a"], {"k": ["x"]}, {"k": ["y"], "z": ["w"]}, "a")], "a array<string>, b array<string>, m map<string,array<string>>, n map<string,array<string>>, v string")
    r = df.select(
        collections.merge(F.col("a"), F.col("b")).alias("merge"), collections.add(F.col("a"), F.col("v")).alias("add"), collections.add(F.col("a"), F.lit("0")).alias("more"),
        collections.get(F.col("m"), "k").alias("get"), collections.get(F.col("m"), "no", "d").alias("default"), collections.update(F.col("m"), F.col("n")).alias("both"), collections.update(F.col("m"), F.col("n"), append=False).alias("over"),
        collections.label(F.col("m"), F.lit("http://e/x#y"), ("no",)).alias("label"),
    ).first()
    assert (r["merge"], r["add"], r["more"], r["get"], r["default"]) == (["b", "a", "c"], ["a", "b"], ["0", "a", "b"], ["x"], ["d"])
    assert r["both"] == {"k": ["x", "y"], "z": ["w"]} and r["over"] == {"k": ["y"], "z": ["w"]} and r["label"] == "y"


def test_session(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "g.ttl").write_text("<http://a> <http://p> 1 .")
    (tmp_path / "s.yaml").write_text(f"one: {{path: '{tmp_path}/g.ttl', format: turtle}}\ntwo: {{path: /root/testdata/sf0.001, format: tables, tables: [region]}}\nbad: {{path: x, format: y}}\n")
    s = Session.from_yaml(spark, str(tmp_path / "s.yaml"))
    assert s.names() == ["one", "two", "bad"] and s.store("one").df.count() == 1 and s.store("two").df.count() == 15
    with pytest.raises(ValueError):
        s.store("bad")
