import pytest

from graphloom.functions.names import PREFIXES
from graphloom.operators import inheritance as inh

EX = "http://ex.org/"
BASE = {
    "prefixes": {"ex": EX}, "theme": "ex:base",
    "resources": {
        "Thing": {"iri": "ex:Thing", "keywords": {"name": {"iri": "ex:name", "conformance": "mandatory", "description": 'A "name"'}, "size": {"iri": "ex:size", "datatype": "xsd:integer", "conformance": "optional"}}},
        "Sample": {"iri": "ex:Sample", "subClassOf": "ex:Thing", "keywords": {"batch": {"iri": "ex:batch", "range": "ex:Batch"}}},
        "Batch": {"iri": "ex:Batch", "subClassOf": ["ex:Thing"]},
    },
}
MIDDLE = {"prefixes": {"ex": EX}, "basedOn": "base", "theme": "ex:middle", "resources": {"Sample": {"iri": "ex:Sample", "keywords": {"size": {"iri": "ex:size", "datatype": "xsd:double", "conformance": "recommended"}, "batch": {"iri": "ex:batch", "range": "ex:Batch", "conformance": "ddoc:mandatory"}}}}}
TOP = {"prefixes": {"ex": EX}, "basedOn": ["middle"], "theme": "ex:top", "resources": {"Fine": {"iri": "ex:Fine", "subClassOf": "ex:Sample", "keywords": {"grain": {"iri": "ex:grain"}}}}}
CLASH = {"prefixes": {"ex": EX}, "basedOn": "base", "resources": {"Other": {"iri": "ex:Other", "keywords": {"name": {"iri": "ex:title"}}}}}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def parts(spark):
    return inh.tables(spark, {"base": BASE, "middle": MIDDLE, "top": TOP})


def test_bases_and_classes_are_inherited(parts):
    definitions, based_on, parents = parts
    resolved = inh.resolve(definitions, based_on)
    assert rows(resolved.where("schema = 'top' AND keyword IS NOT NULL"), "cls_name", "keyword", "origin", "distance") == [
        ("Fine", "grain", "top", 0), ("Sample", "batch", "middle", 1), ("Sample", "size", "middle", 1), ("Thing", "name", "base", 2), ("Thing", "size", "base", 2),
    ]
    held = inh.inherit(resolved, parents)
    fine = held.where(f"schema = 'top' AND cls = '{EX}Fine'")
    # the nearest definition of size is the sample's
    got = {r.keyword: (r.above, r.datatype) for r in fine.collect()}
    assert got == {"batch": (1, "@id"), "grain": (0, None), "name": (2, None), "size": (1, PREFIXES["xsd"] + "double")}
    # a batch is a thing in every schema
    assert {r.schema for r in held.where(f"cls = '{EX}Batch' AND keyword = 'name'").collect()} == {"base", "middle", "top"}


def test_keywords_by_class_theme_and_domain(parts):
    definitions, based_on, parents = parts
    held = inh.inherit(inh.resolve(definitions, based_on), parents)
    size = inh.keywords(held, "top").where("keyword = 'size'").first()
    assert size.domains == [EX + "Sample", EX + "Thing"] and size.conformance == "recommended"
    assert {r.keyword for r in inh.keywords(held, "top", [EX + "Batch"]).collect()} == {"name", "size"}
    assert {r.keyword for r in inh.keywords(held, "top", themes=["ex:top", "ex:middle"]).collect()} == {"grain", "size", "batch"}
    assert inh.keywords(held, "base").where("keyword = 'batch'").first().conformance == "optional"


def test_conflicts(spark):
    definitions, based_on, _ = inh.tables(spark, {"base": BASE, "clash": CLASH})
    with pytest.raises(Exception, match="keyword defined twice: clash name"):
        inh.resolve(definitions, based_on).collect()
    of = lambda rule: {r.iri for r in inh.resolve(definitions, based_on, rule).where("schema = 'clash' AND keyword = 'name'").collect()}
    assert of("skip") == {EX + "name"} and of("allow") == {EX + "title"}
    with pytest.raises(ValueError):
        inh.resolve(definitions, based_on, "other")
    with pytest.raises(ValueError, match="conformance"):
        inh.tables(spark, {"x": {"resources": {"A": {"iri": "ex:A", "keywords": {"k": {"iri": "ex:k", "conformance": "perhaps"}}}}}})


def test_cycles_of_bases_end(spark):
    a, b = {**MIDDLE, "basedOn": "b"}, {**TOP, "basedOn": "a"}
    definitions, based_on, _ = inh.tables(spark, {"a": a, "b": b})
    assert rows(inh.resolve(definitions, based_on).where("schema = 'a'"), "keyword", "distance") == [("batch", 0), ("grain", 1), ("size", 0)]


def test_lacking_keywords(spark, parts):
    definitions, based_on, parents = parts
    held = inh.inherit(inh.resolve(definitions, based_on), parents)
    kind = PREFIXES["rdf"] + "type"
    g = spark.createDataFrame([("s1", kind, EX + "Fine"), ("s1", EX + "name", '"x"'), ("s2", kind, EX + "Thing"), ("s3", kind, EX + "Sample"), ("s3", EX + "batch", "b"), ("s3", EX + "size", "1"), ("s4", kind, EX + "Unknown")], "s string, p string, o string")
    assert rows(inh.lacking(g, held, "top"), "s", "keyword", "conformance") == [("s1", "batch", "mandatory"), ("s1", "size", "recommended"), ("s2", "name", "mandatory"), ("s3", "name", "mandatory")]


def test_writing_and_reading_back(spark, parts):
    definitions, based_on, parents = parts
    resolved = inh.resolve(definitions, based_on)
    back = inh.tables(spark, inh.from_documents(inh.as_documents(resolved, parents).collect()))
    columns = ["schema", "cls", "cls_name", "keyword", "iri", "datatype", "conformance", "description"]
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert key(inh.resolve(back[0], back[1])) == key(resolved)
    assert rows(back[2].select("cls", "parent").distinct(), "cls", "parent") == rows(parents.select("cls", "parent").distinct(), "cls", "parent")
    g = {tuple(r) for r in inh.as_triples(resolved, parents).collect()}
    rdfs, owl = PREFIXES["rdfs"], PREFIXES["owl"]
    assert (EX + "size", rdfs + "domain", EX + "Thing") in g and (EX + "size", rdfs + "domain", EX + "Sample") in g and (EX + "name", rdfs + "comment", '"A \\"name\\""') in g
    assert (EX + "batch", PREFIXES["rdf"] + "type", owl + "ObjectProperty") in g and (EX + "Fine", rdfs + "subClassOf", EX + "Sample") in g
