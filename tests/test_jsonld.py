import json

import pytest

from graphloom.functions.names import PREFIXES
from graphloom.operators import jsonld
from graphloom.operators.jsonld import LdContext

EX, XSD, RDF = "http://ex.org/", PREFIXES["xsd"], PREFIXES["rdf"]
CONTEXT = {"@context": {
    "ex": EX, "xsd": XSD, "@base": "http://base/", "name": "ex:name", "knows": {"@id": "ex:knows", "@type": "@id"}, "age": {"@id": "ex:age", "@type": "xsd:integer"},
    "label": {"@id": "ex:label", "@container": "@language"}, "steps": {"@id": "ex:steps", "@container": "@list"}, "tags": {"@id": "ex:tags", "@container": "@set"}, "partOf": {"@reverse": "ex:hasPart"},
    "config": {"@id": "ex:config", "@type": "@json"}, "de": {"@id": "ex:de", "@language": "de"}, "Person": "ex:Person", "Class": {"@id": "ex:Class", "@type": PREFIXES["owl"] + "Class"},
    "address": {"@id": "ex:address", "@context": {"name": "ex:street", "zip": {"@id": "ex:zip", "@type": "xsd:integer"}}},
}}
DOC = {
    "@id": "ex:ann", "@type": ["Person", "ex:Other"], "name": 'An"n\n', "age": 42, "knows": ["ex:bob", {"@id": "carl", "name": "Carl"}], "label": {"en": "Ann", "DA": ["Anne", "Anna"]}, "steps": ["a", {"name": "b"}, 3],
    "tags": "one", "partOf": "ex:team", "config": {"k": [1, {"z": None}]}, "de": "Anna", "address": {"name": "Main St", "zip": "77", "knows": "ex:eve"}, "ex:flag": True, "ex:size": 1.5, "unknown": 1, "ex:none": None,
    "ex:typed": {"@value": "2020-01-01", "@type": "xsd:date"}, "ex:said": {"@value": "hej", "@language": "DA"},
}


@pytest.fixture(scope="module")
def context():
    return LdContext(CONTEXT)


def docs(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v) if v is not None else None) for i, v in enumerate(values)], "id int, doc string")


def test_triples(spark, context):
    got = {tuple(r) for r in jsonld.triples(docs(spark, DOC), context).collect()}
    ann, typed = EX + "ann", lambda v, t: f'"{v}"^^<{XSD}{t}>'
    want = {
        (ann, RDF + "type", EX + "Person"), (ann, RDF + "type", EX + "Other"), (ann, EX + "name", '"An\\"n\\n"'), (ann, EX + "age", typed(42, "integer")), (ann, EX + "knows", EX + "bob"), (ann, EX + "knows", "http://base/carl"), ("http://base/carl", EX + "name", '"Carl"'),
        (ann, EX + "label", '"Ann"@en'), (ann, EX + "label", '"Anne"@da'), (ann, EX + "label", '"Anna"@da'), (ann, EX + "tags", '"one"'), (EX + "team", EX + "hasPart", ann), (ann, EX + "de", '"Anna"@de'),
        (ann, EX + "flag", typed("true", "boolean")), (ann, EX + "size", typed(1.5, "double")), (ann, EX + "typed", typed("2020-01-01", "date")), (ann, EX + "said", '"hej"@da'),
    }
    assert want <= got
    rest = got - want
    at = lambda s, p: [o for a, b, o in rest if a == s and b == p]
    assert [json.loads(json.loads(o[: o.rindex("^^")])) for o in at(ann, EX + "config")] == [{"k": [1, {"z": None}]}]
    (address,) = at(ann, EX + "address")
    # the scoped context renames a term and keeps the others
    assert at(address, EX + "street") == ['"Main St"'] and at(address, EX + "zip") == [typed("77", "integer")] and at(address, EX + "knows") == [EX + "eve"]
    (cell,), items = at(ann, EX + "steps"), []
    while cell != RDF + "nil":
        items += at(cell, RDF + "first")
        (cell,) = at(cell, RDF + "rest")
    assert items[0] == '"a"' and items[2] == typed(3, "integer") and at(items[1], EX + "name") == ['"b"']
    assert len(rest) == 1 + 1 + 3 + 1 + 6 + 1
    assert got == {tuple(r) for r in jsonld.triples(docs(spark, DOC, None, [], DOC), context).collect()}
    with pytest.raises(Exception, match="unknown keyword"):
        jsonld.triples(docs(spark, DOC), context, unknown="raise").collect()


def test_graphs_and_arrays_of_documents(spark, context):
    got = {tuple(r) for r in jsonld.triples(docs(spark, [{"@id": "ex:a", "name": "A"}, {"@graph": [{"@id": "ex:b", "name": "B"}, {"name": "C"}]}]), context).collect()}
    assert {(s, o) for s, _, o in got if not s.startswith("_:")} == {(EX + "a", '"A"'), (EX + "b", '"B"')} and len(got) == 3


def test_expand(spark, context):
    got = {r.doc: json.loads(r.json) for r in jsonld.expand(docs(spark, DOC, {}, [{"name": "x"}, {"name": "y"}]), context).collect()}
    (one,) = got[0]
    assert one["@id"] == EX + "ann" and one["@type"] == [EX + "Person", EX + "Other"] and one[EX + "name"] == [{"@value": 'An"n\n'}]
    assert one[EX + "age"] == [{"@value": 42, "@type": XSD + "integer"}] and one[EX + "knows"] == [{"@id": EX + "bob"}, {"@id": "http://base/carl", EX + "name": [{"@value": "Carl"}]}]
    by_value = lambda x: x["@value"]
    assert sorted(one[EX + "label"], key=by_value) == sorted([{"@value": "Ann", "@language": "en"}, {"@value": "Anne", "@language": "da"}, {"@value": "Anna", "@language": "da"}], key=by_value)
    assert one[EX + "steps"] == [{"@list": [{"@value": "a"}, {EX + "name": [{"@value": "b"}]}, {"@value": 3}]}]
    assert one[EX + "address"] == [{EX + "street": [{"@value": "Main St"}], EX + "zip": [{"@value": "77", "@type": XSD + "integer"}], EX + "knows": [{"@id": EX + "eve"}]}]
    assert one[EX + "config"] == [{"@value": {"k": [1, {"z": None}]}, "@type": "@json"}] and one[EX + "flag"] == [{"@value": True}] and one[EX + "typed"] == [{"@value": "2020-01-01", "@type": XSD + "date"}]
    assert "unknown" not in one and EX + "none" not in one and got[1] == [] and got[2] == [{EX + "name": [{"@value": "x"}]}, {EX + "name": [{"@value": "y"}]}]


def test_compact_turns_expanded_documents_back(spark, context):
    plain = {"@id": "ex:ann", "@type": ["Person", "ex:Other"], "name": "Ann", "age": 42, "knows": ["ex:bob", "ex:carl"], "steps": ["a", {"name": "b"}], "tags": ["one"], "de": "Anna", "ex:flag": True, "ex:typed": {"@value": "x", "@type": "xsd:date"}, "ex:other": {"@id": "ex:z"}, "ex:both": [1, "2"], "ex:inner": {"name": "In", "ex:deep": {"age": 1}}}
    expanded = jsonld.expand(docs(spark, plain, [{"name": "x"}, {"name": "y"}]), context).withColumnsRenamed({"doc": "id", "json": "doc"})
    got = {r.doc: json.loads(r.json) for r in jsonld.compact(expanded, context).collect()}
    assert got == {0: plain, 1: [{"name": "x"}, {"name": "y"}]}


def test_kinds_of_terms(spark, context):
    assert context.is_reference("knows") and context.is_reference(EX + "knows") and not context.is_reference("age") and context.is_data("age") and not context.is_data("knows")
    assert context.is_class("Class") and not context.is_class("name") and context.is_annotation("name") and context.is_annotation("de") and not context.is_annotation("nothing") and not context.is_data("nothing")
    with pytest.raises(ValueError):
        jsonld.triples(spark.createDataFrame([], "doc string"), context, unknown="x")
