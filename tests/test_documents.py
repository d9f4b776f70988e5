import json

import pytest

from graphloom.functions.names import PREFIXES
from graphloom.operators import documents, search, tables
from graphloom.operators.store import ResourceExistsError, TripleStore
from graphloom.sources import files

EX = "http://ex.org/"
CONTEXT = documents.Context(
    keywords={
        "title": {"iri": "dcterms:title"}, "creator": {"iri": "dcterms:creator"}, "name": {"iri": "foaf:name"}, "size": {"iri": EX + "size", "type": "xsd:integer"},
        "inSeries": {"iri": "dcat:inSeries", "type": "@id"}, "tag": {"iri": EX + "tag"}, "conf": {"iri": EX + "conf", "type": "rdf:JSON"},
    },
    classes={"Dataset": {"iri": "dcat:Dataset", "subClassOf": ["dcat:Resource"], "mandatory": ["title"]}},
    prefixes={"ex": EX}, base=EX,
)
DOCS = [
    {"@id": "ex:d1", "@type": "Dataset", "title": "First", "creator": [{"name": "Ann"}, {"name": "Bob"}], "size": 3, "tag": ["x", "y"], "inSeries": "ex:s"},
    {"@id": "ex:d2", "@type": "Dataset", "size": "many", "tag": "y", "creator": {"@id": "ex:ann", "name": "Ann", "@type": "foaf:Person"}, "conf": {"a": [1]}},
    {"@id": "s", "title": {"@value": "Serie", "@language": "DA"}, "statements": [["ex:x", "ex:y", '"z"']], "ex:own": 1.5},
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(json.dumps(d),) for d in DOCS], "doc string")


@pytest.fixture
def g(spark, docs):
    return documents.store(TripleStore(spark), docs, CONTEXT)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_documents_become_triples(g):
    assert rows(g.objects(EX + "d1", PREFIXES["rdf"] + "type")) == [(PREFIXES["dcat"] + "Dataset",), (PREFIXES["dcat"] + "Resource",)]
    assert g.has(EX + "d1", EX + "size", 3) and g.has(EX + "d1", PREFIXES["dcat"] + "inSeries", EX + "s")
    assert g.has(EX + "x", EX + "y", '"z"') and g.has(EX + "s", "dcterms:title", '"Serie"@da') and g.has(EX + "s", EX + "own", 1.5)
    assert g.has(EX + "d2", EX + "conf", '"{\\"a\\": [1]}"^^<' + PREFIXES["rdf"] + "JSON>")
    assert g.has(EX + "s", "rdf:type", "owl:NamedIndividual")


def test_unknown_keywords(spark):
    bad = spark.createDataFrame([('{"@id": "ex:a", "nope": 1}',)], "doc string")
    with pytest.raises(Exception, match="nope"):
        documents.to_triples(bad, CONTEXT).collect()
    assert documents.to_triples(bad, CONTEXT, unknown="ignore").count() == 1


def test_store_methods(spark, g, docs):
    more = spark.createDataFrame([(json.dumps({"@id": "ex:d1", "title": "Again"}),), (json.dumps({"@id": "ex:new", "title": "New"}),)], "doc string")
    titles = lambda method: rows(documents.store(TripleStore(spark, g.df), more, CONTEXT, method).objects(EX + "d1", "dcterms:title"))
    assert titles("merge") == [('"Again"',), ('"First"',)] and titles("overwrite") == [('"Again"',)] and titles("ignore") == [('"First"',)]
    assert documents.store(TripleStore(spark, g.df), more, CONTEXT, "ignore").has(EX + "new")
    with pytest.raises(ResourceExistsError):
        documents.store(TripleStore(spark, g.df), more, CONTEXT, "raise")


def test_validate(g):
    assert rows(documents.validate(g.df, CONTEXT)) == [(EX + "d2", "size", "unreadable"), (EX + "d2", "title", "missing")]


def test_acquire_rebuilds_documents(spark, g):
    seeds = spark.createDataFrame([(EX + "d1",), (EX + "none",)], "s string")
    got = documents.nested(documents.acquire(g.df, seeds).collect(), EX + "d1")
    assert got["@id"] == EX + "d1" and got[PREFIXES["dcterms"] + "title"] == '"First"' and got[EX + "tag"] == ['"x"', '"y"']
    assert sorted(c[PREFIXES["foaf"] + "name"] for c in got[PREFIXES["dcterms"] + "creator"]) == ['"Ann"', '"Bob"']
    assert documents.nested([], "http://x") == {}


def test_search(g):
    find = lambda *a, **k: [r.s.removeprefix(EX) for r in search.search(g.df, *a, name=lambda key: CONTEXT.predicate(key), **k).orderBy("s").collect()]
    assert find(PREFIXES["dcat"] + "Dataset") == ["d1", "d2"]
    assert find(None, {"creator.name": "Ann"}) == ["d1", "d2"] and find(None, {"creator.name": "Bob"}) == ["d1"]
    assert find(None, {"tag": ["x", "y"]}) == ["d1"] and find(None, {"size": 3}) == ["d1"] and find(None, {"inSeries": EX + "s"}) == ["d1"]
    assert find(None, {"@id": EX + "d2"}) == ["d2"] and find([PREFIXES["dcat"] + "Dataset", PREFIXES["dcat"] + "Resource"], {"tag": "y"}) == ["d1", "d2"]
    assert find(None, regex={"title": "^fir"}) == [] and find(None, regex={"title": "^fir"}, flags="i") == ["d1"]
    assert find(None, regex={"creator.name": "^A.*n$"}) == ["d1", "d2"] and find(None, regex={"title": "F."}, flags="q") == []
    assert find(None, {"conf": None}) == ["d2"]


def test_table_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text('@id;@type;title;tag[?sep=|];creator[a].name;creator[b].name;tag\nex:t1;Dataset;"One; two";x|y;Ann;Bob;z\nex:t2;Dataset;;;;;\n')
    headers, df = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert headers == ["@id", "@type", "title", "tag[?sep=|]", "creator[a].name", "creator[b].name", "tag"]
    g = TripleStore(spark, tables.to_triples(df, headers, CONTEXT))
    assert g.has(EX + "t1", "rdf:type", "dcat:Dataset") and g.has(EX + "t1", "dcterms:title", '"One; two"')
    assert rows(g.objects(EX + "t1", EX + "tag")) == [('"x"',), ('"y"',), ('"z"',)]
    assert g.match(("?t", "dcterms:creator", "?c"), ("?c", "foaf:name", "?n")).df.count() == 2
    assert g.triples(EX + "t2").count() == 1
    back = tables.from_triples(g.df, {"title": PREFIXES["dcterms"] + "title", "tag": EX + "tag"}).collect()
    assert [(r.title, r.tag) for r in back] == [(['"One; two"'], ['"x"', '"y"', '"z"'])]
    assert tables.unique_headers(["a", "b", "a"]) == ["a[1]", "b", "a[2]"]
    with pytest.raises(ValueError):
        tables.parse_header("a[b")


def test_yaml_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "d.yaml").write_text("prefixes: {ex: http://ex.org/}\nDataset:\n- '@id': ex:y1\n  title: Yes\n- '@id': ex:y2\n  title: More\n")
    g = documents.store(TripleStore(spark), files.read_documents(spark, str(tmp_path / "d.yaml")), CONTEXT)
    assert {r.s for r in g.subjects("rdf:type", "dcat:Dataset").collect()} == {EX + "y1", EX + "y2"}
