import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names, terms

XSD, RDF = terms.XSD, terms.RDF


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r[0] for r in df.orderBy("n").select(f(F.col("v")).alias("out")).collect()]


def test_parts_of_terms(spark):
    rows = ["http://a.b/c", "_:x", '"plain"', '"hej"@DA', f'"1"^^<{XSD}integer>', '"a\\"b\\\\n\\nc\\t"', None]
    assert column(spark, rows, terms.lexical) == ["http://a.b/c", "_:x", "plain", "hej", "1", 'a"b\\n\nc\t', None]
    assert column(spark, rows, terms.language) == [None, None, None, "da", None, None, None]
    assert column(spark, rows, terms.datatype) == [None] * 4 + [XSD + "integer"] + [None] * 2
    assert column(spark, rows, terms.is_iri)[:3] == [True, False, False]


def test_quoting_round_trip(spark):
    rows = ["", 'a"b', "back\\slash", "\\n", "line\nfeed\r\ttab", "é😀", '\\"']
    assert column(spark, rows, lambda c: terms.lexical(terms.literal(c))) == rows
    assert [terms.term(r) for r in rows] == column(spark, rows, terms.literal)


@pytest.mark.parametrize(
    "value,reader",
    [(True, terms.boolean), (False, terms.boolean), (42, terms.integer), (-1.5, terms.number), (datetime.date(2020, 1, 2), terms.date), (b"\x01\xff", terms.binary)],
)
def test_python_values_round_trip(spark, value, reader):
    got = column(spark, [terms.term(value)], reader)[0]
    assert (bytes(got) if isinstance(value, bytes) else got) == value


def test_typed_values(spark):
    lit = lambda s, t: f'"{s}"^^<{XSD}{t}>'
    assert column(spark, [lit("1", "boolean"), lit("False", "boolean"), lit("x", "boolean"), '"true"'], terms.boolean) == [True, False, None, None]
    assert column(spark, [lit("12", "int"), lit("x", "int"), lit("1e3", "double"), '"5"'], terms.number) == [12.0, None, 1000.0, None]
    assert column(spark, [f'"{{}}"^^<{RDF}JSON>', f'"no"^^<{RDF}JSON>'], lambda c: terms.parsed_json(c).isNotNull()) == [True, False]


def test_durations(spark):
    rows = ["P1D", "PT1H", "PT1M", "P1DT2H3M4.5S", "-PT30S", "P1Y", "P", "x", None, "P2W"]
    assert column(spark, rows, terms.parse_duration) == [86400.0, 3600.0, 60.0, 93784.5, -30.0, pytest.approx(365.2422 * 86400), None, None, None, 1209600.0]
    assert column(spark, [0.0, 60.0, 3600.0, 86400.0, 93784.5, -30.0], terms.format_duration, "double") == ["PT0S", "PT1M", "PT1H", "P1D", "P1DT2H3M4.5S", "-PT30S"]


def test_parse_object(spark):
    d = lambda s, t: f'"{s}"^^<{XSD}{t}>'
    want = {
        "true": d("true", "boolean"), "False": d("false", "boolean"), "42": d("42", "integer"), ".1e10": d(".1e10", "double"), "1.": d("1.", "double"), "2022-12-01 12:30": d("2022-12-01T12:30", "dateTime"),
        "http://e.com/x": "http://e.com/x", "_:b": "_:b", '"abc"@en': '"abc"@en', "some text": '"some text"', "1 2": '"1 2"', "": '""', None: None,
    }
    assert column(spark, list(want), terms.parse_object) == list(want.values())


def test_equalities(spark):
    lit = lambda s, t: f'"{s}"^^<{XSD}{t}>'
    pairs = [(lit("1", "integer"), lit("1.0", "double")), ('"a"', '"a"@en'), ('"a"@en', '"a"@da'), ('"a"', lit("a", "string")), ("http://x", "http://x"), (lit("1", "integer"), '"1"')]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, a string, b string").orderBy("n")
    assert [r[0] for r in df.select(F.coalesce(terms.same_value(F.col("a"), F.col("b")), F.lit(False))).collect()] == [True, False, False, False, True, False]
    assert [r[0] for r in df.select(F.coalesce(terms.loosely_equal(F.col("a"), F.col("b")), F.lit(False))).collect()] == [False, True, False, True, True, False]


def test_names(spark):
    assert column(spark, ["http://a/b#c", "http://a/b/c", "x", "http://a/b#"], lambda c: names.split_iri(c)[1]) == ["c", "c", None, ""]
    assert column(spark, ["owl:Class", "nope:x", "http://a.b/c", "plain"], names.expand) == [names.PREFIXES["owl"] + "Class", "nope:x", "http://a.b/c", "plain"]
    assert column(spark, [names.PREFIXES["owl"] + "Class", "http://z/y"], names.compact) == ["owl:Class", "http://z/y"]
    assert names.iri("a") == RDF + "type"
    with pytest.raises(KeyError):
        names.iri("nope:x", strict=True)
    assert column(spark, ["http://a.b/c", "a b", "x:y", "//x"], names.is_uri) == [True, False, False, False]
    assert column(spark, ["x:y", "http://a.b", "plain"], names.is_curie) == [True, False, False]


def test_label_precedence(spark):
    pref, label, alt = names.LABELS
    rows = [("http://1", alt, '"A"'), ("http://2", label, '"A"'), ("http://3", pref, '"B"@en'), ("http://3", label, '"C"')]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    assert {tuple(r) for r in names.label_index(g).collect()} == {("A", "http://2"), ("B", "http://3"), ("C", "http://3")}
    assert ("http://3", "B") in {tuple(r) for r in names.labels_of(g).collect()}
