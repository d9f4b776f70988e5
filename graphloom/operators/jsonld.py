"""JSON-LD by walks over variants: documents to triples, to expanded and to compact form.

Documents are parsed once into variants and walked level by level: a round takes the objects of one depth, turns their
entries into rows, joins the keys with the context's terms, and hands the nested objects to the next round, so documents of any
number and width are rows of joins and no document is held in Python. Expanded and compact documents are put together
again from the deepest level upwards.

A context may scope terms below a term (``@context`` of a term), and have prefixes, ``@base``, ``@vocab``, ``@language``, typed terms
(``@id``, ``@vocab``, ``@json`` or a datatype), containers (``@list``, ``@set``, ``@language``, ``@index``) and ``@reverse``. Contexts are given beside the
documents; a ``@context`` inside a document is not read. Keys that nothing expands are left out, as JSON-LD has it, or refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES, iri
from graphloom.functions.names import compact as shorten
from graphloom.functions.names import expand as lengthen
from graphloom.workspace import written

RDF = PREFIXES["rdf"]
TYPE, JSON = RDF + "type", RDF + "JSON"
TERMS = "scope int, term string, iri string, type string, container string, reverse boolean, language string, inner int"
OBJECT, LIST = "map<string,variant>", "array<variant>"


class LdContext:
    """Terms by scope: scope 0 is the context itself, every scoped context of a term is a scope of its own."""

    def __init__(self, *contexts: dict, prefixes: dict[str, str] | None = None):
        self.prefixes, self.base, self.vocab = dict(prefixes or {}), "", None
        self.rows: list[tuple] = []
        self._scopes, self._inside = 0, {}
        merged: dict = {}
        for c in contexts:
            merged |= c.get("@context", c)
        for k, v in merged.items():
            if isinstance(v, str) and not k.startswith("@") and v.endswith(("/", "#", ":")):
                self.prefixes[k] = v
        self.base, self.vocab = merged.get("@base", ""), merged.get("@vocab")
        self._scope(merged, merged.get("@language"))

    def _full(self, name: str) -> str:
        full = iri(name, self.prefixes)
        return full if "://" in full or full.startswith(("@", "urn:", "_:")) or not self.vocab else self.vocab + full

    def _scope(self, own: dict, language: str | None) -> int:
        scope, self._scopes = self._scopes, self._scopes + 1
        for term, spec in own.items():
            if term.startswith("@") or term in self.prefixes or spec is None:
                continue
            spec = {"@id": spec} if isinstance(spec, str) else spec
            name = spec.get("@reverse") or spec.get("@id") or term
            inner = self._inner(own, spec["@context"], language) if isinstance(spec.get("@context"), dict) else scope
            kind = spec.get("@type")
            kind = kind if kind is None or kind.startswith("@") else self._full(kind)
            self.rows.append((scope, term, self._full(name), kind, spec.get("@container"), "@reverse" in spec, spec.get("@language", language if "@language" not in spec else None), inner))
        return scope

    def _inner(self, own: dict, more: dict, language: str | None) -> int:
        """The scope of a term's own context; one that is met again inside itself is the same scope."""
        if id(more) not in self._inside:
            self._inside[id(more)] = self._scopes
            self._scope(own | more, more.get("@language", language))
        return self._inside[id(more)]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each term of each scope, as many as the context has."""
        return spark.createDataFrame(self.rows, TERMS)

    # -- kinds of terms ------------------------------------------------------------------------

    def definition(self, name: str) -> dict:
        """iri and type of a term given by its name, compact or full IRI; empty if it is none."""
        full = self._full(name)
        found = [r for r in self.rows if r[0] == 0 and (r[1] == name or r[2] == full)]
        return {"iri": found[0][2], "type": found[0][3], "language": found[0][6]} if found else {}

    def is_reference(self, name: str) -> bool:
        return self.definition(name).get("type") in ("@id", "@vocab")

    def is_class(self, name: str) -> bool:
        return self.definition(name).get("type") in (PREFIXES["rdfs"] + "Class", PREFIXES["owl"] + "Class")

    def is_annotation(self, name: str) -> bool:
        known = self.definition(name)
        return bool(known) and (known["type"] is None or known["language"] is not None)

    def is_data(self, name: str) -> bool:
        return bool(self.definition(name)) and not (self.is_reference(name) or self.is_class(name) or self.is_annotation(name))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _many(v: Column) -> Column:
    """A value as an array of variants."""
    return F.when(_is(v, "ARRAY"), _get(v, "$", LIST)).otherwise(F.array(v))


class _Walk:
    """What the three forms share: the entries of a level's objects, with what the context says about their keys."""

    def __init__(self, spark: SparkSession, context: LdContext, unknown: str):
        if unknown not in ("ignore", "raise"):
            raise ValueError(f"unknown keys are ignored or raise, not {unknown!r}")
        # a row for each term of the context
        self.terms, self.context, self.unknown = F.broadcast(context.table(spark)), context, unknown
        self.names = F.broadcast(context.table(spark).where("scope = 0").groupBy(F.col("term").alias("__name")).agg(F.min("iri").alias("__iri")))

    # names are expanded in steps of their own, so that long expressions are not repeated in one another

    def vocabulary(self, df: DataFrame, name: str, known: Column, out: str) -> DataFrame:
        """A column of keys or types as IRIs; NULL where one is none."""
        df = df.withColumn("__full", lengthen(F.col(name), self.context.prefixes))
        full = F.col("__full")
        relative = F.concat(F.lit(self.context.vocab), full) if self.context.vocab else F.lit(None).cast("string")
        return df.withColumn(out, F.coalesce(known, F.when(full.rlike("://|^urn:|^_:"), full), relative)).drop("__full")

    def resource(self, df: DataFrame, name: str, out: str) -> DataFrame:
        """A column of ``@id`` values as IRIs or blank nodes; relative ones are taken from the base."""
        df = df.withColumn("__full", lengthen(F.col(name), self.context.prefixes))
        full = F.col("__full")
        return df.withColumn(out, F.when(full.rlike("://|^urn:|^_:"), full).otherwise(F.concat(F.lit(self.context.base), full))).drop("__full")

    def named(self, df: DataFrame, place: Column, out: str) -> DataFrame:
        """The resource of the objects in v: their ``@id``, else blank nodes named by place and content."""
        df = self.resource(df.withColumn("__id", _get(F.col("v"), "$.@id")), "__id", "__iri")
        blank = F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws(" ", place, F.to_json("v")), 256), 1, 24))
        return df.withColumn(out, F.coalesce("__iri", blank)).drop("__id", "__iri")

    def entries(self, level: DataFrame) -> DataFrame:
        """The level's columns but v, with key, value, and the key's term (iri, type, container, reverse, language, inner)."""
        keep = [c for c in level.columns if c != "v"]
        rows = level.select(*keep, F.explode(_get(F.col("v"), "$", OBJECT)).alias("key", "value")).where(~_is(F.col("value"), "VOID"))
        rows = rows.join(self.terms.withColumnRenamed("term", "key"), ["scope", "key"], "left")
        rows = self.vocabulary(rows, "key", F.col("iri"), "iri")
        full = F.when(~F.col("key").startswith("@"), F.col("iri"))
        if self.unknown == "raise":
            bad = ~F.col("key").startswith("@") & F.col("iri").isNull()
            full = F.when(bad, F.raise_error(F.concat(F.lit("unknown keyword: "), "key"))).otherwise(full)
        return rows.withColumns({"iri": full, "inner": F.coalesce("inner", "scope"), "reverse": F.coalesce("reverse", F.lit(False))})

    def kinds(self, entries: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep``, pos and iri (NULL: none) of every type, with its name as it was given."""
        rows = entries.where("key = '@type'").select(*keep, F.posexplode(_many(F.col("value"))).alias("pos", "t")).select(*keep, "pos", _get(F.col("t"), "$").alias("__name"))
        return self.vocabulary(rows.join(self.names, "__name", "left"), "__name", F.col("__iri"), "iri").drop("__iri")

    def items(self, entries: DataFrame) -> DataFrame:
        """One row for each value of a property: pos and v, with language maps and index maps taken apart and lists told by ``listed``."""
        keep = [c for c in entries.columns if c != "value"]
        value = F.col("value")
        in_map = F.col("container").isin("@language", "@index") & _is(value, "OBJECT")
        listed = F.coalesce(F.col("container") == "@list", F.lit(False)) | _get(value, "$.@list", "variant").isNotNull()
        plain = F.when(_is(value, "OBJECT") & _get(value, "$.@list", "variant").isNotNull(), _many(_get(value, "$.@list", "variant"))).when(_is(value, "OBJECT") & _get(value, "$.@set", "variant").isNotNull(), _many(_get(value, "$.@set", "variant"))).otherwise(_many(value))
        plain = F.when(F.col("type") == "@json", F.array(value)).otherwise(plain)
        keyed = lambda k, v: F.transform(_many(v), lambda x: F.struct(k.alias("label"), x.alias("v")))
        mapped = F.flatten(F.transform(F.map_entries(_get(value, "$", OBJECT)), lambda e: keyed(e["key"], e["value"])))
        cells = F.when(in_map, mapped).otherwise(F.transform(plain, lambda x: F.struct(F.lit(None).cast("string").alias("label"), x.alias("v"))))
        rows = entries.select(*keep, (listed & ~in_map).alias("listed"), F.posexplode(cells).alias("pos", "cell")).select(*keep, "listed", "pos", F.col("cell.label").alias("label"), F.col("cell.v").alias("v"))
        # a language map's key is its texts' language
        spoken = F.when((F.col("container") == "@language") & F.col("label").isNotNull(), F.nullif(F.lower("label"), F.lit("@none"))).otherwise(F.col("language"))
        return rows.withColumn("language", spoken).drop("label").where(~_is(F.col("v"), "VOID"))


def _is_node(v: Column, kind: Column) -> Column:
    return _is(v, "OBJECT") & _get(v, "$.@value", "variant").isNull() & ~F.coalesce(kind == "@json", F.lit(False))


def _scalar(walk: _Walk, df: DataFrame) -> DataFrame:
    """``df`` with what its values v are that are no nodes: text, datatype, spoken (language), and whether they name a resource (names)."""
    v, json_kind = F.col("v"), F.coalesce(F.col("type") == "@json", F.lit(False))
    df = df.withColumn("whole", _is(v, "OBJECT") & ~json_kind)
    df = df.withColumns({"core": F.when(F.col("whole"), _get(v, "$.@value", "variant")).otherwise(v), "__told": _get(v, "$.@type")})
    df = walk.vocabulary(df, "__told", F.lit(None).cast("string"), "__told_iri").withColumn("shape", F.schema_of_variant("core"))
    df = df.withColumn("given", F.when(F.col("whole"), F.coalesce("__told_iri", F.when(F.col("__told") == "@json", F.lit("@json")), F.lit(""))).otherwise(F.coalesce("type", F.lit(""))))
    shape, given = F.col("shape"), F.col("given")
    native = F.when(shape == "BOOLEAN", terms.XSD + "boolean").when(shape == "BIGINT", terms.XSD + "integer").when(shape.rlike("^(DOUBLE|DECIMAL|FLOAT)"), terms.XSD + "double")
    df = df.withColumns({
        "text": F.when((shape == "STRING") & (given != "@json"), _get(F.col("core"), "$")).otherwise(F.to_json("core")),
        "datatype": F.when(given == "@json", JSON).when((given == "") | given.startswith("@"), native).otherwise(given),
        "names": ~F.col("whole") & (shape == "STRING") & (given.isin("@id", "@vocab") | F.col("reverse")),
    })
    spoken = F.when(F.col("whole"), F.lower(_get(v, "$.@language"))).otherwise(F.when(given.isin("", "@none"), F.lower("language")))
    return df.withColumn("spoken", F.when(F.col("datatype").isNull(), spoken)).drop("__told", "__told_iri")


def _literal(text: Column, datatype: Column, language: Column) -> Column:
    return F.concat(terms.quote(text), F.when(language.isNotNull(), F.concat(F.lit("@"), language)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(""))


def triples(docs: DataFrame, context: LdContext, column: str = "doc", unknown: str = "ignore") -> DataFrame:
    """s, p and o of JSON-LD documents (JSON text in ``column``; a document may be an array). Blank nodes are named by content and place."""
    walk = _Walk(docs.sparkSession, context, unknown)
    # a table of documents may be one row group, which one task would walk alone
    parsed = docs.repartition(column).select(F.parse_json(column).alias("d")).where("d IS NOT NULL")
    roots = parsed.select(F.explode(_many(F.col("d"))).alias("v"), F.lit(0).alias("scope"))
    level = walk.named(roots, F.lit(""), "s").select("scope", "s", "v")
    out = None
    while True:
        level = written(level, "ld-level")
        if level.isEmpty():
            return out.distinct() if out is not None else docs.sparkSession.createDataFrame([], "s string, p string, o string")
        entries = walk.entries(level)
        kinds = walk.kinds(entries, "s").select("s", F.lit(TYPE).alias("p"), F.col("iri").alias("o")).where("o IS NOT NULL")
        items = walk.items(entries.where("iri IS NOT NULL")).select("s", "iri", "type", "reverse", "language", "inner", "listed", "pos", "v")
        items = _scalar(walk, items.withColumn("node", _is_node(F.col("v"), F.col("type"))))
        items = walk.named(walk.resource(items, "text", "named"), F.concat_ws(" ", "s", "iri", F.col("pos").cast("string")), "child")
        items = items.withColumn("o", F.when(F.col("node"), F.col("child")).when(F.col("names"), F.col("named")).otherwise(_literal(F.col("text"), F.col("datatype"), F.col("spoken"))))
        items = written(items.select("s", "iri", "reverse", "inner", "listed", "pos", "node", "o", "v"), "ld-items")
        # the cells of a list are named by where it hangs
        cell = lambda n: F.concat(F.lit("_:list_"), F.md5(F.concat_ws(" ", "s", "iri")), F.lit("_"), n.cast("string"))
        last = items.where("listed").groupBy("s", "iri").agg(F.max("pos").alias("last"))
        cells = items.where("listed").join(last, ["s", "iri"])
        cells = cells.select(F.inline(F.array(
            F.struct(cell(F.col("pos")).alias("s"), F.lit(RDF + "first").alias("p"), F.col("o").alias("o")),
            F.struct(cell(F.col("pos")).alias("s"), F.lit(RDF + "rest").alias("p"), F.when(F.col("pos") == F.col("last"), RDF + "nil").otherwise(cell(F.col("pos") + 1)).alias("o")),
        )))
        heads = last.select("s", F.col("iri").alias("p"), cell(F.lit(0)).alias("o"))
        plain = items.where("NOT listed").select(F.when(F.col("reverse"), F.col("o")).otherwise(F.col("s")).alias("s"), F.col("iri").alias("p"), F.when(F.col("reverse"), F.col("s")).otherwise(F.col("o")).alias("o"))
        found = kinds.unionByName(cells).unionByName(heads).unionByName(plain)
        out = found if out is None else out.unionByName(found)
        below = items.where("node").select(F.col("inner").alias("scope"), F.col("o").alias("s"), "v")
        graphs = entries.where("key = '@graph'").select("scope", F.col("s").alias("place"), F.posexplode(_many(F.col("value"))).alias("n", "v")).where(_is(F.col("v"), "OBJECT"))
        level = below.unionByName(walk.named(graphs, F.concat_ws(" ", "place", F.col("n").cast("string")), "s").select("scope", "s", "v"))


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    made = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substr(made, F.lit(6), F.length(made) - 6))


def _member(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))


def _braced(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _assembled(levels: list[DataFrame], roots: DataFrame, single: bool) -> DataFrame:
    """doc and json: members (doc, parent, key, pos, json, child, listed, kept) of all levels put together from the deepest upwards.

    ``json`` is a finished value or NULL where ``child`` names the object below. With ``single`` an array of one value is that value, unless ``kept``.
    """
    made = None
    for level in reversed(levels):
        if made is not None:
            level = level.join(made.select("doc", F.col("parent").alias("child"), F.col("json").alias("below")), ["doc", "child"], "left").withColumn("json", F.coalesce("json", "below"))
            # an object without members that count is empty
        level = level.withColumn("json", F.coalesce("json", F.when(F.col("child").isNotNull(), F.lit("{}"))))
        by_key = level.groupBy("doc", "parent", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "json"))).alias("all"), F.bool_or("listed").alias("listed"), F.bool_or("kept").alias("kept"))
        values = F.transform("all", lambda x: x["json"])
        array = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
        one = F.when((F.size("all") == 1) & ~F.col("kept"), values[0]).otherwise(array) if single else array
        listed = F.concat(F.lit('{"@list":'), array, F.lit("}")) if single else F.concat(F.lit('[{"@list":'), array, F.lit("}]"))
        # what is an identifier or came finished stands alone
        shown = F.when(F.col("key") == "@id", values[0]).when(F.col("listed"), listed).otherwise(one)
        by_key = by_key.select("doc", "parent", F.struct("key", F.concat(_quoted(F.col("key")), F.lit(":"), shown).alias("text")).alias("member"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m["text"]), ",")
        made = by_key.groupBy("doc", "parent").agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("json"))
    if made is None:
        return roots.select("doc", F.lit("[]").alias("json"))
    tops = roots.select("doc", "place", F.col("path").alias("parent")).join(made, ["doc", "parent"], "left").where("json IS NOT NULL")
    whole = tops.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "json"))), lambda x: x["json"]).alias("all"))
    array = F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))
    shown = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(array) if single else array
    found = whole.select("doc", shown.alias("json"))
    return roots.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("json", F.lit("[]")).alias("json"))


def _roots(docs: DataFrame, key: str, column: str) -> DataFrame:
    parsed = docs.repartition(key).select(F.col(key).alias("doc"), F.parse_json(column).alias("d")).where("d IS NOT NULL")
    rows = parsed.select("doc", F.posexplode(_many(F.col("d"))).alias("place", "v"))
    return rows.select("doc", "place", F.col("place").cast("string").alias("path"), F.lit(0).alias("scope"), "v")


def expand(docs: DataFrame, context: LdContext, key: str = "id", column: str = "doc", unknown: str = "ignore") -> DataFrame:
    """doc (the row's ``key``) and json: every document in expanded form, members in order of their names."""
    walk = _Walk(docs.sparkSession, context, unknown)
    roots = written(_roots(docs, key, column), "ld-roots")
    level, levels = roots.select("doc", "path", "scope", "v"), []
    none, no = F.lit(None).cast("string"), F.lit(False)
    while not level.isEmpty():
        entries = walk.entries(level)
        whole = [none.alias("child"), no.alias("listed"), no.alias("kept")]
        ids = walk.resource(entries.where("key = '@id'").withColumn("__name", _get(F.col("value"), "$")), "__name", "__iri")
        ids = ids.select("doc", F.col("path").alias("parent"), F.lit("@id").alias("key"), F.lit(0).alias("pos"), _quoted(F.col("__iri")).alias("json"), *whole)
        kinds = walk.kinds(entries, "doc", "path").select("doc", F.col("path").alias("parent"), F.lit("@type").alias("key"), "pos", _quoted(F.coalesce("iri", "__name")).alias("json"), *whole)
        items = walk.items(entries.where("iri IS NOT NULL"))
        items = walk.resource(_scalar(walk, items.withColumn("node", _is_node(F.col("v"), F.col("type")))), "text", "named")
        # numbers and truth values say their type themselves
        own = F.col("shape").isin("STRING") | F.col("whole") | ~F.coalesce(F.col("given").startswith("@") | (F.col("given") == ""), F.lit(True)) | (F.col("given") == "@json")
        items = items.withColumns({"told": F.when(own, F.when(F.col("datatype") == JSON, F.lit("@json")).otherwise(F.col("datatype"))), "raw": F.to_json("core")})
        literal = _braced(_member("@language", _quoted(F.col("spoken"))), _member("@type", _quoted(F.col("told"))), _member("@value", F.col("raw")))
        leaf = F.when(F.col("node"), none).when(F.col("names"), _braced(_member("@id", _quoted(F.col("named"))))).otherwise(literal)
        node = F.col("node")
        child = F.concat_ws("/", "path", F.md5("key"), F.col("pos").cast("string"))
        made = items.select("doc", F.col("path").alias("parent"), F.col("iri").alias("key"), "pos", leaf.alias("json"), F.when(node, child).alias("child"), "listed", no.alias("kept"), F.col("inner").alias("scope"), "v")
        made = written(made, "ld-members")
        levels.append(ids.unionByName(kinds).unionByName(made.drop("scope", "v")))
        level = written(made.where("child IS NOT NULL").select("doc", F.col("child").alias("path"), "scope", "v"), "ld-level")
    return _assembled(levels, roots, False)


def compact(docs: DataFrame, context: LdContext, key: str = "id", column: str = "doc") -> DataFrame:
    """doc and json: expanded documents with the context's terms.

    A property takes the term whose type or language its value has, else one without either, else its compact IRI; values that
    the term explains are plain, others keep their object; arrays of one value are that value unless the term is a ``@set``.
    """
    roots = written(_roots(docs, key, column), "ld-roots")
    spark = docs.sparkSession
    # a row for each term of the outermost scope
    known = context.table(spark).where("scope = 0 AND NOT reverse").groupBy("iri", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("language", F.lit("")).alias("language")).agg(F.min(F.struct("term", "container")).alias("t"))
    by_iri = F.broadcast(known.groupBy("iri").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "type", "language"), "t"))).alias("terms")))
    names = F.broadcast(context.table(spark).where("scope = 0 AND NOT reverse").groupBy(F.col("iri").alias("__iri")).agg(F.min("term").alias("__term")))
    level, levels = roots.select("doc", "path", "v"), []
    none, no, v = F.lit(None).cast("string"), F.lit(False), F.col("v")
    short = lambda x: shorten(x, context.prefixes)
    while not level.isEmpty():
        entries = level.select("doc", "path", F.explode(_get(v, "$", OBJECT)).alias("iri", "value"))
        ids = entries.where("iri = '@id'").select("doc", F.col("path").alias("parent"), F.lit("@id").alias("key"), F.lit(0).alias("pos"), _quoted(short(_get(F.col("value"), "$"))).alias("json"), none.alias("child"), no.alias("listed"), no.alias("kept"))
        kinds = entries.where("iri = '@type'").select("doc", "path", F.posexplode(_many(F.col("value"))).alias("pos", "t")).select("doc", "path", "pos", _get(F.col("t"), "$").alias("__iri")).join(names, "__iri", "left")
        kinds = kinds.select("doc", F.col("path").alias("parent"), F.lit("@type").alias("key"), "pos", _quoted(F.coalesce("__term", short(F.col("__iri")))).alias("json"), none.alias("child"), no.alias("listed"), no.alias("kept"))
        rows = entries.where("NOT startswith(iri, '@')").select("doc", "path", "iri", F.posexplode(_many(F.col("value"))).alias("pos", "cell"))
        # a list is one cell whose values follow each other
        rows = rows.select("doc", "path", "iri", _get(F.col("cell"), "$.@list", "variant").isNotNull().alias("listed"), F.col("pos").alias("outer"), F.posexplode(F.when(_get(F.col("cell"), "$.@list", "variant").isNotNull(), _many(_get(F.col("cell"), "$.@list", "variant"))).otherwise(F.array("cell"))).alias("place", "v"))
        rows = rows.withColumn("pos", F.when(F.col("listed"), F.col("place")).otherwise(F.col("outer"))).join(by_iri, "iri", "left")
        only = _get(v, "$.@id").isNotNull() & (F.size(F.map_keys(_get(v, "$", OBJECT))) == 1)
        node = _get(v, "$.@value", "variant").isNull() & ~only
        kind = F.when(_get(v, "$.@value", "variant").isNull(), "@id").otherwise(F.coalesce(_get(v, "$.@type"), F.lit("")))
        spoken = F.coalesce(_get(v, "$.@language"), F.lit(""))
        term = lambda k, l: F.try_element_at("terms", F.concat_ws(" ", k, l))  # noqa: E731, E741
        exact = F.coalesce(term(kind, spoken), F.when(kind == "@id", term(F.lit("@vocab"), F.lit(""))))
        chosen = F.coalesce(exact, term(F.lit(""), F.lit("")))
        explained = exact.isNotNull()
        value = F.to_json(_get(v, "$.@value", "variant"))
        bare = (kind == "") & (spoken == "")
        literal = F.when(explained | bare, value).otherwise(_braced(_member("@language", F.when(spoken != "", _quoted(spoken))), _member("@type", F.when(kind != "", _quoted(short(kind)))), _member("@value", value)))
        reference = F.when(explained, _quoted(short(_get(v, "$.@id")))).otherwise(_braced(_member("@id", _quoted(short(_get(v, "$.@id"))))))
        child = F.concat_ws("/", "path", F.md5("iri"), F.col("outer").cast("string"), F.col("place").cast("string"))
        as_list = F.coalesce(chosen["container"] == "@list", no)
        made = rows.select("doc", F.col("path").alias("parent"), F.coalesce(chosen["term"], short(F.col("iri"))).alias("key"), "pos", F.when(node, none).when(only, reference).otherwise(literal).alias("json"), F.when(node, child).alias("child"), (F.col("listed") & ~as_list).alias("listed"), (F.coalesce(chosen["container"] == "@set", no) | as_list).alias("kept"), "v")
        made = written(made, "ld-members")
        levels.append(ids.unionByName(kinds).unionByName(made.drop("v")))
        level = written(made.where("child IS NOT NULL").select("doc", F.col("child").alias("path"), "v"), "ld-level")
    return _assembled(levels, roots, True)
