"""Personal data by candidate gradient boosting, in SQL functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers. High-recall generators
propose further spans in the text that base spans leave over: every sequence of whole digit groups
of a loose run that a kind's length allows, spelled-out and broken e-mail addresses with every end
of their domain. Proposals overlap. Boosted trees score every candidate by its format and context,
and a threshold calibrated for each kind on held-out candidates selects what is added.

The trees learn from every value that the base rules judged in any document (of at most ``LONGEST_VALUE``
characters, each different one once). Every value is spelled anew, in its own
context, in ways that the base rules miss (``respelled``), addresses under varied names and hosts, and
the generators run over the new text: the span of an accepted value is an example of its kind; spans
that cut it or reach beyond it, and all spans of a rejected value (wrong checksum, octets over 255, too
few or too many digits) or of a made counter-example (date, bare number, word before a host name) are
counter-examples. Addresses are judged by their marks and the shape of their domain, never by the
number of their letters or digits. Candidates
of the documents that are merely not base are neither. The trees are then evaluated as SQL expressions
inside arrays, so scoring moves no rows.

Defined cases: a null text has no spans; matches that fail their test are dropped without a retry; a
table without both sorts of examples trains nothing, and only base spans are reported; an added
span never overlaps a base span or an earlier added one (of overlapping candidates above
their thresholds the longest stays, then the best score, then the earliest); values and texts may be of any length, but a loose address has the lengths
that addresses may have; an empty table gives an empty result; repeated rows give repeated results;
columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise, text_or_empty
from graphloom.llm.spans import SPAN, let, listed, no_spans, spans_of, tagged

KINDS = ("email", "ip", "card", "phone")
#: Characters of a value at most that the trees learn from, and examples at least of each side of a split.
LONGEST_VALUE = 100
LEAST_EXAMPLES = 3
TREES, DEPTH, SEED = 20, 4, 11
#: Least precision on held-out candidates, and a score below which nothing is added.
PRECISION, LEAST_SCORE = 0.98, 0.6
#: Characters of context on either side.
CONTEXT = 24

#: The base patterns of the contract, with possessive or anchored repetition.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators. Names have at most 64 and labels of domains at most 63 characters; longer words are no addresses.
_AT, _LABEL = r"(?:@|\(at\)|\[at\]|\{at\}|(?<=\x20)at(?=\x20))", r"[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9-])"
LOOSE_EMAIL_HINT = r"[(\[{]at[)\]}]|\x20dot\x20"
LOOSE_DOT = r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|(?<=\x20)dot(?=\x20))\x20?" + _LABEL
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?" + _AT + r"\x20?" + _LABEL + f"(?:{LOOSE_DOT}){{1,126}}+"
LOOSE_NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
#: Digits of a local phone number at least, and of a card number at most.
LEAST_DIGITS, MOST_DIGITS = 7, 19
#: Stands for a character of a base span.
MASK = "\x00"

#: Endings of the hosts that made addresses get.
ENDINGS = ("com", "org", "net", "de", "fr", "io", "info", "edu", "co.uk")
#: What an address and its domain are like; 0 for numbers. All others but the words around are 0 for addresses.
MAIL = ("mail", "bare_at", "spaced_at", "spelled_dots", "plain_dots", "loose_dots", "last_letters", "last_short", "last_lower", "goes_on")
FEATURES = (*MAIL, "length", "digits", "groups", "plus", "parens", "dots", "dashes", "blanks", "octets", "luhn", "alone", "word_phone", "word_card", "word_ip", "word_mail", "before", "after")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    """Whether all four numbers are at most 255."""
    return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))


def _card(match: Column) -> Column:
    return F.length(_digits(match)).between(13, 19) & F.when(F.length(match) <= 40, luhn(_digits(match))).otherwise(False)


def _matches(text: Column, context: int = 0) -> dict[str, tuple]:
    """For each kind, the matches of its base pattern and the test that they have to pass."""
    rules = (
        ("email", EMAIL, lambda m: F.lit(True), text.contains("@")),
        ("ip", IP, _octets, text.rlike(r"[0-9]\.[0-9]")),
        ("card", CARD, _card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        ("phone", PHONE, lambda m: F.length(_digits(m)).between(9, 15), text.contains("+")),
    )
    return {kind: (F.when(worth, spans_of(text, pattern, context)).otherwise(no_spans()), rule) for kind, pattern, rule, worth in rules}


def base(text: Column) -> Column:
    """A struct with the base spans of each kind."""
    def kept(found: Column, rule) -> Column:
        return F.filter(found, lambda s: rule(s["match"]))

    return F.struct(*[kept(found, rule).alias(kind) for kind, (found, rule) in _matches(text).items()])


def masked(text: Column, spans: Column) -> Column:
    """The text with every character of some spans, sorted by start, replaced by MASK."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at = F.greatest(acc["at"], s["at"])
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (at - acc["at"]).cast("int"))
        return F.when(s["until"] <= acc["at"], acc).otherwise(F.struct(s["until"].alias("at"), F.concat(acc["out"], gap, F.repeat(F.lit(MASK), (s["until"] - at).cast("int"))).alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))))


def _groups(run: Column) -> Column:
    """The sequences of whole digit groups of a run that have LEAST_DIGITS to MOST_DIGITS digits."""
    near = CONTEXT

    def of(pieces: Column) -> Column:
        # a piece is a group with the separators before it; pieces add up to the run
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        ats = F.aggregate(pieces, start, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

        def from_one(x: Column, i: Column) -> Column:
            ahead = F.slice(pieces, i + 1, MOST_DIGITS)
            joined = F.transform(F.sequence(F.lit(1), F.size(ahead)), lambda n: F.struct(F.array_join(F.slice(ahead, F.lit(1), n), "").alias("whole"), n.alias("n")))
            fit = F.filter(joined, lambda j: F.length(_digits(j["whole"])).between(LEAST_DIGITS, MOST_DIGITS))

            def span(j: Column) -> Column:
                match = F.regexp_extract(j["whole"], r"(?:\+|\((?=[^(]*\)))?[0-9].*$", 0)
                skipped = F.length(j["whole"]) - F.length(match)
                lead = F.concat(run["left"], F.array_join(F.slice(pieces, F.greatest(i + 1 - near, F.lit(1)), F.least(i, F.lit(near))), ""), F.left(j["whole"], skipped))
                tail = F.concat(F.array_join(F.slice(pieces, i + 1 + j["n"], near), ""), run["right"])
                return F.struct(
                    (run["at"] + x + skipped).cast("long").alias("at"), (run["at"] + x + F.length(j["whole"])).cast("long").alias("until"), match.alias("match"),
                    F.right(lead, F.lit(near)).alias("left"), F.left(tail, F.lit(near)).alias("right"),
                )

            return F.transform(fit, span)

        return F.flatten(F.transform(ats, from_one)).cast(SPAN)

    return let(F.regexp_extract_all(run["match"], F.lit("[^0-9]*[0-9]+"), F.lit(0)), of)


def _domains(mail: Column) -> Column:
    """A loose e-mail address with each end that its domain may have."""

    def of(parts: Column) -> Column:
        def span(n: Column) -> Column:
            rest = F.array_join(F.slice(parts, n + 1, F.size(parts)), "")
            match = F.left(mail["match"], F.length(mail["match"]) - F.length(rest))
            return F.struct(mail["at"].alias("at"), (mail["until"] - F.length(rest)).cast("long").alias("until"), match.alias("match"), mail["left"].alias("left"), F.left(F.concat(rest, mail["right"]), F.lit(CONTEXT)).alias("right"))

        return F.transform(F.sequence(F.lit(1), F.size(parts)), span).cast(SPAN)

    # dots of the name before the at are not the domain's
    domain = F.regexp_extract(mail["match"], _AT + "(.*)$", 1)
    return let(F.regexp_extract_all(domain, F.lit(LOOSE_DOT), F.lit(0)), of)


def candidates(text: Column, part: bool = False) -> Column:
    """Proposed spans with context; they may overlap. ``part``: the text is part of one whose rest may hold the hints."""
    numbers = F.when(text.rlike("[0-9]"), F.flatten(F.transform(spans_of(text, LOOSE_NUMBER, CONTEXT), _groups))).otherwise(no_spans())
    mails = F.when(F.lit(part) | text.rlike(LOOSE_EMAIL_HINT) | text.contains("@"), F.flatten(F.transform(spans_of(text, LOOSE_EMAIL, CONTEXT), _domains))).otherwise(no_spans())
    return F.concat(numbers, mails)


def features(s: Column) -> dict[str, Column]:
    """Format and context of a candidate."""
    m, around = s["match"], F.lower(F.concat_ws(" ", s["left"], s["right"]))
    mail = m.rlike("[A-Za-z@]")
    digits = F.when(mail, "").otherwise(_digits(m))
    number = lambda c: F.when(mail, 0).otherwise(c)
    count = lambda chars: number(F.length(m) - F.length(F.translate(m, chars, "")))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    four = F.size(F.split(m, r"\.")) == 4
    domain = F.regexp_extract(m, _AT + "(.*)$", 1)
    found = lambda pattern: F.when(mail, F.regexp_count(domain, F.lit(pattern))).otherwise(0)
    last = F.regexp_extract(domain, "[A-Za-z0-9-]+$", 0)
    out = {
        "mail": yes(mail), "bare_at": yes(m.rlike(r"\x20at\x20") & ~m.rlike(r"@|[(\[{]at[)\]}]")), "spaced_at": yes(m.rlike(r"\x20(?:@|[(\[{]at[)\]}])|(?:@|[(\[{]at[)\]}])\x20")),
        "spelled_dots": found(r"[(\[{]dot[)\]}]|\x20dot\x20"), "plain_dots": found(r"(?<!\x20)\.(?!\x20)"), "loose_dots": found(r"\x20\.|\.\x20"),
        "last_letters": yes(mail & last.rlike("^[A-Za-z]+$")), "last_short": yes(mail & F.length(last).between(2, 6)), "last_lower": yes(mail & (last == F.lower(last))),
        # a longer candidate has the next dot, plain or spelled
        "goes_on": yes(mail & s["right"].rlike(r"^(?:\.[A-Za-z0-9]|\x20?[(\[{]dot[)\]}]|\x20dot\x20)")),
        "length": number(F.length(m)), "digits": F.length(digits), "groups": number(F.size(F.split(m, "[^0-9A-Za-z]+"))), "plus": yes(m.startswith("+")),
        "parens": count("()"), "dots": count("."), "dashes": count("-"), "blanks": count(" "),
        "octets": yes(four & ~mail & _octets(m)), "luhn": yes(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)),
        # neither side touches a letter, a digit or another number's separator
        "alone": yes(~s["left"].rlike(r"[0-9A-Za-z.+-]$") & ~s["right"].rlike(r"^[0-9A-Za-z]")),
        "word_phone": yes(around.rlike(r"phone|tel|mobile|call|fax")), "word_card": yes(around.rlike(r"card|visa|credit|account")),
        "word_ip": yes(around.rlike(r"\bip\b|host|server|address")), "word_mail": yes(around.rlike(r"mail|contact|write")),
        # another group of digits goes on behind a separator
        "before": yes(s["left"].rlike(r"[0-9][\x20().-]{0,2}$")), "after": yes(s["right"].rlike(r"^[\x20().-]{0,2}[0-9]")),
    }
    return {k: out[k].cast("double") for k in FEATURES}


def _kind(s: Column) -> Column:
    """The kind that a candidate's format asks for."""
    m = s["match"]
    return (
        F.when(m.rlike("[A-Za-z@]"), "email").when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(m.startswith("+") | m.contains("(") | (F.length(_digits(m)) < 13), "phone").otherwise("card")
    )


def respelled(kind: Column, m: Column, ok: Column) -> Column:
    """An array of (before, value, after, ok): spellings that base rules miss and made counter-examples.

    ``before`` and ``after`` come between the value and its context.
    """
    digits, lit = _digits(m), F.lit
    one = lambda value, good=ok, before=lit(""), after=lit(""): F.struct(before.alias("before"), value.alias("value"), after.alias("after"), good.alias("ok"))
    no = lit(False)
    spelled = [(a, d) for a, d in ((" @ ", "."), ("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"))]
    mails = let(_parts(m), lambda p: F.transform(F.array(*_mail_forms()), lambda f: _mail(m, p, f, ok)))
    ips = [one(m, before=lit("300.")), one(m, before=lit("999.888."))]
    fours = lambda by: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1" + by)
    cards = [one(fours(".")), one(fours("- ")), one(digits, before=F.concat(F.reverse(digits), lit(" "))), one(digits, after=F.concat(lit(" "), F.reverse(digits)))]
    cards += [one(fours(" "), before=F.concat(F.reverse(digits), lit(" "))), one(fours("-"), after=F.concat(lit("-"), F.reverse(digits)))]
    bare = [one(F.left(digits, lit(n)), no) for n in (8, 10, 12)]
    # the international code goes, the rest keeps its groups
    plain = F.regexp_replace(m, r"^\+", "")
    local = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20().-]*(?=[(]?[0-9])", "")
    local = F.when(m.rlike(r"^\+[0-9]+[\x20.-]?\("), F.regexp_replace(m, r"^\+[0-9]+[\x20.-]?", "")).when(m.rlike(r"^\+[0-9]{1,3}[\x20.-]"), local).otherwise(plain)
    by = lambda sep: F.regexp_replace(F.regexp_replace(local, r"[()]", ""), r"[\x20.-]+", sep)
    date = F.concat(lit("20"), F.substr(digits, lit(2), lit(2)), lit("-0"), F.substr(digits, lit(4), lit(1)), lit("-1"), F.substr(digits, lit(5), lit(1)))
    # a number that follows makes the base rule's match too long
    behind = [one(m, after=lit(" 170.106.47.218")), one(m, after=F.concat(lit(" "), F.reverse(digits), digits)), one(m, after=F.concat(lit(" 4"), F.reverse(digits)))]
    phones = [*behind, one(plain), one(local), *[one(by(x)) for x in (".", "-", " ")], one(date, no), one(F.replace(date, lit("-"), lit(".")), no), one(F.replace(date, lit("-"), lit(" ")), no)]
    return F.when(kind == "email", mails).when(kind == "ip", F.array(*ips)).when(kind == "phone", F.array(*phones)).otherwise(F.concat(F.array(*cards), F.when(~ok, F.array(*bare)).otherwise(F.array(*bare[:0]).cast("array<struct<before:string,value:string,after:string,ok:boolean>>"))))


def _parts(m: Column) -> Column:
    """Names and hosts that may be made of an address; ``%`` stands for an ending."""
    lit, name, host = F.lit, F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    stem = lambda x: F.concat(F.regexp_replace(x, "[^A-Za-z]", ""), F.when(x.rlike("[A-Za-z]"), "").otherwise("x"))

    def made(s: Column) -> Column:
        who, first = s["who"], s["first"]
        names = [name, who, F.initcap(who), F.concat(F.left(who, lit(1)), lit("."), F.reverse(who)), F.concat(who, lit("_"), F.left(first, lit(3))), F.left(who, lit(3)), F.concat(F.left(first, lit(4)), lit("-"), who), F.concat(F.left(who, lit(2)), lit("77"))]
        hosts = [host, F.concat(first, lit(".%")), F.concat(F.left(who, lit(5)), lit(".%")), F.concat(who, lit("-"), first, lit(".%")), F.concat(first, lit("."), F.reverse(who), lit(".%")), F.concat(F.left(first, lit(2)), lit("9.%"))]
        return F.struct(F.array(*names).alias("names"), F.array(*hosts).alias("hosts"), first.alias("bare"))

    return let(F.struct(stem(name).alias("who"), stem(F.regexp_replace(host, r"\..*$", "")).alias("first")), made)


def _mail_forms() -> list[Column]:
    """What stands for the marks of an address, and counter-examples: a word before a host, a mark before a sentence's end."""
    ats = [("(at)", "."), ("[at]", "."), ("{at}", "."), (" (at) ", "."), (" [at] ", "."), (" @ ", "."), ("@", "(dot)"), ("@", " dot "), ("@", "[dot]"), (" @ ", " dot ")]
    ats += [(a, d) for a in (" (at) ", " [at] ", " {at} ") for d in (" (dot) ", " [dot] ", " dot ")] + [(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " (dot) ")]
    forms = [("name", a, d, ("", ". Then", ", then", " then")[i % 4]) for i, (a, d) in enumerate(ats * 2)]
    forms += [("host", lead, ".", "") for lead in ("look at ", "back at the. ", "it is at ", "see us at ")] + [("bare", lead, ".", ". Then") for lead in ("was (at) ", "now @ ")] * 2
    forms += [("end", " at ", ".", ". Then")] * 6 + [("end", " at ", ".", ". then")] * 2
    return [F.struct(*[F.lit(v).alias(k) for k, v in zip(("how", "at", "dot", "after", "i"), (*f, i), strict=True)]) for i, f in enumerate(forms)]


def _mail(m: Column, p: Column, f: Column, ok: Column) -> Column:
    """One spelling of an address by a form, with the name, host and ending that its hash picks."""
    pick = lambda n, of: F.element_at(of, (F.pmod(F.xxhash64(m, f["i"], F.lit(SEED + n)), F.size(of)) + 1).cast("int"))
    name, host = pick(1, p["names"]), F.replace(pick(2, p["hosts"]), F.lit("%"), pick(3, F.array(*[F.lit(e) for e in ENDINGS])))
    # the end of a sentence is part of what a counter-example spans
    value = (
        F.when(f["how"] == "name", F.concat(name, f["at"], F.replace(host, F.lit("."), f["dot"]))).when(f["how"] == "host", F.concat(f["at"], host))
        .when(f["how"] == "bare", F.concat(f["at"], p["bare"], f["after"])).otherwise(F.concat(name, f["at"], p["bare"], f["after"]))
    )
    good = f["how"] == "name"
    return F.struct(F.lit("").alias("before"), value.alias("value"), F.when(good, f["after"]).otherwise("").alias("after"), (good & ok).alias("ok"))


def _judged(kind: str, rule):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["match"].alias("root"), rule(s["match"]).alias("ok"), s["left"].alias("left"), s["right"].alias("right"))


def examples(texts: DataFrame) -> DataFrame:
    """root, kind, label and the features of what is learned from a column ``text``: all its values, each in one context."""
    cells = []
    for kind, (found, rule) in _matches(F.col("text"), CONTEXT).items():
        # a card number of the wrong length is merely no card
        known = F.filter(found, lambda s: s["match"].rlike("^(?:[^0-9]*[0-9]){13,19}$")) if kind == "card" else found
        known = F.filter(known, lambda s: F.length(s["match"]) <= LONGEST_VALUE)
        cells.append(F.transform(known, _judged(kind, rule)))
    rows = texts.select(F.inline(F.concat(*cells))).groupBy("kind", "root", "ok").agg(F.min(F.struct(F.xxhash64("left", "right", F.lit(SEED)), "left", "right")).alias("s"))
    # a value is few bytes but many spellings, so partitions are not put together by their bytes
    rows = rows.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root")
    rows = rows.select("*", F.explode(respelled(F.col("kind"), F.col("root"), F.col("ok"))).alias("r"))
    lead = F.concat("s.left", "r.before")
    rows = rows.select("root", "kind", "r.ok", F.concat(lead, "r.value", "r.after", "s.right").alias("text"), F.length(lead).cast("long").alias("at"), (F.length(lead) + F.length("r.value")).cast("long").alias("until"))
    rows = rows.withColumn("own", _sorted(base(F.col("text"))))
    rows = rows.select("root", "kind", "ok", "at", "until", F.explode(candidates(masked(F.col("text"), F.col("own")), part=True)).alias("s"))
    rows = rows.where((F.col("s.at") < F.col("until")) & (F.col("at") < F.col("s.until")))
    same = (F.col("s.at") == F.col("at")) & (F.col("s.until") == F.col("until"))
    # a good value whose format asks for another kind teaches nothing
    rows = rows.where(~(same & F.col("ok") & (_kind(F.col("s")) != F.col("kind"))))
    return rows.select("root", _kind(F.col("s")).alias("kind"), (same & F.col("ok")).cast("double").alias("label"), *[v.alias(k) for k, v in features(F.col("s")).items()])


def _sorted(b: Column) -> Column:
    """All base spans as (at, until), by start."""
    return F.array_sort(F.concat(*[F.transform(b[k], lambda s: F.struct(s["at"].alias("at"), s["until"].alias("until"))) for k in KINDS]))


class Scorer:
    """Boosted trees as a SQL expression, with a threshold for each kind."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, values: dict[str, Column]) -> Column:
        """Probability that a candidate is personal data."""

        def grow(node) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            feature, threshold, low, high = node
            return F.when(values[FEATURES[feature]] <= threshold, grow(low)).otherwise(grow(high))

        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(weight) * grow(root)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))


def _nodes(node) -> tuple:
    """A fitted tree as nested tuples: (value,) or (feature, threshold, low, high)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return (float(node.prediction()),)
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def train(docs: DataFrame) -> Scorer | None:
    """Fit the trees on the values of all documents and calibrate a threshold for each kind.

    Candidates of equal features count as one example of their number's weight, so what is kept, fitted and
    calibrated on is a table of different feature vectors; it is fitted in one sorted partition, as
    sums in another order could settle ties between features otherwise.
    """
    rows = examples(docs.select(text_or_empty().alias("text")))
    # all spellings of a value are on one side
    held = (F.pmod(F.xxhash64("root", F.lit(SEED)), F.lit(4)) == 0).alias("held")
    rows = materialise(rows.groupBy(held, "kind", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")), "pii-candidates")
    fit = rows.where("NOT held").groupBy("label", *FEATURES).agg(F.sum("n").alias("n"))
    fit = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(fit.coalesce(1).sortWithinPartitions("label", *FEATURES)).select("x", "label", "n").cache()
    known = fit.agg(F.countDistinct("label"), F.sum("n"), F.count(F.lit(1))).first()
    if known[0] < 2:
        fit.unpersist()
        return None
    # so many bins that their limits come from all vectors: the trees would sample more than the square of the bins
    bins = max(64, int(known[2] ** 0.5) + 1)
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=bins, minWeightFractionPerNode=min(LEAST_EXAMPLES / known[1], 0.49)).fit(fit)
    fit.unpersist()
    trees = [(float(w), _nodes(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    scorer = Scorer(trees, {})
    tests = rows.where("held").select("kind", "label", "n", let(F.struct(*FEATURES), lambda v: scorer.score({k: v[k] for k in FEATURES})).alias("score"))
    # precision at every hundredth; the least threshold that keeps it holds for its kind
    steps = tests.groupBy("kind", F.floor(F.col("score") * 100).alias("step")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    for kind in KINDS:
        best, good, n = None, 0.0, 0
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            good, n = good + r.good, n + r.n
            if good / n >= PRECISION:
                best = r.step / 100
        if best is not None:
            scorer.thresholds[kind] = max(best, LEAST_SCORE)
    return scorer


def scan(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base spans and added spans, as (order, at, kind, until)."""
    text = text_or_empty()
    if scorer is None or not scorer.thresholds:
        found = docs.select("doc_id", base(text).alias("b"), no_spans().alias("c"))
    else:
        found = docs.select("doc_id", text.alias("text"), base(text).alias("b"))
        found = found.select("doc_id", "b", candidates(masked(F.col("text"), _sorted(F.col("b")))).alias("c"))
    order = {k: i for i, k in enumerate(KINDS)}
    own = F.concat(*[tagged(F.col(f"b.{k}"), k, i) for k, i in order.items()])
    found = found.select("doc_id", *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(own).alias("base"), "c")
    added = F.array().cast("array<struct<order:int,at:bigint,kind:string,until:bigint>>")
    if scorer is not None and scorer.thresholds:
        overlap = lambda s, b: (s["at"] < b["until"]) & (b["at"] < s["until"])
        threshold = F.create_map(*[x for k, v in scorer.thresholds.items() for x in (F.lit(k), F.lit(v))])
        # features are computed once for each candidate, not once for each node of a tree
        shaped = F.transform("c", lambda s: F.struct(s["at"].alias("at"), s["until"].alias("until"), _kind(s).alias("kind"), *[v.alias(f"f_{k}") for k, v in features(s).items()]))
        scored = F.transform(shaped, lambda s: F.struct((-scorer.score({k: s[f"f_{k}"] for k in FEATURES})).alias("minus"), s["at"].alias("at"), s["until"].alias("until"), s["kind"].alias("kind")))
        passed = F.filter(scored, lambda s: -s["minus"] >= F.coalesce(threshold[s["kind"]], F.lit(2.0)))
        good = F.array_sort(F.transform(passed, lambda s: F.struct((s["at"] - s["until"]).alias("short"), s["minus"].alias("minus"), s["at"].alias("at"), s["until"].alias("until"), s["kind"].alias("kind"))))
        as_span = lambda s: F.struct(_order(s["kind"], order).alias("order"), s["at"].alias("at"), s["kind"].alias("kind"), s["until"].alias("until"))
        added = F.aggregate(good, added, lambda acc, s: F.when(F.exists(acc, lambda b: overlap(s, b)), acc).otherwise(F.concat(acc, F.array(as_span(s)))))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base", added.alias("added"))


def _order(kind: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for k, i in order.items():
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def redact(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id and text, with every reported span replaced by its kind in brackets."""
    keyed = docs.select("doc_id", text_or_empty().alias("text"))
    spans = scan(docs, scorer).select("doc_id", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["at"].alias("at"), s["until"].alias("until"), s["kind"].alias("kind")))).alias("s")).dropDuplicates(["doc_id"])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["at"] < acc["at"], acc).otherwise(F.struct(s["until"].alias("at"), F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), (s["at"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out")))
    return keyed.join(spans, "doc_id").select("doc_id", F.aggregate("s", start, step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int")))).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all spans)."""
    out = scan(docs, train(docs))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
