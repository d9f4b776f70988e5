"""Search by type and criteria, as a chain of semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.names import PREFIXES
from graphloom.operators.solutions import everything, with_predicate

TYPE = PREFIXES["rdf"] + "type"


def search(triples, type=None, criteria: dict | None = None, regex: dict | None = None, flags: str = "", skip_blanks: bool = True, name=lambda key: key) -> DataFrame:
    """Distinct subjects (column s) that meet all conditions.

    ``type``: one or several types, all of which must hold. ``criteria``: key to value; a key with
    dots follows a path, a list value asks for each of its members independently, ``@id`` fixes
    the subject. ``regex``: key to a pattern for the value's lexical form, with ``flags`` out of ``i``,
    ``m``, ``s``, ``q``. ``name`` turns a key's parts into predicates. Literals are compared by lexical form,
    resources by term. Every condition reads one predicate's part of the triples.
    """
    conditions, fixed = [], None
    for t in [type] if isinstance(type, str) else type or []:
        conditions.append(with_predicate(triples, TYPE).where(F.col("o") == t).select("s"))
    for source, is_pattern in ((criteria or {}, False), (regex or {}, True)):
        for key, wish in source.items():
            if key == "@id":
                rule = F.col("s").rlike(_flagged(wish, flags)) if is_pattern else F.col("s") == wish
                fixed = rule if fixed is None else fixed & rule
                continue
            for one in wish if isinstance(wish, (list, tuple)) else [wish]:
                conditions.append(_holders(triples, [name(k) for k in key.split(".")] if "://" not in key else [key], one, is_pattern, flags))
    # the first condition's subjects are narrowed by the others; only without any are all subjects read
    out = conditions[0] if conditions else everything(triples).select("s")
    if fixed is not None:
        out = out.where(fixed)
    if skip_blanks:
        out = out.where(~F.col("s").startswith("_:"))
    out = out.distinct()
    for other in conditions[1:]:
        out = out.join(other, "s", "left_semi")
    return out


def _flagged(pattern: str, flags: str) -> str:
    if "q" in flags:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    inline = "".join(f for f in flags if f in "ims")
    return f"(?{inline}){pattern}" if inline else pattern


def _holders(triples, path: list[str], wish, is_pattern: bool, flags: str) -> DataFrame:
    """Subjects from which a path of predicates leads to a wished value; built from the value back."""
    last = with_predicate(triples, path[-1])
    if wish is not None:
        last = last.where(_matches(F.col("o"), wish, is_pattern, flags))
    found = last.select("s")
    for p in reversed(path[:-1]):
        step = with_predicate(triples, p)
        found = step.join(found.select(F.col("s").alias("o")), "o", "left_semi").select("s")
    return found


def _matches(o: Column, wish, is_pattern: bool, flags: str) -> Column:
    if is_pattern:
        return terms.lexical(o).rlike(_flagged(wish, flags))
    if isinstance(wish, bool):
        return terms.boolean(o) == wish
    if isinstance(wish, (int, float)):
        return terms.number(o) == float(wish)
    if wish.startswith('"') or "://" in wish or wish.startswith("_:"):
        return o == wish
    quoted = terms.term('"' + wish.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"')
    # the literal itself, or with a language or a datatype behind it
    return (o == quoted) | o.startswith(quoted + "@") | o.startswith(quoted + "^^")
