"""Multi-valued properties as arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(a: Column, b: Column) -> Column:
    """Ordered union of two arrays; NULL counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))


def add(values: Column, value: Column) -> Column:
    """Values with one more, distinct and sorted; a NULL value changes nothing."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(values, empty), F.when(value.isNotNull(), F.array(value)).otherwise(empty))))


def get(properties: Column, key: str, default: str | None = None) -> Column:
    """A property's values as an array, or an array of the default, or an empty one."""
    fallback = F.array(F.lit(default)) if default is not None else F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(properties, F.lit(key)), fallback)


def update(a: Column, b: Column, append: bool = True) -> Column:
    """Two maps of arrays as one: values of shared keys are united, or replaced by the second's."""
    empty = F.array().cast("array<string>")
    if append:
        return F.map_zip_with(a, b, lambda k, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def label(properties: Column, iri: Column, keys: tuple[str, ...]) -> Column:
    """The first value of the first key that has one, else the IRI's local name."""
    from graphloom.functions.names import iri_name

    found = [F.get(F.try_element_at(properties, F.lit(k)), 0) for k in keys]
    return F.coalesce(*found, iri_name(iri))
