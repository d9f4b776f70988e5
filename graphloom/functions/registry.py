"""Registered functions, and tables of functions.

A function is described by its inputs and output, so that routes can use it; it works on columns.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    call: Callable[..., Column]
    inputs: list[str]
    output: str
    cost: float | None = None
    input_units: list[str | None] | None = None
    output_unit: str | None = None


class Registry:
    """Functions by IRI. Modules are only imported if they are on the allow-list; nothing is installed."""

    def __init__(self, allowed_modules: tuple[str, ...] = ()):
        self.allowed, self.entries = allowed_modules, {}

    def add(self, iri: str, call: Callable[..., Column], inputs: list[str], output: str, cost: float | None = None, input_units: list[str | None] | None = None, output_unit: str | None = None) -> str:
        """Register a function on columns; units say in which unit it takes its inputs and gives its output (None: as a plain number)."""
        self.entries[iri] = Entry(call, list(inputs), output, cost, input_units, output_unit)
        return iri

    def add_from(self, iri: str, module: str, name: str, inputs: list[str], output: str, cost: float | None = None) -> str:
        if module not in self.allowed:
            raise PermissionError(f"{module} is not on the list of allowed modules")
        return self.add(iri, getattr(importlib.import_module(module), name), inputs, output, cost)

    def described(self, spark: SparkSession) -> DataFrame:
        """function, inputs, output and cost, as the route search takes them."""
        rows = [(k, e.inputs, e.output, e.cost) for k, e in self.entries.items()]
        return spark.createDataFrame(rows, "function string, inputs array<string>, output string, cost double")

    def evaluate(self, route: list[str], values: dict[str, Column]) -> Column:
        """The column that a route computes from columns of its sources; one plan, no data on the driver."""
        steps = list(route)

        def take() -> Column:
            kind, name = steps.pop(0).split(" ", 1)
            if kind == "value":
                return values[name]
            if kind == "function":
                entry = self.entries[name]
                return entry.call(*[take() for _ in entry.inputs])
            return take()

        return take()


def interpolate(x: Column, xs: list[float], ys: list[float], left: float | None = None, right: float | None = None, period: float | None = None) -> Column:
    """Piecewise-linear interpolation between breakpoints, as one expression.

    Outside, the end values hold, or ``left`` and ``right``; with a ``period`` x is taken modulo it and
    the ends meet. The breakpoints are an array literal, searched by position.
    """
    points = sorted(zip([v % period for v in xs] if period else xs, ys, strict=True))
    if period:
        points = [(points[-1][0] - period, points[-1][1]), *points, (points[0][0] + period, points[0][1])]
        x = F.pmod(x, F.lit(float(period)))
    table = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in points])
    n = F.size(F.filter(table, lambda p: p["x"] <= x))
    low, high = F.get(table, n - 1), F.get(table, n)
    inner = low["y"] + (high["y"] - low["y"]) * (x - low["x"]) / (high["x"] - low["x"])
    first, last = points[0], points[-1]
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
        .when(x < first[0], F.lit(float(first[1] if left is None else left)))
        .when(x == last[0], F.lit(float(last[1])))
        .when(x > last[0], F.lit(float(last[1] if right is None else right)))
        .otherwise(inner)
    )
