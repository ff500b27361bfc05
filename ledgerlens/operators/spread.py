"""Quartiles, extremes and fences of numeric columns; the literals other operators plug in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlens.functions.scalars import number, value
from ledgerlens.functions.tables import agg
from ledgerlens.operators.quantiles import quantile_values


@dataclass(frozen=True)
class Spread:
    least: float
    q1: float
    median: float
    q3: float
    most: float
    more_than_two: bool  # at least three distinct values

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    def fence(self, k: float) -> tuple[float, float]:
        return self.q1 - k * self.iqr, self.q3 + k * self.iqr


def spreads(df: DataFrame, columns: Sequence[str]) -> dict[str, Spread]:
    """Spread per column that has any finite value: one quantile pass and one counting pass.

    "More than two distinct values" is decided exactly by counting the values
    that are neither the smallest nor the largest, so no distinct set is built.
    """
    q = quantile_values(df, columns, (0.0, 0.25, 0.5, 0.75, 1.0))
    present = [c for c in columns if q[c]]
    if not present:
        return {}
    strictly = {c: f"({value(df, c)} > {number(q[c][0.0])} AND {value(df, c)} < {number(q[c][1.0])})" for c in present}
    between = agg(df, {c: f"count_if({e})" for c, e in strictly.items()}).first()
    return {c: Spread(q[c][0.0], q[c][0.25], q[c][0.5], q[c][0.75], q[c][1.0], between[c] > 0) for c in present}
