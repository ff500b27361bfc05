"""Row-level expressions, written as Spark SQL text.

Text keeps the plan cheap to build (one parse per projection instead of one
gateway call per operator) and uses only built-in, code-generated functions:
no UDF and no lambda over arrays.  Arguments and results are SQL expressions;
``name(c)`` quotes a column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.vocabulary import MODERATE, STRONG, WEAK

NUMERIC_TEXT = r"^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    if value in (float("inf"), float("-inf")):
        return f"double('{'-' if value < 0 else ''}Infinity')"
    return f"double('{float(value)!r}')"


def project(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """Adds or replaces columns in one projection."""
    kept = [f"{added[c]} AS {name(c)}" if c in added else name(c) for c in df.columns]
    new = [f"{e} AS {name(c)}" for c, e in added.items() if c not in df.columns]
    return df.selectExpr(*kept, *new)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def finite(x: str) -> str:
    """As double; NaN (which sorts above infinity) and both infinities become null."""
    return f"IF(abs({x}) < double('Infinity'), double({x}), NULL)"


def parse_number(x: str) -> str:
    """Text to double; text that is not a plain number becomes null."""
    as_text = f"CAST({x} AS STRING)"
    return f"IF({as_text} RLIKE '{NUMERIC_TEXT}', {finite(f'try_cast(trim({as_text}) AS DOUBLE)')}, NULL)"


def value(df: DataFrame, column: str) -> str:
    """The column as a finite double, checking no more than its type requires."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(name(column))
    if isinstance(dtype, T.StringType):
        return parse_number(name(column))
    return f"double({name(column)})"


def plain(column: str) -> str:
    """The column as double, for values already known to be finite."""
    return f"double({name(column)})"


def is_missing(df: DataFrame, column: str) -> str:
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return f"({name(column)} IS NULL OR isnan({name(column)}))"
    return f"({name(column)} IS NULL)"


def divide(numerator: str, denominator: str, positive_only: bool = False, invalid: Iterable[float] = ()) -> str:
    """Quotient, or null when the denominator is null, zero, listed as invalid or not allowed."""
    usable = f"({denominator}) > 0" if positive_only else f"({denominator}) <> 0"
    for x in invalid:
        if x != 0:
            usable += f" AND ({denominator}) <> {number(x)}"
    return f"IF({usable}, {finite(f'(({numerator}) / ({denominator}))')}, NULL)"


def plus(parts: Iterable[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def non_null(xs: list[str]) -> str:
    """How many of the values are present."""
    return plus(f"int({x} IS NOT NULL)" for x in xs)


def row_sum(xs: list[str]) -> str:
    """Sum of the present values; 0 when there are none."""
    return plus(f"coalesce({x}, 0D)" for x in xs)


def row_mean(xs: list[str]) -> str:
    return f"IF({non_null(xs)} > 0, {row_sum(xs)} / {non_null(xs)}, NULL)"


def row_std(xs: list[str], mean: str) -> str:
    """Population standard deviation of the present values."""
    squares = plus(f"coalesce(({x} - {mean}) * ({x} - {mean}), 0D)" for x in xs)
    return f"IF({non_null(xs)} > 0, sqrt({squares} / {non_null(xs)}), NULL)"


def row_max(xs: list[str]) -> str:
    return f"greatest({', '.join(xs)})" if len(xs) > 1 else xs[0]


def row_any(conditions: Iterable[str]) -> str:
    """True when any condition holds; a null condition counts as false."""
    return "(" + " OR ".join(f"coalesce({c}, false)" for c in conditions) + ")"


def row_count_if(conditions: Iterable[str]) -> str:
    return plus(f"int(coalesce({c}, false))" for c in conditions)


def row_median(xs: list[str]) -> str:
    """Median of the present values; ``sort_array`` puts nulls first, so values fill the tail."""
    ordered, n = f"sort_array(array({', '.join(xs)}))", non_null(xs)
    at = lambda shift: f"get({ordered}, {len(xs)} - {n} + int(({n} - {shift}) div 2))"
    return f"IF({n} > 0, ({at(1)} + {at(0)}) / 2D, NULL)"


def row_slope(xs: list[str]) -> str:
    """Least-squares slope against positions 1..n of the present values, in the order given."""
    present = [(i, f"int({x} IS NOT NULL)") for i, x in enumerate(xs, start=1)]
    n = plus(k for _, k in present)
    sx = plus(f"{i} * {k}" for i, k in present)
    sxx = plus(f"{i * i} * {k}" for i, k in present)
    sxy = plus(f"coalesce(({i} - {sx} / double({n})) * {x}, 0D)" for i, x in enumerate(xs, start=1))
    return f"IF({n} >= 2, {sxy} / ({sxx} - {sx} * {sx} / double({n})), NULL)"


def clip(x: str, low: float, high: float) -> str:
    return f"IF({x} IS NULL, NULL, least(greatest({x}, {number(low)}), {number(high)}))"


def label_of(code: str, labels: dict[int, str], default: str | None = None) -> str:
    """Label of a code; the default covers unknown and null codes."""
    arms = " ".join(f"WHEN {code} = {k} THEN {text(x)}" for k, x in labels.items())
    return f"CASE {arms} ELSE {text(default)} END"


def band(inside: list[tuple[str, str]]) -> tuple[str, str]:
    """(label, ordinal) for ordered (label, condition) pairs; null outside all of them."""
    labels = " ".join(f"WHEN {c} THEN {text(n)}" for n, c in inside)
    places = " ".join(f"WHEN {c} THEN {i}" for i, (_, c) in enumerate(inside))
    return f"CASE {labels} END", f"CASE {places} END"


def right_closed(x: str, bands, lowest_included: bool = False) -> tuple[str, str]:
    """Bands ``(low, high]``, optionally with the very first edge included."""
    inside = []
    for i, (label, low, high) in enumerate(bands):
        above = ">=" if lowest_included and i == 0 else ">"
        inside.append((label, f"({x} {above} {number(low)} AND {x} <= {number(high)})"))
    return band(inside)


def strength(effect: str) -> str:
    """Word for the size of an association."""
    return (f"CASE WHEN abs({effect}) >= {STRONG} THEN 'strong' WHEN abs({effect}) >= {MODERATE} THEN 'moderate' "
            f"WHEN abs({effect}) >= {WEAK} THEN 'weak' ELSE 'negligible' END")
