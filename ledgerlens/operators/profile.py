"""Structure of a table: contract checks, null and distinct counts, column catalogue."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, side_by_side, unpivot
from ledgerlens.operators.duplicates import duplicate_counts
from ledgerlens.operators.features import DEFINITIONS
from ledgerlens.roles import Roles, describe

CHECK_SCHEMA = "check string, level string, passed boolean, affected long, message string"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "numeric" if s.is_numeric(dtype) else "categorical"


def validate(df: DataFrame, strict: bool = False, expected_rows: int = v.EXPECTED_ROWS,
             expected_columns: int = v.EXPECTED_COLUMNS) -> DataFrame:
    """Contract checks, one row each; ``level`` is error or warning (all errors when strict).

    One aggregation covers the value checks; uniqueness of the key is a grouped count.
    """
    names = df.columns
    probes = {"rows": "count(*)"}
    if v.TARGET in names:
        y = s.value(df, v.TARGET)
        raw = s.name(v.TARGET)
        probes["not_binary"] = f"count_if({raw} IS NOT NULL AND coalesce({y} NOT IN (0, 1), true))"
        probes["classes"] = f"IF(min({raw}) < max({raw}), 2, 1)"
    if "age" in names:
        low, high = v.AGE_RANGE
        probes["bad_age"] = f"count_if({s.value(df, 'age')} < {low} OR {s.value(df, 'age')} > {high})"
    if "credit_limit" in names:
        probes["bad_limit"] = f"count_if({s.value(df, 'credit_limit')} <= 0)"
    parts = [agg(df, probes)]
    if v.ID in names:
        ids = agg(df, {"n": "count(*)"}, [v.ID])
        parts.append(agg(ids, {"repeated": "coalesce(sum(n - 1), 0L)"}))
    row = side_by_side(*parts)

    checks: list[dict[str, str]] = []

    def check(name: str, level: str, passed: str, message: str, affected: str = "0L") -> None:
        checks.append({"check": s.text(name), "level": s.text("error" if strict else level), "passed": passed,
                       "affected": f"bigint({affected})", "message": s.text(message)})

    repeated = [n for n, k in Counter(names).items() if k > 1]
    check("has_rows", "error", "rows > 0", "The table has no rows.")
    check("has_columns", "error", str(bool(names)).lower(), "The table has no columns.")
    check("column_names_unique", "error", str(not repeated).lower(), f"Repeated column names: {', '.join(repeated)}")
    check("row_count", "warning", f"rows IN (0, {expected_rows})", "The row count differs from the full file.", "rows")
    check("column_count", "warning", str(len(names) == expected_columns).lower(),
          f"{len(names)} columns, {expected_columns} expected.", str(len(names)))
    check("target_present", "error", str(v.TARGET in names).lower(), f"Column {v.TARGET} is missing.")
    if v.TARGET in names:
        check("target_binary", "error", "not_binary = 0", "The outcome holds values other than 0 and 1.", "not_binary")
        check("target_two_classes", "warning", "classes = 2", "The outcome has fewer than two classes.")
    if v.ID in names:
        check("id_unique", "warning", "repeated = 0", "The key repeats.", "repeated")
    else:
        check("id_present", "warning", "false", f"There is no {v.ID} column.")
    for c in ("credit_limit", "age"):
        check(f"{c}_present", "warning", str(c in names).lower(), f"Column {c} is missing.")
    for prefix in ("bill_amt_m", "pay_amt_m", "pay_status_m"):
        found = sum(n.startswith(prefix) for n in names)
        check(f"{prefix}_complete", "warning", str(found >= v.PANEL_MONTHS).lower(),
              f"{found} of {v.PANEL_MONTHS} months of {prefix}* are present.", str(found))
    if "age" in names:
        check("age_plausible", "warning", "bad_age = 0", "Ages outside 18-100.", "bad_age")
    if "credit_limit" in names:
        check("limit_positive", "warning", "bad_limit = 0", "Credit limits of zero or less.", "bad_limit")
    return unpivot(row, checks)


def is_valid(checks: DataFrame) -> bool:
    return checks.filter("level = 'error' AND NOT passed").limit(1).count() == 0


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, distinct_values), nulls not counted.

    Exact counts come from one grouped pass over (column, value) pairs, which is
    spread over all values; the approximate ones need no shuffle of values.
    """
    if approximate:
        row = agg(df, {c: f"approx_count_distinct({s.name(c)})" for c in df.columns})
        return unpivot(row, [{"column": s.text(c), "distinct_values": s.name(c)} for c in df.columns])
    cells = unpivot(df, [{"column": s.text(c), "value": f"CAST({s.name(c)} AS STRING)"} for c in df.columns])
    pairs = cells.filter("value IS NOT NULL").distinct()
    counts = agg(pairs, {"distinct_values": "count(*)"}, ["column"])
    names = df.sparkSession.createDataFrame([Row(c) for c in df.columns], "column string")
    return names.join(F.broadcast(counts), "column", "left").selectExpr("column", "coalesce(distinct_values, 0L) AS distinct_values")


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: kind, missing count and share, distinct values, constant and empty flags."""
    nulls = agg(df, {"__rows": "count(*)", **{c: f"count_if({s.is_missing(df, c)})" for c in df.columns}})
    rows = unpivot(nulls, [
        {"column": s.text(f.name), "kind": s.text(kind_of(f.dataType)), "n_rows": "__rows", "missing": s.name(f.name)}
        for f in df.schema.fields
    ])
    return rows.join(F.broadcast(distinct_counts(df, approximate)), "column").selectExpr(
        "column", "kind", "n_rows", "missing", f"{s.divide('missing', 'n_rows')} * 100 AS missing_pct", "distinct_values",
        "distinct_values = 1 AND n_rows > 1 AS is_constant", "n_rows > 0 AND missing = n_rows AS is_empty",
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: shape, columns per kind, missing cells and duplicates."""
    kinds = Counter(kind_of(f.dataType) for f in df.schema.fields)
    nulls = agg(df, {"missing_cells": s.plus(f"count_if({s.is_missing(df, c)})" for c in df.columns)})
    return side_by_side(nulls, duplicate_counts(df)).selectExpr(
        "rows AS n_rows", f"{len(df.columns)} AS n_columns", f"{kinds['numeric']} AS numeric_columns",
        f"{kinds['categorical']} AS categorical_columns", f"{kinds['datetime']} AS datetime_columns",
        f"{kinds['boolean']} AS boolean_columns", "missing_cells", f"rows * {len(df.columns)} AS total_cells",
        "exact_duplicates", "duplicates_without_id",
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and share per column, with the table total on every row."""
    nulls = agg(df, {"__rows": "count(*)", **{c: f"count_if({s.is_missing(df, c)})" for c in df.columns}})
    total = s.plus(s.name(c) for c in df.columns)
    rows = unpivot(nulls.selectExpr("*", f"{total} AS __total"), [
        {"column": s.text(c), "missing": s.name(c), "n_rows": "__rows", "missing_cells": "__total"} for c in df.columns
    ])
    return rows.selectExpr(
        "column", "missing", f"coalesce({s.divide('missing', 'n_rows')}, 0D) * 100 AS missing_pct",
        "n_rows > 0 AND missing = n_rows AS fully_missing", "missing_cells", f"n_rows * {len(df.columns)} AS total_cells",
    )


def column_catalogue(df: DataFrame, key: str = v.ID) -> DataFrame:
    """Type, distinct and missing counts, an example value and the meaning of every column."""
    order = s.name(key) if key in df.columns else "0"
    examples = agg(df, {c: f"CAST(min_by({s.name(c)}, IF({s.name(c)} IS NOT NULL, {order}, NULL)) AS STRING)" for c in df.columns})
    roles = Roles.of(df)
    raw = {c for names in roles.found.values() for c in names}

    def meaning(c: str) -> str:
        if c in DEFINITIONS:
            return DEFINITIONS[c][1]
        return describe(c)

    facts = [
        {"column": s.text(c), "example": s.name(c), "meaning": s.text(meaning(c)),
         "origin": s.text("engineered" if c in DEFINITIONS else "source" if c in raw and not c.endswith("_ord") else "derived"),
         "ml_safe": str(bool(DEFINITIONS.get(c, (0, 0, 0, False))[3])).lower()}
        for c in df.columns
    ]
    return column_profile(df).join(F.broadcast(unpivot(examples, facts)), "column").select(
        "column", "kind", "origin", "distinct_values", "missing", "missing_pct", "example", "meaning", "ml_safe"
    )
