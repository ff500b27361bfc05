"""Cleaning in six fixed steps with an audit trail.

No row is deleted except exact duplicates (and key-only duplicates on request).
The DataFrame stays lazy; the actions are small aggregations whose results
(fill values, fences, counters) have a size fixed by the number of columns.

By default the flag columns always exist, so the schema does not depend on the
data; ``conditional_columns=True`` drops those that would be false everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import session
from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg
from ledgerlens.operators import duplicates
from ledgerlens.operators.quantiles import quantile_values
from ledgerlens.operators.spread import spreads
from ledgerlens.roles import Roles

NUMERIC_ROLES = (
    "client_id", "credit_limit", "age", "bill_amount", "payment_amount", "payment_status", "target",
    "sex", "education", "marriage",
)

REPORT_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("rows_removed", T.LongType()),
    T.StructField("affected_rows", T.LongType()),
    T.StructField("columns_added", T.ArrayType(T.StringType())),
    T.StructField("columns_modified", T.ArrayType(T.StringType())),
    T.StructField("action_taken", T.BooleanType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])

RATIONALE = {
    "convert_dtypes": "Text that should be numeric is parsed; what cannot be parsed becomes null, no row is lost.",
    "remove_duplicates": "Exact copies add nothing. Rows equal but for the key may be two clients, so they are flagged.",
    "handle_missing_values": "Rows are kept; filled cells carry an indicator so they are never read as observed.",
    "normalise_categoricals": "Codes get labels beside them; undocumented codes share one Unknown label.",
    "handle_invalid_numeric_values": "Implausible values are flagged; an unusable limit becomes null so ratios stay undefined.",
    "flag_extreme_outliers": "Extreme amounts may be real, so they are marked and never capped.",
}


@dataclass
class Step:
    name: str
    rows_before: int
    rows_after: int
    affected_rows: int = 0
    columns_added: list[str] = field(default_factory=list)
    columns_modified: list[str] = field(default_factory=list)
    action_taken: bool = True
    details: dict[str, str] = field(default_factory=dict)


def report_frame(spark, steps: Sequence[Step]) -> DataFrame:
    rows = [
        Row(i, st.name, RATIONALE[st.name], st.rows_before, st.rows_after, st.rows_before - st.rows_after,
            st.affected_rows, st.columns_added, st.columns_modified, st.action_taken,
            {k: str(x) for k, x in st.details.items()})
        for i, st in enumerate(steps, start=1)
    ]
    return spark.createDataFrame(rows, REPORT_SCHEMA)


# ------------------------------------------------------------------ 1. types

def text_columns(df: DataFrame) -> list[str]:
    """Columns that a role expects to be numeric and that hold something else."""
    roles = Roles.of(df)
    wanted = [c for role in NUMERIC_ROLES for c in roles.all(role)]
    return [c for c in dict.fromkeys(wanted) if not s.is_numeric(df.schema[c].dataType)]


def convert_types(df: DataFrame) -> DataFrame:
    columns = text_columns(df)
    return s.project(df, {c: s.parse_number(s.name(c)) for c in columns}) if columns else df


def conversion_losses(df: DataFrame) -> dict[str, str]:
    """For each text column, the count of the values that conversion would make missing."""
    return {c: f"count_if({s.name(c)} IS NOT NULL AND {s.parse_number(s.name(c))} IS NULL)" for c in text_columns(df)}


def conversion_counts(df: DataFrame) -> dict[str, int]:
    """Values each text column would lose by conversion (one aggregation)."""
    lost = conversion_losses(df)
    return agg(df, lost).first().asDict() if lost else {}


def missing_after_conversion(df: DataFrame) -> dict[str, str]:
    texts = set(text_columns(df))
    return {c: f"({s.parse_number(s.name(c))} IS NULL)" if c in texts else s.is_missing(df, c) for c in df.columns}


# ------------------------------------------------------------ 3. imputation

def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    counts = agg(df, {"__rows": "count(*)", **{c: f"count_if({s.is_missing(df, c)})" for c in df.columns}}).first().asDict()
    return counts.pop("__rows"), counts


def mode_value(df: DataFrame, name: str):
    """Most frequent value; ties go to the smallest."""
    top = df.filter(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), F.asc(name)).limit(1)
    row = top.first()
    return row[0] if row else None


def fill_values(df: DataFrame, columns: Sequence[str], numeric: str = "median", categorical: str = "unknown") -> dict:
    """Fill value per column with nulls, by strategy; ``None`` means leave."""
    numbers = [c for c in columns if s.is_numeric(df.schema[c].dataType)]
    out: dict = {c: None for c in columns}
    if numeric == "median" and numbers:
        out.update({c: q.get(0.5) for c, q in quantile_values(df, numbers, (0.5,)).items()})
    elif numeric == "mean" and numbers:
        out.update(agg(df, {c: f"avg({s.value(df, c)})" for c in numbers}).first().asDict())
    elif numeric == "zero":
        out.update({c: 0.0 for c in numbers})
    for c in columns:
        if c not in numbers:
            if categorical == "mode":
                out[c] = mode_value(df, c) or v.UNKNOWN
            elif categorical == "unknown":
                out[c] = v.UNKNOWN
    return out


def impute(df: DataFrame, fills: dict, indicators: bool = True) -> DataFrame:
    """Filled values and their indicator columns, in one projection."""
    added = {}
    for c, fill in fills.items():
        if indicators:
            added[f"{c}_was_missing"] = s.is_missing(df, c)
        if fill is None:
            continue
        if s.is_numeric(df.schema[c].dataType):
            added[c] = f"coalesce({s.value(df, c)}, {s.number(fill)})"
        else:
            added[c] = f"coalesce(CAST({s.name(c)} AS STRING), {s.text(fill)})"
    return s.project(df, added) if added else df


# ---------------------------------------------------------------- 4. labels

def label_codes(df: DataFrame) -> DataFrame:
    """Adds a label and an ordinal next to every code column; codes are kept."""
    added = {}
    for code, (label, names, _) in v.CODED_COLUMNS.items():
        if code in df.columns:
            x = s.value(df, code)
            places = " ".join(f"WHEN {x} = {k} THEN {i}" for i, k in enumerate(sorted(names)))
            added[label] = s.label_of(x, names, v.UNKNOWN)
            added[f"{label}_ord"] = f"CASE {places} ELSE {len(names)} END"
    return s.project(df, added) if added else df


def undocumented(df: DataFrame, code: str) -> str:
    documented = ", ".join(str(k) for k in v.CODED_COLUMNS[code][1])
    return f"({s.value(df, code)} IS NOT NULL AND {s.value(df, code)} NOT IN ({documented}))"


# ------------------------------------------------- 5. ranges and 6. extremes

def range_flags(df: DataFrame) -> dict[str, str]:
    roles, flags = Roles.of(df), {}
    low, high = v.AGE_RANGE
    if roles.has("age"):
        age = s.value(df, roles.one("age"))
        flags["age_is_implausible"] = f"coalesce({age} < {low} OR {age} > {high}, false)"
    if roles.has("bill_amount"):
        flags["has_negative_balance"] = s.row_any(f"{s.value(df, c)} < 0" for c in roles.all("bill_amount"))
    return flags


def neutralise_limit(df: DataFrame) -> DataFrame:
    """A limit of zero or less becomes null; the original value stays beside it."""
    limit = Roles.of(df).one("credit_limit")
    if limit is None:
        return df
    x = s.value(df, limit)
    return s.project(df, {f"{limit}_original": x, limit: f"IF({x} > 0, {x}, NULL)"})


def money_columns(df: DataFrame) -> list[str]:
    roles = Roles.of(df)
    return [c for role in ("credit_limit", "bill_amount", "payment_amount") for c in roles.all(role)]


def extreme_fences(df: DataFrame, columns: Sequence[str] | None = None, k: float = v.EXTREME_FENCE) -> dict:
    """(low, high) per column with a positive IQR and more than two distinct values."""
    columns = money_columns(df) if columns is None else [c for c in columns if c in df.columns]
    return {c: sp.fence(k) for c, sp in spreads(df, columns).items() if sp.more_than_two and sp.iqr > 0}


def outside(df: DataFrame, column: str, fence: tuple[float, float]) -> str:
    x = s.value(df, column)
    return f"coalesce({x} < {s.number(fence[0])} OR {x} > {s.number(fence[1])}, false)"


# ------------------------------------------------------------ orchestration

def clean(df: DataFrame, drop_exact: bool = True, drop_without_id: bool = False, numeric: str = "median",
          categorical: str = "unknown", indicators: bool = True,
          conditional_columns: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cleaned, report): types, duplicates, nulls, labels, ranges, extremes - in this order."""
    spark, steps = df.sparkSession, []
    converted = {f"lost:{c}": e for c, e in conversion_losses(df).items()}
    typed = convert_types(df)
    # one scan says what conversion loses and what is missing, one narrow grouping says which rows repeat
    raw = agg(df, {"rows": "count(*)", **converted, **{f"null:{c}": f"count_if({missing})" for c, missing in missing_after_conversion(df).items()}}).first().asDict()
    original_rows, lost = raw["rows"], {c.removeprefix("lost:"): n for c, n in raw.items() if c.startswith("lost:")}
    nulls = {c.removeprefix("null:"): n for c, n in raw.items() if c.startswith("null:")}
    repeats = duplicates.duplicate_counts(typed).first()
    steps.append(Step("convert_dtypes", original_rows, original_rows, sum(lost.values()), [], list(lost), bool(lost),
                      {"values_made_missing": sum(lost.values())}))

    has_id = v.ID in df.columns and len(df.columns) > 1
    removed, added, dropped = repeats["exact_duplicates"] if drop_exact else 0, [], 0
    working, rows = (duplicates.drop_exact(typed), original_rows - removed) if removed else (typed, original_rows)
    working = session.reuse(working)
    if removed:
        rows, nulls = missing_counts(working)
    flagged = repeats["duplicates_without_id"] - removed if has_id else 0
    if has_id:
        if drop_without_id and flagged:
            working, dropped = session.reuse(duplicates.drop_ignoring_key(working)), flagged
            rows, nulls = missing_counts(working)
        elif flagged:
            working, added = duplicates.flag_ignoring_key(working), ["is_duplicate_excluding_id"]
        elif not conditional_columns:
            working = working.withColumn("is_duplicate_excluding_id", F.lit(False))
    steps.append(Step("remove_duplicates", original_rows, rows, removed + dropped + flagged, added, [],
                      bool(removed or dropped or flagged),
                      {"exact_removed": removed, "without_id_removed": dropped,
                       "without_id_flagged": 0 if drop_without_id else flagged}))

    gaps = {c: n for c, n in nulls.items() if 0 < n and c != v.ID}
    partial = [c for c, n in gaps.items() if n < rows]
    fills = fill_values(working, partial, numeric, categorical) if partial else {}
    working = impute(working, fills, indicators) if fills else working
    steps.append(Step("handle_missing_values", rows, rows, sum(gaps.values()),
                      [f"{c}_was_missing" for c in fills] if indicators else [],
                      [c for c, x in fills.items() if x is not None], bool(gaps),
                      {**{c: f"{gaps[c]} missing, filled with {x}" if x is not None else f"{gaps[c]} missing, left"
                          for c, x in fills.items()},
                       **{c: f"{gaps[c]} missing, column is empty" for c in gaps if c not in fills}}))

    coded = [c for c in v.CODED_COLUMNS if c in working.columns]
    limit = Roles.of(working).one("credit_limit")
    working = neutralise_limit(label_codes(working))
    flags = range_flags(working)
    fences = extreme_fences(working)
    flags["has_extreme_value"] = s.row_any(outside(working, c, f) for c, f in fences.items()) if fences else "false"
    working = s.project(working, flags)

    bills = Roles.of(working).all("bill_amount")
    counters = {
        **{f"unknown:{c}": f"count_if({undocumented(working, c)})" for c in coded},
        **{f"flag:{n}": f"count_if({s.name(n)})" for n in flags},
        **{f"extreme:{c}": f"count_if({outside(working, c, f)})" for c, f in fences.items()},
        **{f"negative:{c}": f"count_if({s.value(working, c)} < 0)" for c in bills},
    }
    if limit:
        counters["limit"] = f"count_if({s.name(limit + '_original')} <= 0)"
    counted = agg(working, counters).first().asDict()

    labels = [v.CODED_COLUMNS[c][0] for c in coded]
    steps.append(Step("normalise_categoricals", rows, rows, sum(counted[f"unknown:{c}"] for c in coded), labels, [],
                      bool(labels), {c: counted[f"unknown:{c}"] for c in coded}))
    implausible, negative = counted.get("flag:age_is_implausible", 0), counted.get("flag:has_negative_balance", 0)
    bad_limits, extreme = counted.get("limit", 0), counted["flag:has_extreme_value"]
    used = [n for n, c in (("age_is_implausible", implausible), (f"{limit}_original", bad_limits),
                           ("has_negative_balance", negative)) if c]
    steps.append(Step("handle_invalid_numeric_values", rows, rows, implausible + bad_limits, used,
                      [limit] if bad_limits else [], bool(used),
                      {"implausible_ages": implausible, "non_positive_limits": bad_limits,
                       "clients_with_negative_balance": negative,
                       "negative_cells": sum(counted[f"negative:{c}"] for c in bills)}))
    steps.append(Step("flag_extreme_outliers", rows, rows, extreme, ["has_extreme_value"] if extreme else [], [],
                      bool(extreme), {c: counted[f"extreme:{c}"] for c in fences if counted[f"extreme:{c}"]}))
    if conditional_columns:
        unused = {"age_is_implausible": implausible, f"{limit}_original": bad_limits,
                  "has_negative_balance": negative, "has_extreme_value": extreme}
        working = working.drop(*[name for name, count in unused.items() if not count])
    return working, report_frame(spark, steps)
