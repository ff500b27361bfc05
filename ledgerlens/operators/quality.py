"""Data quality: validity, consistency, outliers, the score and the issue list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, side_by_side, unpivot
from ledgerlens.operators import eda, profile
from ledgerlens.operators.duplicates import duplicate_counts
from ledgerlens.operators.quantiles import melt
from ledgerlens.operators.spread import spreads
from ledgerlens.roles import Roles, month_label
from ledgerlens.settings import DEFAULTS

SEVERITIES = ("high", "medium", "low", "info")
ISSUE_SCHEMA = "check string, severity string, column string, affected_rows long, records long"


# ---------------------------------------------------------------- validity

def code_rules(df: DataFrame) -> list[tuple[str, dict[int, str], tuple[int, ...]]]:
    """(column, documented codes, known undocumented codes) for the numeric coded columns present."""
    rules = []
    for code, (_, labels, known) in v.CODED_COLUMNS.items():
        if code in df.columns and s.is_numeric(df.schema[code].dataType):
            rules.append((code, labels, known))
    for c in Roles.of(df).all("payment_status"):
        if s.is_numeric(df.schema[c].dataType):
            rules.append((c, v.PAY_STATUS_LABELS, v.PAY_STATUS_UNDOCUMENTED))
    return rules


def code_counts(df: DataFrame) -> DataFrame:
    """(column, code, n, kind): documented, undocumented (known to occur) or unknown."""
    rules = code_rules(df)
    cells = unpivot(df, [{"column": s.text(c), "code": f"int({s.value(df, c)})"} for c, _, _ in rules])
    counts = agg(cells.filter("code IS NOT NULL"), {"n": "count(*)"}, ["column", "code"])
    listed = [
        Row(c, int(k), "undocumented" if k in known else "documented")
        for c, labels, known in rules for k in {*labels, *known}
    ]
    codes = df.sparkSession.createDataFrame(listed, "column string, code int, kind string")
    return counts.join(F.broadcast(codes), ["column", "code"], "left").selectExpr(
        "column", "code", "n", "coalesce(kind, 'unknown') AS kind"
    )


def _not_in(df: DataFrame, c: str, codes) -> str:
    return f"(int({s.value(df, c)}) NOT IN ({', '.join(str(k) for k in codes)}))"


def validity_probes(df: DataFrame) -> tuple[dict[str, str], dict[str, str], int]:
    """(counter expressions, invalid-cell expressions, rules): rules x rows cells are checked."""
    roles, probes, invalid = Roles.of(df), {}, {}
    rules = code_rules(df)
    for c, labels, known in rules:
        if c in v.CODED_COLUMNS:
            probes[f"undocumented_category_code:{c}"] = f"count_if(int({s.value(df, c)}) IN ({', '.join(map(str, known))}))" if known else "0L"
            probes[f"unexpected_category_code:{c}"] = f"count_if({_not_in(df, c, [*labels, *known])})"
            invalid[c] = f"count_if({_not_in(df, c, labels)})"
        else:
            probes[f"unexpected_category_code:{c}"] = f"count_if({_not_in(df, c, labels)})"
            invalid[c] = probes[f"unexpected_category_code:{c}"]
    statuses = [c for c, _, _ in rules if c not in v.CODED_COLUMNS]
    if statuses:
        odd = [f"(int({s.value(df, c)}) IN ({', '.join(map(str, v.PAY_STATUS_UNDOCUMENTED))}))" for c in statuses]
        probes["undocumented_status:"] = f"count_if({s.row_any(odd)})"
        probes["undocumented_status_cells:"] = f"coalesce(sum({s.row_count_if(odd)}), 0L)"
    n_rules = len(rules)
    for role, test, name in (
        ("age", "{x} < %d OR {x} > %d" % v.AGE_RANGE, "value_out_of_range"),
        ("credit_limit", "{x} <= 0", "value_out_of_range"),
        ("target", "{x} NOT IN (0, 1)", "invalid_target_value"),
    ):
        c = roles.one(role)
        if c:
            n_rules += 1
            probes[f"{name}:{c}"] = invalid[c] = f"count_if({test.format(x=s.value(df, c))})"
    return probes, invalid, n_rules


# ------------------------------------------------------------- consistency

def contradictions(df: DataFrame) -> dict[str, dict[int, str]]:
    """Check -> month -> row condition, for the two genuine cross-field contradictions."""
    roles = Roles.of(df)
    bills, paid, statuses = (roles.months(r) for r in ("bill_amount", "payment_amount", "payment_status"))
    x = lambda c: s.value(df, c)
    return {
        "status_payment_contradiction": {
            m: f"({x(st)} = -1 AND {x(paid[m])} = 0 AND {x(bills[m + 1])} > 0)"
            for m, st in statuses.items() if m in paid and m + 1 in bills
        },
        "delinquent_without_balance": {
            m: f"({x(st)} >= {v.DELINQUENT_FROM} AND {x(bills[m])} <= 0)" for m, st in statuses.items() if m in bills
        },
    }


def consistency(df: DataFrame) -> DataFrame:
    """(check, severity, rows, records, month counts); a client counts once however many months disagree.

    The row ``any_contradiction`` is what lowers the score.
    """
    roles = Roles.of(df)
    bills, limit = roles.months("bill_amount"), roles.one("credit_limit")
    rules = contradictions(df)
    probes, entries = {"__rows": "count(*)"}, []

    def months_map(name: str, months) -> str:
        return "map(" + ", ".join(f"{s.text(month_label(m))}, {s.name(f'{name}:{m}')}" for m in months) + ")"

    def entry(name: str, severity: str, rows: str, records: str, months: str) -> None:
        entries.append({"check": s.text(name), "severity": s.text(severity), "affected_rows": rows, "records": records,
                        "by_month": months})

    for name, months in rules.items():
        if months:
            probes[name] = f"count_if({s.row_any(months.values())})"
            probes.update({f"{name}:{m}": f"count_if({e})" for m, e in months.items()})
            entry(name, "medium", s.name(name), s.plus(s.name(f"{name}:{m}") for m in months), months_map(name, months))
    no_months = "CAST(map() AS MAP<STRING, BIGINT>)"
    if bills:
        name = "negative_statement_balance"
        probes.update({f"{name}:{m}": f"count_if({s.value(df, c)} < 0)" for m, c in bills.items()})
        counts = [s.name(f"{name}:{m}") for m in bills]
        entry(name, "info", s.row_max(counts), s.plus(counts), months_map(name, bills))
        if limit:
            over = [f"({s.value(df, c)} > {s.value(df, limit)})" for c in bills.values()]
            probes["over_limit_balance"] = f"count_if({s.row_any(over)})"
            entry("over_limit_balance", "info", "over_limit_balance", "over_limit_balance", no_months)
    everything = [e for months in rules.values() for e in months.values()]
    probes["any_contradiction"] = f"count_if({s.row_any(everything)})" if everything else "0L"
    entry("any_contradiction", "info", "any_contradiction", "any_contradiction", no_months)
    return unpivot(agg(df, probes), entries)


# ---------------------------------------------------------------- outliers

def outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = DEFAULTS.iqr_multiplier,
             z: float = 3.0) -> DataFrame:
    """IQR and z-score outliers per column; columns with at most two distinct values are skipped."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if s.is_numeric(f.dataType) and f.name not in (v.ID, v.TARGET)
                   and not f.name.endswith("_ord")]
    found = {c: sp for c, sp in spreads(df, [c for c in columns if c in df.columns]).items() if sp.more_than_two}
    rows = [Row(c, *sp.fence(k)) for c, sp in found.items()]
    fences = df.sparkSession.createDataFrame(rows, "feature string, lower_bound double, upper_bound double")
    long = melt(df, list(found))
    moments = agg(long, {"centre": "avg(value)", "sd": "stddev_pop(value)"}, ["feature"])
    limits = fences.join(moments, "feature")
    skew, _ = eda.bias_corrected("n_valid", "g1", "0D")
    return agg(long.join(F.broadcast(limits), "feature"), {
        "lower_bound": "first(lower_bound)", "upper_bound": "first(upper_bound)", "n_valid": "count(*)",
        "iqr_outliers": "count_if(value < lower_bound OR value > upper_bound)",
        "zscore_outliers": f"count_if(sd > 0 AND abs((value - centre) / sd) > {z})",
        "min_value": "min(value)", "max_value": "max(value)", "g1": "skewness(value)",
    }, ["feature"]).selectExpr(
        "feature AS column", "n_valid", "iqr_outliers", "zscore_outliers", "lower_bound", "upper_bound", "min_value",
        "max_value", f"{skew} AS skewness",
    )


# ------------------------------------------------------- score and issues

def quality_score(df: DataFrame) -> DataFrame:
    """One row: the four dimensions (0-1), the weighted score (0-100) and its band."""
    _, invalid, rules = validity_probes(df)
    conflicts = [e for months in contradictions(df).values() for e in months.values()]
    counts = agg(df, {
        "n": "count(*)",
        "missing_cells": s.plus(f"count_if({s.is_missing(df, c)})" for c in df.columns),
        "invalid_cells": s.plus(invalid.values()) if invalid else "0L",
        "conflict_rows": f"count_if({s.row_any(conflicts)})" if conflicts else "0L",
    })
    share = lambda bad, all_: f"greatest(0D, least(1D, 1 - coalesce({s.divide(bad, all_)}, 0D)))"
    w = v.QUALITY_WEIGHTS
    return side_by_side(counts, duplicate_counts(df)).selectExpr(
        "n AS n_rows", f"{share('missing_cells', f'n * {len(df.columns)}')} AS completeness",
        f"{share('duplicates_without_id', 'n')} AS uniqueness", f"{share('invalid_cells', f'n * {rules}')} AS validity",
        f"{share('conflict_rows', 'n')} AS consistency", "missing_cells", "invalid_cells", f"n * {rules} AS cells_checked",
        "duplicates_without_id", "conflict_rows",
    ).selectExpr("*", " + ".join(f"{k} * {x}" for k, x in w.items()) + " AS score").selectExpr(
        "*", "CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' "
             "ELSE 'Poor' END AS band",
    )


def dtype_issues(df: DataFrame) -> DataFrame:
    """Columns that should be numeric and are not, with the values that cannot be parsed."""
    roles = Roles.of(df)
    wanted = [c for r in ("credit_limit", "age", "bill_amount", "payment_amount", "payment_status", "target") for c in roles.all(r)]
    texts = [c for c in wanted if not s.is_numeric(df.schema[c].dataType)]
    if not texts:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    bad = {c: f"count_if({s.name(c)} IS NOT NULL AND {s.parse_number(s.name(c))} IS NULL)" for c in texts}
    return unpivot(agg(df, {"__rows": "count(*)", **bad}), [
        {"check": "'unexpected_dtype'", "severity": f"IF({s.name(c)} > 0, 'high', 'medium')", "column": s.text(c),
         "affected_rows": f"IF({s.name(c)} > 0, {s.name(c)}, __rows)", "records": s.name(c)} for c in texts
    ])


def constant_issues(df: DataFrame) -> DataFrame:
    """Empty columns (high) and constant columns (low); nothing on tables of one row or less."""
    return profile.column_profile(df).filter("n_rows > 1 AND distinct_values <= 1").selectExpr(
        "IF(distinct_values = 0, 'empty_column', 'constant_column') AS check",
        "IF(distinct_values = 0, 'high', 'low') AS severity", "column", "n_rows AS affected_rows", "n_rows AS records",
    )


def duplicate_issues(df: DataFrame) -> DataFrame:
    kinds = (("exact_duplicate_rows", "high", "exact_duplicates"),
             ("duplicate_rows_excluding_id", "medium", "duplicates_without_id"),
             ("duplicate_identifier", "high", "repeated_ids"))
    return unpivot(duplicate_counts(df), [
        {"check": s.text(n), "severity": s.text(sev), "column": "CAST(NULL AS STRING)", "affected_rows": c, "records": c}
        for n, sev, c in kinds
    ]).filter("affected_rows > 0")


def validity_issues(df: DataFrame) -> DataFrame:
    probes, _, _ = validity_probes(df)
    severity = {"unexpected_category_code": "high", "undocumented_category_code": "medium", "invalid_target_value": "high",
                "undocumented_status": "low"}
    entries = []
    for key in probes:
        name, column = key.split(":", 1)
        if name == "undocumented_status_cells":
            continue
        level = severity.get(name) or ("high" if column == Roles.of(df).one("credit_limit") else "medium")
        records = s.name("undocumented_status_cells:") if name == "undocumented_status" else s.name(key)
        shown = "undocumented_category_code" if name == "undocumented_status" else name
        entries.append({"check": s.text(shown), "severity": s.text(level), "column": s.text(column or None),
                        "affected_rows": s.name(key), "records": records})
    return unpivot(agg(df, probes), entries).filter("affected_rows > 0")


def issues(df: DataFrame) -> DataFrame:
    """Every issue found, most severe first, then by rows affected."""
    parts = [
        validity_issues(df),
        dtype_issues(df),
        consistency(df).filter("check <> 'any_contradiction' AND records > 0").selectExpr(
            "check", "severity", "CAST(NULL AS STRING) AS column", "affected_rows", "records"),
        constant_issues(df),
        duplicate_issues(df),
    ]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    total = agg(df, {"__rows": "count(*)"})
    order = "CASE severity " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(SEVERITIES)) + " END"
    return side_by_side(union, total).selectExpr(
        "check", "severity", f"{order} AS severity_ord", "column", "affected_rows", "records",
        f"coalesce({s.divide('affected_rows', '__rows')}, 0D) * 100 AS affected_pct",
    ).orderBy("severity_ord", F.desc("affected_rows"), "check", "column")


def issue_counts(found: DataFrame) -> DataFrame:
    """Issues per severity; severities without an issue show 0."""
    levels = found.sparkSession.createDataFrame([Row(x) for x in SEVERITIES], "severity string")
    return levels.join(F.broadcast(agg(found, {"n": "count(*)"}, ["severity"])), "severity", "left").selectExpr(
        "severity", "coalesce(n, 0L) AS issues")
