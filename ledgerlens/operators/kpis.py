"""Portfolio KPIs: one aggregation, one distinct count and one quantile pass.

The distinct count stays out of the big aggregation on purpose: mixed in, Spark
would shuffle every other aggregation buffer once per client.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions import text
from ledgerlens.functions.tables import agg, side_by_side, unpivot
from ledgerlens.operators.quantiles import quantile_table
from ledgerlens.roles import Roles
from ledgerlens.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Kpi:
    """``kind`` says how the value is made from ``source`` (a role, ``role:newest`` or a column)."""

    key: str
    label: str
    category: str
    fmt: str
    kind: str
    source: str
    higher_is_better: bool | None = None
    expression: str | None = None  # for user-defined KPIs: any aggregate, as SQL text


# fixed values: the KPI catalogue
CATALOGUE = (
    Kpi("total_clients", "Total Clients", "Portfolio scale", "integer", "distinct", "role:client_id"),
    Kpi("total_records", "Total Records", "Portfolio scale", "integer", "rows", ""),
    Kpi("client_month_records", "Client-Month Observations", "Portfolio scale", "integer", "client_months", "role:bill_amount"),
    Kpi("observed_default_rate", "Observed Default Rate", "Risk", "percentage", "mean_pct", "role:target", False),
    Kpi("default_client_count", "Defaulting Clients", "Risk", "integer", "ones", "role:target", False),
    Kpi("avg_credit_limit", "Average Credit Limit", "Credit capacity", "currency", "mean", "role:credit_limit"),
    Kpi("median_credit_limit", "Median Credit Limit", "Credit capacity", "currency", "median", "role:credit_limit"),
    Kpi("total_credit_limit", "Total Credit Exposure Limit", "Credit capacity", "currency_compact", "sum", "role:credit_limit"),
    Kpi("total_outstanding_balance", "Total Outstanding Balance", "Credit capacity", "currency_compact", "sum", "role:bill_amount"),
    Kpi("avg_outstanding_balance", "Average Outstanding Balance", "Credit capacity", "currency", "mean", "role:bill_amount"),
    Kpi("median_outstanding_balance", "Median Outstanding Balance", "Credit capacity", "currency", "median", "role:bill_amount"),
    Kpi("avg_utilisation", "Average Credit Utilisation", "Utilisation", "percentage", "mean_pct", "utilisation_latest", False),
    Kpi("median_utilisation", "Median Credit Utilisation", "Utilisation", "percentage", "median_pct", "utilisation_latest", False),
    Kpi("high_utilisation_share", "High-Utilisation Clients", "Utilisation", "percentage", "share", "is_high_utilisation", False),
    Kpi("high_utilisation_count", "High-Utilisation Client Count", "Utilisation", "integer", "trues", "is_high_utilisation", False),
    Kpi("over_limit_share", "Over-Limit Clients", "Utilisation", "percentage", "share", "is_over_limit", False),
    Kpi("total_repayments", "Total Repayments (6 months)", "Repayment behaviour", "currency_compact", "sum", "total_paid_6m", True),
    Kpi("median_repayment_ratio", "Median Repayment Ratio", "Repayment behaviour", "percentage", "median_pct", "repayment_ratio_median", True),
    Kpi("avg_capped_repayment_ratio", "Average Repayment Ratio (capped)", "Repayment behaviour", "percentage", "mean_pct", "repayment_ratio_capped_mean", True),
    Kpi("full_payer_share", "Full Payers", "Repayment behaviour", "percentage", "share", "is_full_payer", True),
    Kpi("revolver_share", "Revolving Borrowers", "Repayment behaviour", "percentage", "share", "is_revolver", False),
    Kpi("currently_delinquent_share", "Currently Delinquent", "Delinquency", "percentage", "share", "is_currently_delinquent", False),
    Kpi("currently_delinquent_count", "Currently Delinquent Clients", "Delinquency", "integer", "trues", "is_currently_delinquent", False),
    Kpi("ever_delinquent_share", "Ever Delinquent", "Delinquency", "percentage", "share", "ever_delinquent", False),
    Kpi("avg_delinquent_months", "Average Delinquent Months", "Delinquency", "decimal", "mean", "delinquent_months_count", False),
    Kpi("avg_max_delinquency", "Average Worst Delay", "Delinquency", "months", "mean", "max_delinquency", False),
    Kpi("avg_age", "Average Age", "Demographics", "decimal", "mean", "role:age"),
    Kpi("median_age", "Median Age", "Demographics", "decimal", "median", "role:age"),
    Kpi("median_balance_trend", "Median Balance Trend", "Trend", "currency", "median", "bill_trend_slope"),
    Kpi("share_growing_balance", "Clients With Growing Balances", "Trend", "percentage", "positive_share", "bill_trend_slope", False),
)


def source_column(kpi: Kpi, roles: Roles) -> str | None:
    """Column a KPI reads; for a monthly role the newest month."""
    if kpi.source.startswith("role:"):
        return roles.one(kpi.source.removeprefix("role:"))
    return kpi.source if kpi.source in roles.columns else None


def _aggregate(df: DataFrame, kpi: Kpi, column: str | None, roles: Roles) -> str:
    if kpi.expression is not None:
        return kpi.expression
    if kpi.kind == "rows":
        return "count(*)"
    if kpi.kind == "client_months":
        return f"count(*) * {len(roles.months('bill_amount'))}"
    flag = f"coalesce(boolean({s.name(column)}), false)"
    if kpi.kind == "share":
        return f"avg(int({flag})) * 100"
    if kpi.kind == "trues":
        return f"count_if({flag})"
    x = s.value(df, column)
    return {
        "mean": f"avg({x})",
        "mean_pct": f"avg({x}) * 100",
        "sum": f"sum({x})",
        "ones": f"IF(count({x}) > 0, count_if({x} = 1), NULL)",
        "positive_share": f"avg(int({x} > 0)) * 100",
    }[kpi.kind]


def calculate_kpis(df: DataFrame, definitions: Sequence[Kpi] = CATALOGUE, settings: Settings = DEFAULTS,
                   roles: Roles | None = None) -> DataFrame:
    """One row per KPI; those that cannot be computed say why in ``reason``.

    A user-defined KPI passes its own aggregate (SQL text) in ``expression``.
    """
    roles = roles or Roles.of(df)
    columns = {k.key: source_column(k, roles) for k in definitions}
    usable = [k for k in definitions if k.expression is not None or k.kind in ("rows", "distinct") or columns[k.key]]
    medians = [k for k in usable if k.kind.startswith("median") and k.expression is None]
    distinct = [k for k in usable if k.kind == "distinct" and k.expression is None]
    direct = [k for k in usable if k not in medians and k not in distinct]

    parts = [agg(df, {"__rows": "count(*)", **{
        k.key: f"double({_aggregate(df, k, columns[k.key], roles)})" for k in direct
    }})]
    for k in distinct:
        ids = df.select(columns[k.key]).dropna().distinct() if columns[k.key] else df
        parts.append(agg(ids, {k.key: "double(count(*))"}))
    if medians:
        table = quantile_table(df, sorted({columns[k.key] for k in medians}), {"middle": 0.5})
        parts.append(agg(table, {
            k.key: f"max(IF(feature = {s.text(columns[k.key])}, middle, NULL)) * {100 if k.kind == 'median_pct' else 1}"
            for k in medians
        }))

    present, entries = {k.key for k in usable}, []
    for order, k in enumerate(definitions, start=1):
        value = s.finite(f"IF(__rows > 0, {s.name(k.key)}, NULL)") if k.key in present else "CAST(NULL AS DOUBLE)"
        missing = f"Requires {k.source.removeprefix('role:')}, which is not present."
        entries.append({
            "kpi_order": str(order), "key": s.text(k.key), "label": s.text(k.label), "category": s.text(k.category),
            "format": s.text(k.fmt),
            "higher_is_better": "CAST(NULL AS BOOLEAN)" if k.higher_is_better is None else str(k.higher_is_better).lower(),
            "value": value, "problem": "CAST(NULL AS STRING)" if k.key in present else s.text(missing), "n_rows": "__rows",
        })
    reason = (
        "CASE WHEN n_rows = 0 THEN 'No rows in the current selection.' WHEN problem IS NOT NULL THEN problem "
        "WHEN value IS NULL THEN 'No finite value could be computed from the available rows.' END"
    )
    return unpivot(side_by_side(*parts), entries).selectExpr(
        "kpi_order", "key", "label", "category", "format", "higher_is_better", "value",
        f"{text.by_format('value', 'format')} AS formatted", f"{reason} AS reason", "n_rows",
        f"n_rows < {settings.min_rows} AS insufficient_data",
    )


def available(kpis: DataFrame) -> DataFrame:
    return kpis.filter(F.col("value").isNotNull())


def unavailable(kpis: DataFrame, roles: Roles) -> DataFrame:
    """KPIs without a value, plus the roles the data cannot supply."""
    missing = kpis.filter(F.col("value").isNull()).select("key", "reason")
    absent = [Row(f"role:{role}", why) for role, why in roles.absent().items()]
    if not absent:
        return missing
    return missing.unionByName(kpis.sparkSession.createDataFrame(absent, "key string, reason string"))


def catalogue(spark, definitions: Sequence[Kpi] = CATALOGUE) -> DataFrame:
    rows = [Row(k.key, k.label, k.category, k.fmt, k.kind, k.source, k.higher_is_better) for k in definitions]
    return spark.createDataFrame(
        rows, "key string, label string, category string, format string, kind string, source string, "
              "higher_is_better boolean"
    )


def kpi_deltas(selection: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Selection against portfolio; below half a percent of the baseline counts as flat."""
    a = available(selection).select("key", "label", "format", "higher_is_better", F.col("value").alias("selection"))
    b = available(portfolio).select("key", F.col("value").alias("portfolio"))
    joined = a.join(F.broadcast(b), "key").selectExpr("*", "selection - portfolio AS difference").selectExpr(
        "*", "abs(difference) / greatest(abs(portfolio), 1e-9D) < 0.005 AS is_flat", "abs(difference) AS size"
    )
    amount = (
        f"CASE format WHEN 'percentage' THEN {text.decimal('size', 2, ' pp')} WHEN 'currency' THEN {text.currency('size')} "
        f"WHEN 'currency_compact' THEN {text.currency_compact('size')} WHEN 'integer' THEN format_number(rint(size), 0) "
        f"ELSE {text.decimal('size', 2, grouped=True)} END"
    )
    return joined.selectExpr(
        "key", "label", "selection", "portfolio", "difference", "is_flat",
        "CASE WHEN is_flat THEN 'flat' WHEN higher_is_better IS NULL THEN 'neutral' "
        "WHEN higher_is_better = (difference > 0) THEN 'good' ELSE 'bad' END AS verdict",
        "IF(is_flat, '≈ in line with the portfolio', "
        f"concat(IF(difference > 0, '↑ ', '↓ '), {amount}, ' vs the portfolio')) AS text",
    )
