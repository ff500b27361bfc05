"""Period-over-period trends of monthly measures.

The panel is aggregated once to one row per (measure, month); everything after
that works on a handful of rows per measure, so its windows are tiny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions.scalars import divide, finite
from ledgerlens.functions.tables import agg, unpivot
from ledgerlens.operators.quantiles import quantile_table, quantiles
from ledgerlens.roles import Roles

# measure -> (panel column, statistic, unit, label)
MEASURES = {
    "balance_mean": ("bill_amt", "mean", "NT$", "Mean statement balance"),
    "balance_median": ("bill_amt", "median", "NT$", "Median statement balance"),
    "balance_total": ("bill_amt", "sum", "NT$", "Sum statement balance"),
    "payment_mean": ("pay_amt", "mean", "NT$", "Mean payment amount"),
    "payment_median": ("pay_amt", "median", "NT$", "Median payment amount"),
    "payment_total": ("pay_amt", "sum", "NT$", "Sum payment amount"),
    "utilisation_mean": ("utilisation", "mean_pct", "%", "Mean credit utilisation"),
    "utilisation_median": ("utilisation", "median_pct", "%", "Median credit utilisation"),
    "delinquency_rate": ("pay_status", "late_pct", "%", "Share of clients behind on payment"),
    "active_accounts": ("bill_amt", "positive_pct", "%", "Share of accounts with a positive balance"),
}
DEFAULT_MEASURES = tuple(m for m in MEASURES if m not in ("payment_median", "utilisation_median"))


def panel_summary(panel: DataFrame) -> DataFrame:
    """One row per month; here a null status counts as not delinquent."""
    keys = ["month_index", "month_label", "month_order"]
    clients = panel.select(*keys, "client_id").distinct().groupBy(*keys).agg(F.count("client_id").alias("n_clients"))
    bill, pay, use = finite("bill_amt"), finite("pay_amt"), finite("utilisation")
    sums = agg(panel, {
        "mean_bill": f"avg({bill})",
        "total_bill": f"coalesce(sum({bill}), 0D)",
        "mean_payment": f"avg({pay})",
        "total_payment": f"coalesce(sum({pay}), 0D)",
        "delinquency_rate_pct": "avg(int(coalesce(is_delinquent, false))) * 100",
        "mean_utilisation_pct": f"avg({use}) * 100",
        "active_share_pct": f"avg(int(coalesce({bill} > 0, false))) * 100",
    }, keys)
    middle = quantile_table(panel, ["bill_amt"], {"median_bill": 0.5}, by=["month_index"]).drop("feature")
    return sums.join(F.broadcast(clients), keys).join(F.broadcast(middle), "month_index", "left")


def measure_points(panel: DataFrame, measures: Sequence[str] = DEFAULT_MEASURES) -> DataFrame:
    """(measure, month_index, month_label, month_order, value, n); months without values are left out."""
    keys = ["month_index", "month_label", "month_order"]
    chosen = {m: MEASURES[m] for m in measures}
    stat = {
        "mean": "avg({x})", "sum": "sum({x})", "mean_pct": "avg({x}) * 100",
        "late_pct": f"avg(int({{x}} >= {v.DELINQUENT_FROM})) * 100", "positive_pct": "avg(int({x} > 0)) * 100",
    }
    direct = {m: d for m, d in chosen.items() if d[1] in stat}
    medians = {m: d for m, d in chosen.items() if d[1] not in stat}
    parts = []
    if direct:
        sums = agg(panel, {
            **{f"{m}_value": f"double({stat[d[1]].format(x=finite(d[0]))})" for m, d in direct.items()},
            **{f"{c}_n": f"count({finite(c)})" for c in {d[0] for d in direct.values()}},
        }, keys)
        parts.append(unpivot(sums, [
            {"measure": f"'{m}'", "value": f"{m}_value", "n": f"{d[0]}_n"} for m, d in direct.items()
        ], keep=keys))
    if medians:
        table = quantiles(panel, sorted({d[0] for d in medians.values()}), (0.5,), by=keys)
        for m, (column, kind, _, _) in medians.items():
            scale = 100 if kind == "median_pct" else 1
            parts.append(table.filter(F.col("feature") == column).selectExpr(
                *keys, f"'{m}' AS measure", f"quantile * {scale} AS value", "n"
            ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull()).select("measure", *keys, "value", "n")


def period_changes(points: DataFrame) -> DataFrame:
    """Adds the change and percent change against the previous period of the same measure."""
    before = F.lag("value").over(Window.partitionBy("measure").orderBy("month_order"))
    return points.withColumn("before", before).selectExpr(
        *[c for c in points.columns], "value - before AS change",
        f"{divide('value - before', 'abs(before)')} * 100 AS change_pct",
    )


def flag_anomalies(changes: DataFrame) -> DataFrame:
    """Adds ``score`` and ``is_anomaly``.

    The score is the modified z of the change (median and MAD); when the MAD is
    zero the ordinary z is used.  A series needs four points and three changes.
    """
    over = "OVER (PARTITION BY measure)"  # a few months per measure; all windows share one shuffle
    stats = changes.selectExpr(
        "*", f"count(*) {over} AS points", f"count(change) {over} AS changes", f"percentile(change, 0.5) {over} AS mid",
        f"avg(change) {over} AS centre", f"stddev_pop(change) {over} AS sd",
    ).selectExpr("*", f"percentile(abs(change - mid), 0.5) {over} AS mad")
    score = (
        "CASE WHEN points < 4 OR changes < 3 THEN NULL "
        f"WHEN mad > 0 THEN {v.MODIFIED_Z_SCALE} * (change - mid) / mad "
        "WHEN sd > 0 THEN (change - centre) / sd END"
    )
    return stats.selectExpr(*changes.columns, "mad", f"double({score}) AS score").selectExpr(
        *changes.columns, "score",
        f"coalesce(abs(score) > IF(mad > 0, {v.ANOMALY_MODIFIED_Z}, {v.ANOMALY_Z}), false) AS is_anomaly",
    )


def assemble_trends(points: DataFrame) -> DataFrame:
    """One row per measure: first, last, change, slope, peak, trough, direction and anomalies.

    A measure with fewer than two periods comes out with status ``unavailable``.
    """
    flagged = flag_anomalies(period_changes(points))
    position = F.row_number().over(Window.partitionBy("measure").orderBy("month_order"))
    sums = agg(flagged.withColumn("position", position.cast("double")), {
        "n_periods": "count(*)",
        "first_value": "min_by(value, month_order)",
        "last_value": "max_by(value, month_order)",
        "slope": "regr_slope(value, position)",
        # ties go to the earliest period
        "peak": "max_by(month_label, struct(value, -month_order))",
        "trough": "min_by(month_label, struct(value, month_order))",
        "first_period": "min_by(month_label, month_order)",
        "last_period": "max_by(month_label, month_order)",
        "late": "array_sort(collect_list(IF(is_anomaly, struct(month_order, month_label), NULL)))",
    }, ["measure"])
    changed = sums.selectExpr(
        "*", "last_value - first_value AS change", f"{divide('last_value - first_value', 'abs(first_value)')} * 100 AS pct"
    )
    direction = (
        "CASE WHEN pct IS NULL THEN CASE WHEN change > 0 THEN 'increasing' WHEN change < 0 THEN 'decreasing' ELSE 'flat' END "
        f"WHEN abs(pct) < {v.FLAT_TREND_PCT} THEN 'flat' WHEN pct > 0 THEN 'increasing' ELSE 'decreasing' END"
    )
    only = lambda e, n: f"IF(n_periods >= 2, {e}, NULL) AS {n}"
    return changed.selectExpr(
        "measure", "IF(n_periods >= 2, 'ok', 'unavailable') AS status", "n_periods", "first_period", "last_period",
        "first_value", "last_value", only("change", "total_change"), only("pct", "total_change_pct"),
        only("change / (n_periods - 1)", "average_change"), only("slope", "slope"), only("peak", "peak"),
        only("trough", "trough"), only(direction, "direction"),
        "concat_ws(', ', transform(late, x -> x.month_label)) AS anomalies",
    )


def trends(panel: DataFrame, measures: Sequence[str] = DEFAULT_MEASURES) -> DataFrame:
    case = lambda i: "CASE measure " + " ".join(f"WHEN '{m}' THEN '{MEASURES[m][i]}'" for m in measures) + " END"
    return assemble_trends(measure_points(panel, measures)).selectExpr("*", f"{case(3)} AS label", f"{case(2)} AS unit")


def movement(panel: DataFrame) -> DataFrame:
    """First against last period of the four headline measures, with display text."""
    t = trends(panel, ("balance_mean", "payment_mean", "utilisation_mean", "delinquency_rate")).filter("status = 'ok'")
    number = lambda x: f"IF(unit = 'NT$', format_number({x}, 0), format_string('%.2f%%', {x}))"
    size = "IF(unit = 'NT$', format_number(abs(total_change), 0), format_string('%.2f pp', abs(total_change)))"
    return t.selectExpr(
        "measure", "first_period", "last_period", "first_value", "last_value", "total_change", "total_change_pct",
        "direction", f"{number('first_value')} AS first_text", f"{number('last_value')} AS last_text",
        f"concat(IF(total_change >= 0, '+', '-'), {size}) AS change_text",
        "IF(total_change_pct IS NULL, 'n/a', format_string('%+.1f%%', total_change_pct)) AS relative_text",
    )


def temporal_capability(df: DataFrame) -> DataFrame:
    """What the columns allow in time, and what is refused."""
    roles = Roles.of(df)
    months = roles.panel_months()
    families = [len(roles.months(r)) for r in ("bill_amount", "payment_amount", "payment_status")]
    rows = [
        Row("calendar_date", False, 0, "no date column"),
        Row("monthly_panel", bool(months), len(months), "ordinal months, newest is 1"),
        Row("statement_balance", families[0] > 0, families[0], "months present"),
        Row("payment_amount", families[1] > 0, families[1], "months present"),
        Row("repayment_status", families[2] > 0, families[2], "months present"),
        Row("period_comparison", len(months) >= 2, len(months), "needs at least two periods"),
        Row("daily_weekly", False, 0, "refused: no date column"),
        Row("forecasting", False, 0, f"refused: {len(months)} periods cannot support a projection"),
    ]
    return df.sparkSession.createDataFrame(rows, "capability string, supported boolean, periods int, note string")
