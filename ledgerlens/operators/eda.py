"""Exploratory statistics as grouped aggregations over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, beside, side_by_side
from ledgerlens.operators.quantiles import melt, quantile_table, quantile_values
from ledgerlens.roles import Roles
from ledgerlens.settings import DEFAULTS

STATUS_SCHEMA = "analysis string, n_rows long, required_rows long, reason string"


def status(spark, analysis: str, n_rows: int, required: int, reason: str = "") -> DataFrame:
    """The row an analysis returns instead of a result when it refuses."""
    return spark.createDataFrame([Row(analysis, n_rows, required, reason)], STATUS_SCHEMA)


def refusal(df: DataFrame, analysis: str, columns: Sequence[str], required: int = 1, reason: str = "") -> DataFrame | None:
    """The status row of an analysis that cannot run: a column is missing, or too few rows have all of them.

    Counts no further than ``required`` rows.
    """
    missing = [c for c in columns if c not in df.columns]
    complete = df if missing or not columns else df.select(*[F.col(s.name(c)) for c in columns]).dropna()
    n = complete.limit(required).count()
    if missing:
        return status(df.sparkSession, analysis, n, required, f"Missing column(s): {', '.join(missing)}.")
    return status(df.sparkSession, analysis, n, required, reason) if n < required else None


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns with at least two distinct values; the key is left out (one aggregation)."""
    key = Roles.of(df).one("client_id") or v.ID
    names = [f.name for f in df.schema.fields if s.is_numeric(f.dataType) and f.name != key and not f.name.endswith("_ord")]
    if not names:
        return []
    row = agg(df, {c: f"min({s.value(df, c)}) < max({s.value(df, c)})" for c in names}).first()
    return [c for c in names if row[c]]


# ------------------------------------------------------------- univariate

def bias_corrected(n: str, skew: str, kurtosis: str) -> tuple[str, str]:
    """Sample-adjusted skewness and excess kurtosis from their population versions."""
    g1 = f"IF({n} > 2, coalesce(nanvl({skew}, 0D), 0D) * sqrt(double({n}) * ({n} - 1)) / ({n} - 2), 0D)"
    flat = f"(({kurtosis}) IS NULL OR isnan({kurtosis}))"  # no variance: reported as 0
    g2 = (f"IF({n} > 3 AND NOT {flat}, (double({n}) - 1) / ((double({n}) - 2) * ({n} - 3)) * (({n} + 1) * {kurtosis} + 6), 0D)")
    return g1, g2


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Moments, quartiles and shape, one row per column that has finite values."""
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    long = melt(df, columns)
    moments = agg(long, {
        "count": "count(*)", "mean": "avg(value)", "sd": "stddev_samp(value)", "min": "min(value)", "max": "max(value)",
        "g1": "skewness(value)", "g2": "kurtosis(value)",
    }, ["feature"])
    rows = agg(df, {"rows": "count(*)"})
    quartiles = quantile_table(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    skew, kurt = bias_corrected("count", "g1", "g2")
    base = moments.join(F.broadcast(quartiles), "feature").transform(beside, rows).selectExpr(
        "feature AS column", "count", "rows - count AS missing", "mean", "median", "IF(count > 1, sd, 0D) AS std",
        "min", "q1", "q3", "max", "q3 - q1 AS iqr", f"{skew} AS skewness", f"{kurt} AS kurtosis",
    )
    return base.selectExpr(
        "*", f"{s.divide('std', 'abs(mean)')} AS coefficient_of_variation",
        f"{s.divide('mean - median', 'abs(median)')} * 100 AS mean_median_gap_pct",
        "CASE WHEN skewness > 1 THEN 'strongly right-skewed' WHEN skewness > 0.5 THEN 'moderately right-skewed' "
        "WHEN skewness < -1 THEN 'strongly left-skewed' WHEN skewness < -0.5 THEN 'moderately left-skewed' "
        "ELSE 'approximately symmetric' END AS skew_description",
    )


def frequency(df: DataFrame, column: str, top_n: int | None = None, drop_nulls: bool = False) -> DataFrame:
    """Counts per value, most frequent first; shares are relative to the values shown.

    Refuses (status row) without rows or without the column.
    """
    there = [] if column in df.columns else [column]
    refused = refusal(df, f"Frequency analysis of '{column}'", there, reason="There are no rows.")
    if refused is not None:
        return refused
    counts = df.groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("count"))
    if drop_nulls:
        counts = counts.filter("category IS NOT NULL")
    if top_n is not None:
        counts = counts.orderBy(F.desc("count"), F.asc_nulls_last("category")).limit(top_n)
    total = agg(counts, {"total": "sum(count)"})
    shown = counts.transform(beside, total).selectExpr("category", "count", "count / total * 100 AS percentage")
    return shown.orderBy(F.desc("count"), F.asc_nulls_last("category"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the observed range, the last one closed; empty bins appear with 0.

    Refuses (status row) with fewer than two finite values or a constant column.
    """
    x = s.value(df, column)
    ends = agg(df, {"n": f"count({x})", "low": f"min({x})", "high": f"max({x})"}).first()
    if ends["n"] < 2 or ends["low"] == ends["high"]:
        reason = "At least two finite values are needed." if ends["n"] < 2 else "All values are identical."
        return status(df.sparkSession, f"Distribution of '{column}'", ends["n"], 2, reason)
    low, high, n = s.number(ends["low"]), s.number(ends["high"]), ends["n"]
    counted = df.selectExpr(f"least(width_bucket({x}, {low}, {high}, {bins}), {bins}) AS bin").filter(
        "bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))
    width = f"(({high} - {low}) / {bins})"
    frame = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return frame.join(F.broadcast(counted), "bin", "left").selectExpr(
        "bin", f"{low} + (bin - 1) * {width} AS bin_left", f"IF(bin = {bins}, {high}, {low} + bin * {width}) AS bin_right",
        "coalesce(count, 0L) AS count", f"coalesce(count, 0L) / {n} * 100 AS percentage",
    ).selectExpr("bin", "bin_left", "bin_right", "(bin_left + bin_right) / 2 AS bin_center", "count", "percentage")


def trimmed_histogram(df: DataFrame, column: str, bins: int = 40, upper: float = 0.995) -> DataFrame:
    """Histogram of the values up to a high quantile, with the median of all of them."""
    q = quantile_values(df, [column], (0.5, upper))[column]
    if not q:
        return status(df.sparkSession, f"Distribution of '{column}'", 0, 2, "There are no finite values.")
    shown = df.filter(f"{s.value(df, column)} <= {s.number(q[upper])}")
    return histogram(shown, column, bins).withColumn("untrimmed_median", F.lit(q[0.5]))


# -------------------------------------------------------------- bivariate

def _pair(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, value) with neither side missing."""
    return df.selectExpr(f"{s.name(group)} AS grp", f"{s.value(df, column)} AS value").dropna()


def compare_groups(df: DataFrame, group: str, column: str, min_size: int = 5) -> DataFrame:
    """Count, mean, median, std, min and max per group; small groups are dropped.

    Every row carries the overall mean and median and the ratio of the highest
    to the lowest kept group mean.  Refuses (status row) without complete rows.
    """
    refused = refusal(df, f"Comparison of '{column}' by '{group}'", [group, column], reason="No row has both values.")
    if refused is not None:
        return refused
    pair = _pair(df, group, column)
    middle = quantile_table(pair, ["value"], {"median": 0.5}, by=["grp"]).drop("feature")
    every = agg(pair, {
        "count": "count(*)", "mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)",
    }, ["grp"])
    groups = every.filter(F.col("count") >= min_size)
    overall = side_by_side(
        agg(every, {"overall_mean": "sum(mean * count) / sum(count)", "low": f"min(IF(count >= {min_size}, mean, NULL))",
                    "high": f"max(IF(count >= {min_size}, mean, NULL))"}),
        agg(quantile_table(pair, ["value"], {"m": 0.5}), {"overall_median": "max(m)"}),
    )
    return groups.join(middle, "grp").transform(beside, overall).selectExpr(
        f"grp AS {s.name(group)}", "count", "mean", "median", "std", "min", "max", "overall_mean", "overall_median",
        "IF(low = 0, NULL, high / low) AS spread_ratio",
    )


def outcome_rates(df: DataFrame, category: str, target: str = v.TARGET, min_size: int = 30) -> DataFrame:
    """Outcome rate per category, lift over the whole, and which groups are large enough to rank.

    Refuses (status row) without complete rows.
    """
    refused = refusal(df, f"Outcome rates by '{category}'", [category, target], reason="No row has both values.")
    if refused is not None:
        return refused
    groups = agg(_pair(df, category, target), {"count": "count(*)", "events": "sum(value)"}, ["grp"])
    whole = agg(groups, {"overall": "sum(events) / sum(count) * 100"})
    return groups.transform(beside, whole).selectExpr(
        f"grp AS {s.name(category)}", "count", "bigint(events) AS events", "events / count * 100 AS rate_pct",
        "events / count * 100 - overall AS lift_vs_overall_pp", f"count >= {min_size} AS meets_min_size",
        "overall AS overall_rate_pct",
    )


def outcome_extremes(rates: DataFrame, category: str) -> DataFrame:
    """Highest and lowest category among the groups large enough, and the gap between them."""
    name = s.name(category)
    return agg(rates.filter("meets_min_size"), {
        "highest_category": f"max_by({name}, struct(rate_pct, {name}))",
        "lowest_category": f"min_by({name}, struct(rate_pct, {name}))",
        "rate_spread_pp": "max(rate_pct) - min(rate_pct)",
    })


def numeric_by_outcome(df: DataFrame, columns: Sequence[str], target: str = v.TARGET,
                       min_rows: int = DEFAULTS.min_rows) -> DataFrame:
    """Means, medians, difference and Cohen's d between outcome 1 and 0, one row per column.

    Columns with too few complete rows, or only one class, have status other than ``ok``.
    """
    columns = [c for c in columns if c in df.columns]
    y = s.value(df, target)
    with_y = s.project(df, {"__y": y}).filter("__y IS NOT NULL")
    long = melt(with_y, columns, by=["__y"])
    mean, var = "avg(IF(__y = {0}, value, NULL))", "var_samp(IF(__y = {0}, value, NULL))"
    stats = agg(long, {
        "n": "count(*)", "n_positive": "count_if(__y = 1)", "n_negative": "count_if(__y = 0)",
        "mean_positive": mean.format(1), "mean_negative": mean.format(0), "v1": var.format(1), "v0": var.format(0),
    }, ["feature"])
    by_class = quantile_table(with_y.filter("__y IN (0, 1)"), columns, {"m": 0.5}, by=["__y"])
    middles = agg(by_class, {
        "median_positive": "max(IF(__y = 1, m, NULL))", "median_negative": "max(IF(__y = 0, m, NULL))"
    }, ["feature"])
    pooled = ("sqrt(((n_positive - 1) * IF(n_positive > 1, v1, 0D) + (n_negative - 1) * IF(n_negative > 1, v0, 0D)) "
              "/ (n_positive + n_negative - 2))")
    out = stats.join(F.broadcast(middles), "feature", "left").selectExpr(
        "*", "mean_positive - mean_negative AS difference",
        f"IF(n_positive + n_negative > 2, {pooled}, 0D) AS pooled",
        f"CASE WHEN n < {min_rows} THEN 'too few rows' WHEN n_positive = 0 OR n_negative = 0 THEN 'one class only' "
        "ELSE 'ok' END AS status",
    ).selectExpr("*", "IF(pooled > 0, difference / pooled, NULL) AS d")
    ok = lambda e, n: f"IF(status = 'ok', {e}, NULL) AS {n}"
    size = ("CASE WHEN d IS NULL THEN 'undefined' WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' "
            "WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END")
    return out.selectExpr(
        "feature", "status", "n_positive", "n_negative", ok("mean_positive", "mean_positive"),
        ok("mean_negative", "mean_negative"), ok("median_positive", "median_positive"),
        ok("median_negative", "median_negative"), ok("difference", "difference"),
        ok(f"{s.divide('difference', 'abs(mean_negative)')} * 100", "relative_difference_pct"),
        ok("d", "cohens_d"), ok(size, "effect_size_label"),
    )


def cross_tab(df: DataFrame, row: str, column: str, value: str | None = None, how: str = "avg") -> DataFrame:
    """Long-form pivot: one row per (row, column) cell; count cells that do not occur are 0.

    Refuses (status row) without rows or when a column is missing.
    """
    refused = refusal(df, f"Cross-tabulation of '{row}' by '{column}'", [row, column, *([value] if value else [])], reason="No row has all values.")
    if refused is not None:
        return refused
    if value is not None:
        return df.filter(f"{s.name(row)} IS NOT NULL AND {s.name(column)} IS NOT NULL").groupBy(row, column).agg(
            F.expr(f"{how}({s.value(df, value)})").alias("value")
        ).filter("value IS NOT NULL")
    cells = df.select(row, column).dropna().groupBy(row, column).agg(F.count("*").alias("value"))
    # the grid of labels is as large as the pivoted table itself
    across = agg(cells, {"labels": f"collect_set({s.name(column)})"})
    grid = cells.select(row).distinct().transform(beside, across).select(row, F.explode("labels").alias(column))
    return grid.join(cells, [row, column], "left").select(row, column, F.coalesce("value", F.lit(0)).alias("value"))


def pivoted(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Wide form of a cross-tab (one column per label)."""
    return cells.groupBy(row).pivot(column).agg(F.first("value"))


def row_composition(cells: DataFrame, row: str) -> DataFrame:
    """Each cell as a percentage of its row; a row that sums to zero gives null."""
    total = F.sum("value").over(Window.partitionBy(row))
    return cells.withColumn("total", total).withColumn(
        "row_pct", F.expr(f"{s.divide('value', 'total')} * 100")
    ).drop("total")


def group_profile(df: DataFrame, group: str, metrics: Sequence[str], target: str | None = None) -> DataFrame:
    """Mean of each metric per group, with size, share and outcome rate."""
    metrics = [m for m in metrics if m in df.columns]
    present = df.filter(f"{s.name(group)} IS NOT NULL")
    stats = {"n_clients": "count(*)", **{m: f"avg({s.value(df, m)})" for m in metrics}}
    if target and target in df.columns:
        stats[f"{target}_rate_pct"] = f"avg({s.value(df, target)}) * 100"
    whole = agg(df, {"__rows": "count(*)"})
    return agg(present, stats, [group]).transform(beside, whole).selectExpr(
        s.name(group), *[s.name(c) for c in stats], "n_clients / __rows * 100 AS share_of_portfolio_pct"
    )


def box_stats(df: DataFrame, category: str, column: str, max_categories: int | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest value within the fence) and mean of all categories, or of the first ones by name."""
    kept = pair = _pair(df, category, column)
    if max_categories is not None:
        shown = pair.select("grp").distinct().orderBy("grp").limit(max_categories)
        kept = pair.join(F.broadcast(shown), "grp")
    quartiles = quantile_table(kept, ["value"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["grp"]).drop("feature")
    inside = f"value BETWEEN q1 - {k} * (q3 - q1) AND q3 + {k} * (q3 - q1)"
    return agg(kept.join(F.broadcast(quartiles), "grp"), {
        "count": "count(*)", "mean": "avg(value)", "q1": "first(q1)", "median": "first(median)", "q3": "first(q3)",
        "whisker_low": f"min(IF({inside}, value, NULL))", "whisker_high": f"max(IF({inside}, value, NULL))",
        "outliers": f"count_if(NOT ({inside}))",
    }, ["grp"]).withColumnRenamed("grp", category)


# ---------------------------------------------------------------- outliers

def outlier_analysis(df: DataFrame, columns: Sequence[str] | None = None,
                     k: float = DEFAULTS.iqr_multiplier) -> DataFrame:
    """Bounds, counts and tail share per column.

    The fence is k x IQR; a zero IQR falls back to k x scaled MAD, and a zero MAD
    to any deviation from the median.  Constant columns and columns with fewer
    than four values give no row.  Three passes over the melted table.
    """
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    long = melt(df, columns)
    quartiles = quantile_table(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    found = quartiles.collect()  # one row a column; the fences below are literals and not a second quantile job
    quartiles = df.sparkSession.createDataFrame(found, quartiles.schema)
    middle = {r["feature"]: r["median"] for r in found if r["q3"] <= r["q1"]}
    flat = list(middle)
    if flat:
        deviations = df.selectExpr(*[f"abs({s.value(df, c)} - {s.number(middle[c])}) AS {s.name(c)}" for c in flat])
        mads = quantile_table(deviations, flat, {"mad": 0.5})
    else:
        mads = df.sparkSession.createDataFrame([], "feature string, mad double")
    spread = f"{v.MAD_SCALE} * mad * {k}"
    bounds = quartiles.join(F.broadcast(mads), "feature", "left").selectExpr(
        "feature",
        f"CASE WHEN q3 > q1 THEN 'IQR ({k}x)' WHEN mad > 0 THEN 'MAD ({k}x, IQR was zero)' "
        "ELSE 'deviation from the modal value (IQR and MAD both zero)' END AS method",
        f"CASE WHEN q3 > q1 THEN q1 - {k} * (q3 - q1) WHEN mad > 0 THEN median - {spread} ELSE median END AS lower_bound",
        f"CASE WHEN q3 > q1 THEN q3 + {k} * (q3 - q1) WHEN mad > 0 THEN median + {spread} ELSE median END AS upper_bound",
    )
    skew, _ = bias_corrected("n_values", "g1", "0D")
    return agg(long.join(F.broadcast(bounds), "feature"), {
        "method": "first(method)", "lower_bound": "first(lower_bound)", "upper_bound": "first(upper_bound)",
        "n_values": "count(*)", "n_below": "count_if(value < lower_bound)", "n_above": "count_if(value > upper_bound)",
        "min_value": "min(value)", "max_value": "max(value)", "total": "sum(abs(value))",
        "tail": "coalesce(sum(IF(value > upper_bound, abs(value), NULL)), 0D)", "g1": "skewness(value)",
    }, ["feature"]).filter("n_values >= 4 AND max_value > min_value").selectExpr(
        "feature AS column", "n_values", "method", "lower_bound", "upper_bound", "n_below", "n_above",
        "n_below + n_above AS n_outliers", "(n_below + n_above) / n_values * 100 AS outlier_pct", "max_value",
        "IF(total > 0, tail / total * 100, 0D) AS share_of_total_in_tail_pct", f"{skew} AS skewness",
    ).orderBy(F.desc("outlier_pct"), "column")


# ------------------------------------------------------- portfolio tables

def delinquency_persistence(df: DataFrame) -> DataFrame:
    """Clients by number of delinquent months, 0 to 6, with shares."""
    counted = agg(df.filter("delinquent_months_count IS NOT NULL"), {"clients": "count(*)"}, ["delinquent_months_count"])
    whole = agg(counted, {"total": "sum(clients)"})
    months = df.sparkSession.range(0, v.PANEL_MONTHS + 1).withColumnRenamed("id", "delinquent_months_count")
    return months.join(F.broadcast(counted), "delinquent_months_count", "left").transform(beside, whole).selectExpr(
        "delinquent_months_count AS months", "coalesce(clients, 0L) AS clients",
        "coalesce(clients, 0L) / total * 100 AS share_pct",
    )


def zero_payment_months(df: DataFrame, target: str = v.TARGET, min_size: int = 30) -> DataFrame:
    whole = agg(df, {"total": "count(*)"})
    return agg(df.filter("months_zero_payment IS NOT NULL"), {
        "clients": "count(*)", "rate_pct": f"avg({s.value(df, target)}) * 100"
    }, ["months_zero_payment"]).filter(F.col("clients") >= min_size).transform(beside, whole).selectExpr(
        "months_zero_payment", "clients", "clients / total * 100 AS share_pct", "rate_pct"
    )


def payment_segments(df: DataFrame, target: str = v.TARGET, min_size: int = 30) -> DataFrame:
    """Full payers, partial payers and revolvers compared on observed behaviour."""
    segment = "CASE WHEN is_full_payer THEN 'Full payers' WHEN is_revolver THEN 'Revolvers' ELSE 'Partial payers' END"
    share = lambda c: f"avg(int(coalesce({c}, false))) * 100"
    return agg(s.project(df, {"segment": segment}), {
        "clients": "count(*)", "default_rate_pct": f"avg({s.value(df, target)}) * 100",
        "currently_behind_pct": share("is_currently_delinquent"),
        "high_utilisation_pct": share("is_high_utilisation"), "over_limit_pct": share("is_over_limit"),
    }, ["segment"]).filter(F.col("clients") >= min_size)


def status_reference(spark) -> DataFrame:
    rows = [Row(k, x, k not in v.PAY_STATUS_UNDOCUMENTED) for k, x in v.PAY_STATUS_LABELS.items()]
    return spark.createDataFrame(rows, "code int, meaning string, documented boolean")


def bounded_sample(df: DataFrame, rows: int = 5_000, seed: int = DEFAULTS.seed, key: str = v.ID) -> DataFrame:
    """At most ``rows`` rows, repeatable for a seed; every row carries how many were available."""
    whole = agg(df, {"available_rows": "count(*)"})
    chosen = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(rows)
    return chosen.transform(beside, whole).withColumn("is_sampled", F.col("available_rows") > rows)


def exploratory_bundle(df: DataFrame, categories: Sequence[str], target: str = v.TARGET) -> dict[str, DataFrame]:
    """The standard exploration of one selection, as named lazy tables."""
    from ledgerlens.operators.correlation import correlation_pairs

    out = {"summary": numeric_summary(df), "outliers": outlier_analysis(df), "correlation": correlation_pairs(df)}
    for c in categories:
        if c in df.columns:
            out[f"frequency:{c}"] = frequency(df, c)
            if target in df.columns:
                out[f"outcome:{c}"] = outcome_rates(df, c, target)
    return out
