"""Queries on profiling, quality, exploration and association statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import clean, feats, long, raw, rounded, table
from catalog.oracle import M, R, Rs, UTIL_BAND, each, melted, on_clients, on_features
from catalog.registry import query
from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg
from ledgerlens.operators import correlation, drivers, eda, profile, quality, ranking
from ledgerlens.operators.features import utilisation_band
from ledgerlens.operators.quantiles import melt, quantile_table, quantiles_long

T = v.TARGET
RAW = ["client_id", "credit_limit", "sex_code", "education_code", "marriage_code", "age",
       *[f"{p}_m{k}" for p in ("pay_status", "bill_amt", "pay_amt") for k in M], T]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUM = ["credit_limit", "age", "bill_amt_m1", "utilisation_latest", "repayment_ratio_median", "delinquent_months_count",
       "months_zero_payment", "balance_growth_6m"]


# ------------------------------------------------------- contract and profile

@query("contract_checks", on_clients(f"""SELECT * FROM (VALUES ('has_rows', true, CAST(0 AS BIGINT)), ('has_columns', true, 0), ('column_names_unique', true, 0),
    ('row_count', (SELECT count(*) = 30000 FROM clients), (SELECT count(*) FROM clients)), ('column_count', true, 25), ('target_present', true, 0),
    ('target_binary', true, 0), ('target_two_classes', (SELECT count(DISTINCT {T}) = 2 FROM clients), 0),
    ('id_unique', (SELECT count(*) = count(DISTINCT client_id) FROM clients), (SELECT count(*) - count(DISTINCT client_id) FROM clients)),
    ('credit_limit_present', true, 0), ('age_present', true, 0), ('bill_amt_m_complete', true, 6), ('pay_amt_m_complete', true, 6),
    ('pay_status_m_complete', true, 6), ('age_plausible', (SELECT count(*) FILTER (WHERE age < 18 OR age > 100) = 0 FROM clients),
      (SELECT count(*) FILTER (WHERE age < 18 OR age > 100) FROM clients)),
    ('limit_positive', (SELECT count(*) FILTER (WHERE credit_limit <= 0) = 0 FROM clients), (SELECT count(*) FILTER (WHERE credit_limit <= 0) FROM clients)))
    AS t("check", passed, affected)"""))
def _(spark, d):
    return profile.validate(raw(spark, d)).select("check", "passed", "affected")


def profile_sql(source: str, columns, kind=lambda c: "numeric") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind(c)}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS missing, "
        f"{R(f'(count(*) - count({c})) / count(*) * 100', 'missing_pct')}, count(DISTINCT {c}) AS distinct_values, "
        f"count(DISTINCT {c}) = 1 AS is_constant, count({c}) = 0 AS is_empty FROM {source}" for c in columns)


@query("column_profile_clients", on_clients(profile_sql("clients", RAW)))
def _(spark, d):
    return rounded(profile.column_profile(raw(spark, d)))


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]
KIND = lambda c: "datetime" if c == "l_shipdate" else "categorical" if c in ("l_returnflag", "l_linestatus") else "numeric"


@query("column_profile_lineitem", profile_sql("lineitem", LINEITEM, KIND))
def _(spark, d):
    return rounded(profile.column_profile(table(spark, d, "lineitem").select(*LINEITEM)))


@query("table_overview", on_clients(f"""SELECT count(*) AS n_rows, 25 AS n_columns, 25 AS numeric_columns, 0 AS categorical_columns,
    0 AS datetime_columns, 0 AS boolean_columns, {' + '.join(f'(count(*) - count({c}))' for c in RAW)} AS missing_cells,
    count(*) * 25 AS total_cells, CAST(0 AS BIGINT) AS exact_duplicates, CAST(0 AS BIGINT) AS duplicates_without_id FROM clients"""))
def _(spark, d):
    return profile.overview(raw(spark, d))


@query("missing_report", on_clients(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {R(f'(count(*) - count({c})) / count(*) * 100', 'missing_pct')}, "
    f"count({c}) = 0 AS fully_missing, {' + '.join(f'(count(*) - count({x}))' for x in RAW)} AS missing_cells, count(*) * 25 AS total_cells FROM clients"
    for c in RAW)))
def _(spark, d):
    return rounded(profile.missing_report(raw(spark, d)))


@query("column_catalogue", on_features(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS missing, "
    f"CAST(arg_min({c}, client_id) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR) AS example FROM feat"
    for c in ("age", "education", "sex_code", "limit_band", "delinquency_trend", "is_revolver", "months_zero_payment"))))
def _(spark, d):
    picked = ["client_id", "age", "education", "sex_code", "limit_band", "delinquency_trend", "is_revolver", "months_zero_payment"]
    return profile.column_catalogue(feats(spark, d).select(*picked)).filter(F.col("column") != "client_id").select(
        "column", "distinct_values", "missing", "example")


# --------------------------------------------------------------------- quality

CODE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS code, count(*) AS n, CASE WHEN {c} IN ({', '.join(map(str, ok))}) THEN "
    f"{('CASE WHEN ' + c + ' IN (' + ', '.join(map(str, odd)) + ') THEN ' + chr(39) + 'undocumented' + chr(39) + ' ELSE ' + chr(39) + 'documented' + chr(39) + ' END') if odd else chr(39) + 'documented' + chr(39)} "
    f"ELSE 'unknown' END AS kind FROM clients GROUP BY {c}"
    for c, ok, odd in [("sex_code", (1, 2), ()), ("education_code", range(7), (0, 5, 6)), ("marriage_code", range(4), (0,)),
                       *[(f"pay_status_m{k}", range(-2, 10), (-2, 0)) for k in M]])


@query("code_counts", on_clients(CODE_SQL))
def _(spark, d):
    return quality.code_counts(raw(spark, d))


PAID = {m: f"(pay_status_m{m} = -1 AND pay_amt_m{m} = 0 AND coalesce(bill_amt_m{m + 1} > 0, false))" for m in M[:5]}
LATE = {m: f"(pay_status_m{m} >= 1 AND coalesce(bill_amt_m{m} <= 0, false))" for m in M}
OVER = "(" + each("coalesce(bill_amt_m{k} > credit_limit, false)", sep=" OR ") + ")"
COUNT = "count(*) FILTER (WHERE {})"


@query("consistency_checks", on_clients(f"""SELECT 'status_payment_contradiction' AS "check", 'medium' AS severity,
      {COUNT.format(' OR '.join(PAID.values()))} AS affected_rows, {' + '.join(COUNT.format(e) for e in PAID.values())} AS records FROM clients
    UNION ALL SELECT 'delinquent_without_balance', 'medium', {COUNT.format(' OR '.join(LATE.values()))}, {' + '.join(COUNT.format(e) for e in LATE.values())} FROM clients
    UNION ALL SELECT 'negative_statement_balance', 'info', greatest({', '.join(COUNT.format(f'bill_amt_m{k} < 0') for k in M)}), {' + '.join(COUNT.format(f'bill_amt_m{k} < 0') for k in M)} FROM clients
    UNION ALL SELECT 'over_limit_balance', 'info', {COUNT.format(OVER)}, {COUNT.format(OVER)} FROM clients
    UNION ALL SELECT 'any_contradiction', 'info', {COUNT.format(' OR '.join([*PAID.values(), *LATE.values()]))}, {COUNT.format(' OR '.join([*PAID.values(), *LATE.values()]))} FROM clients"""))
def _(spark, d):
    return quality.consistency(raw(spark, d)).drop("by_month")


@query("consistency_by_month", on_clients(" UNION ALL ".join(
    f"SELECT '{month}' AS month, {COUNT.format(PAID[k])} AS clients FROM clients"
    for k, month in list(v.MONTH_LABELS.items())[:5])))
def _(spark, d):
    rows = quality.consistency(raw(spark, d)).filter("check = 'status_payment_contradiction'")
    return rows.select(F.explode("by_month").alias("month", "clients"))


def outlier_sql(source: str, columns) -> str:
    return f"""WITH m AS ({melted(source, columns, key='1 AS one')}),
      q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS c, stddev_pop(value) AS sd
            FROM m GROUP BY feature HAVING count(DISTINCT value) > 2)
      SELECT feature AS "column", count(*) AS n_valid, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
        count(*) FILTER (WHERE abs((value - c) / sd) > 3) AS zscore_outliers, {R('first(q1 - 1.5 * (q3 - q1))', 'lower_bound', 3)},
        {R('first(q3 + 1.5 * (q3 - q1))', 'upper_bound', 3)}, {R('skewness(value)', 'skewness')} FROM m JOIN q USING (feature) GROUP BY feature"""


@query("outlier_report_clients", on_clients("SELECT * FROM (" + outlier_sql("clients", [c for c in RAW if c not in ("client_id", T)]) + ")"))
def _(spark, d):
    out = quality.outliers(raw(spark, d)).drop("min_value", "max_value")
    return rounded(out, 3, skewness=6)


@query("outlier_report_lineitem", outlier_sql("lineitem", LINE))
def _(spark, d):
    return rounded(quality.outliers(table(spark, d, "lineitem"), LINE).drop("min_value", "max_value"), 3, skewness=6)


INVALID = ("count(*) FILTER (WHERE sex_code NOT IN (1, 2)) + count(*) FILTER (WHERE education_code NOT IN (1, 2, 3, 4)) + "
           "count(*) FILTER (WHERE marriage_code NOT IN (1, 2, 3)) + count(*) FILTER (WHERE age < 18 OR age > 100) + "
           "count(*) FILTER (WHERE credit_limit <= 0)")
MISSING = " + ".join(f"(count(*) - count({c}))" for c in RAW)


@query("quality_score", on_clients(f"""SELECT completeness, validity, consistency, 1.0 AS uniqueness, invalid_cells, cells_checked,
      {R('30 * comp + 20 + 35 * val + 15 * con', 'score')}, 'Excellent' AS band FROM (SELECT *, {R('comp', 'completeness')}, {R('val', 'validity')}, {R('con', 'consistency')} FROM
      (SELECT 1 - ({MISSING}) / (count(*) * 25) AS comp, {INVALID} AS invalid_cells, count(*) * 12 AS cells_checked,
       1 - ({INVALID}) / (count(*) * 12) AS val, 1 - {COUNT.format(' OR '.join([*PAID.values(), *LATE.values()]))} / count(*) AS con FROM clients))"""
       .replace("1.0 AS uniqueness", "CAST(1 AS DOUBLE) AS uniqueness")))
def _(spark, d):
    return rounded(quality.quality_score(raw(spark, d)).select(
        "completeness", "validity", "consistency", "uniqueness", "invalid_cells", "cells_checked", "score", "band"))


ODD = "(" + each("pay_status_m{k} IN (-2, 0)", sep=" OR ") + ")"
ISSUE_SQL = f"""SELECT 'value_out_of_range' AS "check", 'high' AS severity, 'credit_limit' AS "column", {COUNT.format('credit_limit <= 0')} AS affected_rows FROM clients
    UNION ALL SELECT 'undocumented_category_code', 'medium', 'education_code', {COUNT.format('education_code IN (0, 5, 6)')} FROM clients
    UNION ALL SELECT 'undocumented_category_code', 'medium', 'marriage_code', {COUNT.format('marriage_code = 0')} FROM clients
    UNION ALL SELECT 'undocumented_category_code', 'low', NULL, {COUNT.format(ODD)} FROM clients
    UNION ALL SELECT 'status_payment_contradiction', 'medium', NULL, {COUNT.format(' OR '.join(PAID.values()))} FROM clients
    UNION ALL SELECT 'delinquent_without_balance', 'medium', NULL, {COUNT.format(' OR '.join(LATE.values()))} FROM clients
    UNION ALL SELECT 'over_limit_balance', 'info', NULL, {COUNT.format(OVER)} FROM clients
    UNION ALL SELECT 'value_out_of_range', 'medium', 'age', {COUNT.format('age < 18 OR age > 100')} FROM clients"""


@query("quality_issues", on_clients(f"SELECT * FROM ({ISSUE_SQL}) WHERE affected_rows > 0"))
def _(spark, d):
    return quality.issues(raw(spark, d)).select("check", "severity", "column", "affected_rows")


@query("quality_issue_counts", on_clients(f"""SELECT severity, count("check") AS issues FROM (VALUES ('high'), ('medium'), ('low'), ('info')) AS t(severity)
    LEFT JOIN (SELECT * FROM ({ISSUE_SQL}) WHERE affected_rows > 0) USING (severity) GROUP BY severity"""))
def _(spark, d):
    return quality.issue_counts(quality.issues(raw(spark, d)))


@query("dtype_issues", on_clients("SELECT 'unexpected_dtype' AS \"check\", 'high' AS severity, 'age' AS \"column\", count(*) FILTER (WHERE client_id % 5 = 0) AS affected_rows, "
       "count(*) FILTER (WHERE client_id % 5 = 0) AS records FROM clients UNION ALL SELECT 'unexpected_dtype', 'medium', 'credit_limit', count(*), 0 FROM clients"))
def _(spark, d):
    dirty = s.project(raw(spark, d), {"age": "IF(client_id % 5 = 0, '1,000', string(age))", "credit_limit": "string(credit_limit)"})
    return quality.dtype_issues(dirty)


@query("constant_column_issues", "SELECT 'constant_column' AS \"check\", 'low' AS severity, 'tag' AS \"column\", count(*) AS affected_rows, count(*) AS records FROM orders "
       "UNION ALL SELECT 'empty_column', 'high', 'blank', count(*), count(*) FROM orders")
def _(spark, d):
    return quality.constant_issues(table(spark, d, "orders").selectExpr("o_orderkey", "'x' AS tag", "string(null) AS blank"))


# ------------------------------------------------------------------ univariate

def summary_sql(source: str, columns) -> str:
    parts = {"mean": "avg({c})", "median": "median({c})", "std": "stddev_samp({c})", "min": "min({c})", "q1": "quantile_cont({c}, 0.25)",
             "q3": "quantile_cont({c}, 0.75)", "max": "max({c})", "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
             "skewness": "skewness({c})", "kurtosis": "kurtosis({c})"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, "
        + ", ".join(R(e.format(c=c), f'"{n}"', 4) for n, e in parts.items()) + f" FROM {source}" for c in columns)


SUMMARY = ["column", "count", "missing", "mean", "median", "std", "min", "q1", "q3", "max", "iqr", "skewness", "kurtosis"]


@query("numeric_summary_clients", on_features(summary_sql("feat", NUM)))
def _(spark, d):
    return rounded(eda.numeric_summary(feats(spark, d), NUM).select(*SUMMARY), 4)


@query("numeric_summary_lineitem", summary_sql("lineitem", LINE))
def _(spark, d):
    return rounded(eda.numeric_summary(table(spark, d, "lineitem"), LINE).select(*SUMMARY), 4)


@query("bracketed_quantiles", """SELECT l_returnflag, p AS prob, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) + 0.0 AS quantile FROM lineitem, (SELECT 0.25 AS p) GROUP BY ALL
    UNION ALL SELECT l_returnflag, 0.5, count(l_extendedprice), round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_returnflag, 0.995, count(l_extendedprice), round(quantile_cont(l_extendedprice, 0.995), 4) + 0.0 FROM lineitem GROUP BY ALL"""
       .replace("p AS prob", "CAST(p AS DOUBLE) AS prob").replace("0.5, count", "CAST(0.5 AS DOUBLE), count").replace("0.995, count", "CAST(0.995 AS DOUBLE), count"))
def _(spark, d):
    """Grouped quantiles by selection on digits."""
    lines = melt(table(spark, d, "lineitem"), ["l_extendedprice"], by=["l_returnflag"])
    out = quantiles_long(lines, ["l_returnflag"], (0.25, 0.5, 0.995))
    return rounded(out, 4, prob=6)


@query("frequency_priority", """WITH c AS (SELECT o_orderpriority AS category, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
    SELECT category, count, round(count / sum(count) OVER () * 100, 6) + 0.0 AS percentage FROM c""")
def _(spark, d):
    return rounded(eda.frequency(table(spark, d, "orders"), "o_orderpriority", top_n=3))


@query("frequency_education", on_features("SELECT education AS category, count(*) AS count, round(count(*) / (SELECT count(*) FROM feat) * 100, 6) + 0.0 AS percentage FROM feat GROUP BY 1"))
def _(spark, d):
    return rounded(eda.frequency(feats(spark, d), "education"))


def histogram_sql(source: str, column: str, bins: int, where: str = "true") -> str:
    return f"""WITH e AS (SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS n FROM {source} WHERE {where}),
      b AS (SELECT least(CAST(floor(({column} - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) AS bin, count(*) AS k FROM {source}, e
            WHERE {column} IS NOT NULL AND {where} GROUP BY 1)
      SELECT i AS bin, {R(f'lo + (i - 1) * (hi - lo) / {bins}', 'bin_left', 4)}, {R(f'lo + i * (hi - lo) / {bins}', 'bin_right', 4)},
        {R(f'lo + (i - 0.5) * (hi - lo) / {bins}', 'bin_center', 4)}, coalesce(k, 0) AS count, {R('coalesce(k, 0) / n * 100', 'percentage')}
      FROM range(1, {bins + 1}) AS t(i) CROSS JOIN e LEFT JOIN b ON bin = i"""


@query("histogram_price", histogram_sql("lineitem", "l_extendedprice", 30))
def _(spark, d):
    return rounded(eda.histogram(table(spark, d, "lineitem"), "l_extendedprice"), 4, percentage=6)


@query("histogram_utilisation_trimmed", on_features("SELECT *, (SELECT round(median(utilisation_latest), 4) + 0.0 FROM feat) AS untrimmed_median FROM ("
       + histogram_sql("feat", "utilisation_latest", 40, "utilisation_latest <= (SELECT quantile_cont(utilisation_latest, 0.995) FROM feat)") + ")"))
def _(spark, d):
    return rounded(eda.trimmed_histogram(feats(spark, d), "utilisation_latest"), 4, percentage=6)


@query("histogram_refused", "SELECT 'Distribution of ''same''' AS analysis, count(*) AS n_rows, CAST(2 AS BIGINT) AS required_rows, 'All values are identical.' AS reason FROM orders")
def _(spark, d):
    return eda.histogram(table(spark, d, "orders").selectExpr("1.5D AS same"), "same")


@query("analysis_refusals", """SELECT 'Pearson correlation analysis' AS analysis, count(*) AS n_rows, CAST(30 AS BIGINT) AS required_rows, 'Correlations of very few rows are unstable.' AS reason FROM nation
    UNION ALL SELECT 'Frequency analysis of ''absent''', CAST(count(*) > 0 AS BIGINT), 1, 'Missing column(s): absent.' FROM region
    UNION ALL SELECT 'Comparison of ''n_name'' by ''n_regionkey''', count(*), 1, 'No row has both values.' FROM nation WHERE n_regionkey < 0
    UNION ALL SELECT 'Outcome rates by ''n_name''', CAST(count(*) > 0 AS BIGINT), 1, 'Missing column(s): absent.' FROM nation
    UNION ALL SELECT 'Cross-tabulation of ''n_name'' by ''n_regionkey''', count(*), 1, 'No row has all values.' FROM nation WHERE n_regionkey < 0""")
def _(spark, d):
    nation = table(spark, d, "nation")
    none = nation.filter("n_regionkey < 0")
    rows = [correlation.correlation_pairs(nation, method="pearson"), eda.frequency(table(spark, d, "region"), "absent"),
            eda.compare_groups(none, "n_regionkey", "n_name"), eda.outcome_rates(nation, "n_name", "absent"), eda.cross_tab(none, "n_name", "n_regionkey")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ------------------------------------------------------------------- bivariate

@query("group_comparison", on_features(f"""WITH g AS (SELECT education, count(credit_limit) AS count, avg(credit_limit) AS mean, median(credit_limit) AS median,
    stddev_samp(credit_limit) AS std, min(credit_limit) AS min, max(credit_limit) AS max FROM feat WHERE credit_limit IS NOT NULL GROUP BY 1)
    SELECT education, count, {Rs(['mean', 'median', 'std', 'min', 'max'], 4)}, {R('(SELECT avg(credit_limit) FROM feat)', 'overall_mean', 4)},
    {R('(SELECT median(credit_limit) FROM feat)', 'overall_median', 4)}, {R('(SELECT max(mean) / min(mean) FROM g)', 'spread_ratio')} FROM g WHERE count >= 5""")
       .replace("WITH g AS (SELECT education", "SELECT * FROM (WITH g AS (SELECT education") + ")")
def _(spark, d):
    return rounded(eda.compare_groups(feats(spark, d), "education", "credit_limit"), 4, spread_ratio=6)


@query("group_comparison_orders", f"""WITH g AS (SELECT o_orderpriority, count(*) AS count, avg(o_totalprice) AS mean, median(o_totalprice) AS median,
    stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1)
    SELECT o_orderpriority, count, {Rs(['mean', 'median', 'std', 'min', 'max'], 4)}, {R('(SELECT avg(o_totalprice) FROM orders)', 'overall_mean', 4)},
    {R('(SELECT median(o_totalprice) FROM orders)', 'overall_median', 4)}, {R('(SELECT max(mean) / min(mean) FROM g)', 'spread_ratio')} FROM g WHERE count >= 5""")
def _(spark, d):
    return rounded(eda.compare_groups(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4, spread_ratio=6)


def rates_sql(column: str, alias: str | None = None) -> str:
    return f"""SELECT {column} AS {alias or column}, count(*) AS count, CAST(sum({T}) AS BIGINT) AS events, {R(f'avg({T}) * 100', 'rate_pct')},
      {R(f'avg({T}) * 100 - (SELECT avg({T}) * 100 FROM feat WHERE {column} IS NOT NULL)', 'lift_vs_overall_pp')}, count(*) >= 30 AS meets_min_size,
      {R(f'(SELECT avg({T}) * 100 FROM feat WHERE {column} IS NOT NULL)', 'overall_rate_pct')} FROM feat WHERE {column} IS NOT NULL GROUP BY {column}"""


@query("outcome_by_age_band", on_features(rates_sql("age_band")))
def _(spark, d):
    return rounded(eda.outcome_rates(feats(spark, d), "age_band"))


@query("outcome_by_utilisation_band", on_features(rates_sql(UTIL_BAND, "band")))
def _(spark, d):
    return rounded(eda.outcome_rates(s.project(feats(spark, d), {"band": utilisation_band("utilisation_latest")[0]}), "band"))


@query("outcome_extremes", on_features(f"""SELECT arg_max(age_band, rate_pct) AS highest_category, arg_min(age_band, rate_pct) AS lowest_category,
    {R('max(rate_pct) - min(rate_pct)', 'rate_spread_pp')} FROM (SELECT age_band, avg({T}) * 100 AS rate_pct FROM feat GROUP BY 1 HAVING count(*) >= 30)"""))
def _(spark, d):
    return rounded(eda.outcome_extremes(eda.outcome_rates(feats(spark, d), "age_band"), "age_band"))


@query("band_metric", on_features(f"SELECT limit_band, count(*) AS n_clients, {R('avg(utilisation_latest)', 'utilisation_latest')}, "
       f"{R(f'avg({T}) * 100', 'default_next_month_rate_pct')}, {R('count(*) / (SELECT count(*) FROM feat) * 100', 'share_of_portfolio_pct')} "
       "FROM feat WHERE limit_band IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return rounded(eda.group_profile(feats(spark, d), "limit_band", ["utilisation_latest"], T))


def by_outcome_sql(columns) -> str:
    one, zero = f"FILTER (WHERE {T} = 1)", f"FILTER (WHERE {T} = 0)"
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, 'ok' AS status, count({c}) {one} AS n_positive, count({c}) {zero} AS n_negative,
      {R(f'avg({c}) {one}', 'mean_positive', 4)}, {R(f'avg({c}) {zero}', 'mean_negative', 4)}, {R(f'median({c}) {one}', 'median_positive', 4)},
      {R(f'median({c}) {zero}', 'median_negative', 4)}, {R(f'avg({c}) {one} - avg({c}) {zero}', 'difference', 4)},
      {R(f'(avg({c}) {one} - avg({c}) {zero}) / abs(avg({c}) {zero}) * 100', 'relative_difference_pct', 4)},
      {R(f'(avg({c}) {one} - avg({c}) {zero}) / sqrt(((count({c}) {one} - 1) * var_samp({c}) {one} + (count({c}) {zero} - 1) * var_samp({c}) {zero}) / (count({c}) - 2))', 'cohens_d')}
      FROM feat""" for c in columns)


@query("numeric_by_outcome", on_features(by_outcome_sql(NUM)))
def _(spark, d):
    return rounded(eda.numeric_by_outcome(feats(spark, d), NUM).drop("effect_size_label"), 4, cohens_d=6)


@query("cross_tab_counts", on_features("SELECT e.education, a.age_band, count(client_id) AS value FROM (SELECT DISTINCT education FROM feat) e "
       "CROSS JOIN (SELECT DISTINCT age_band FROM feat) a LEFT JOIN feat ON feat.education = e.education AND feat.age_band = a.age_band GROUP BY ALL"))
def _(spark, d):
    return eda.cross_tab(feats(spark, d), "education", "age_band")


@query("cross_tab_mean", on_features(f"SELECT education, limit_band, {R(f'avg({T})', 'value')} FROM feat WHERE limit_band IS NOT NULL GROUP BY ALL"))
def _(spark, d):
    return rounded(eda.cross_tab(feats(spark, d), "education", "limit_band", T))


@query("cross_tab_wide", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", "
       "count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(spark, d):
    return eda.pivoted(eda.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")


@query("row_composition", on_features(f"""SELECT education, delinquency_trend, count(*) AS value, {R('count(*) / sum(count(*)) OVER (PARTITION BY education) * 100', 'row_pct')}
    FROM feat GROUP BY education, delinquency_trend"""))
def _(spark, d):
    return rounded(eda.row_composition(eda.cross_tab(feats(spark, d), "education", "delinquency_trend"), "education"))


@query("box_statistics", f"""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3
    FROM orders GROUP BY 1) SELECT o_orderpriority, count(*) AS count, {R('avg(o_totalprice)', 'mean', 4)}, {R('first(q1)', 'q1', 4)}, {R('first(med)', 'median', 4)},
    {R('first(q3)', 'q3', 4)}, {R('min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1))', 'whisker_low', 4)},
    {R('max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 1.5 * (q3 - q1))', 'whisker_high', 4)},
    count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM orders JOIN q USING (o_orderpriority) GROUP BY 1""")
def _(spark, d):
    return rounded(eda.box_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


OUT_COLUMNS = ["credit_limit", "bill_amt_m1", "utilisation_latest", "months_zero_payment", "rare"]


@query("outlier_analysis", on_features(f"""SELECT * FROM (WITH m AS ({melted('(SELECT *, CASE WHEN client_id % 50 = 0 THEN client_id ELSE 7 END AS rare FROM feat)', OUT_COLUMNS)}),
    q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY 1),
    d AS (SELECT feature, median(abs(value - med)) AS mad FROM m JOIN q USING (feature) GROUP BY 1),
    b AS (SELECT feature, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) WHEN mad > 0 THEN med - 1.4826 * mad * 1.5 ELSE med END AS lo,
      CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) WHEN mad > 0 THEN med + 1.4826 * mad * 1.5 ELSE med END AS hi FROM q JOIN d USING (feature))
    SELECT feature AS "column", count(*) AS n_values, {R('first(lo)', 'lower_bound', 3)}, {R('first(hi)', 'upper_bound', 3)}, count(*) FILTER (WHERE value < lo) AS n_below,
    count(*) FILTER (WHERE value > hi) AS n_above, {R('count(*) FILTER (WHERE value < lo OR value > hi) / count(*) * 100', 'outlier_pct')},
    {R('coalesce(sum(abs(value)) FILTER (WHERE value > hi), 0) / sum(abs(value)) * 100', 'share_of_total_in_tail_pct', 4)}, {R('skewness(value)', 'skewness', 4)}
    FROM m JOIN b USING (feature) GROUP BY 1)"""))
def _(spark, d):
    f = s.project(feats(spark, d), {"rare": "IF(client_id % 50 = 0, client_id, 7L)"})
    out = eda.outlier_analysis(f, OUT_COLUMNS).drop("method", "n_outliers", "max_value")
    return rounded(out, 4, lower_bound=3, upper_bound=3, outlier_pct=6)


@query("delinquency_persistence", on_features(f"""SELECT i AS months, count(client_id) AS clients, {R('count(client_id) / (SELECT count(*) FROM feat) * 100', 'share_pct')}
    FROM range(0, 7) AS t(i) LEFT JOIN feat ON delinquent_months_count = i GROUP BY 1"""))
def _(spark, d):
    return rounded(eda.delinquency_persistence(feats(spark, d)))


@query("zero_payment_months", on_features(f"""SELECT months_zero_payment, count(*) AS clients, {R('count(*) / (SELECT count(*) FROM feat) * 100', 'share_pct')},
    {R(f'avg({T}) * 100', 'rate_pct')} FROM feat GROUP BY 1 HAVING count(*) >= 30"""))
def _(spark, d):
    return rounded(eda.zero_payment_months(feats(spark, d)))


SHARE = "avg(CAST({} AS INTEGER)) * 100"


@query("payment_segments", on_features(f"""SELECT CASE WHEN is_full_payer THEN 'Full payers' WHEN is_revolver THEN 'Revolvers' ELSE 'Partial payers' END AS segment,
    count(*) AS clients, {R(f'avg({T}) * 100', 'default_rate_pct')}, {R(SHARE.format('is_currently_delinquent'), 'currently_behind_pct')},
    {R(SHARE.format('is_high_utilisation'), 'high_utilisation_pct')}, {R(SHARE.format('is_over_limit'), 'over_limit_pct')} FROM feat GROUP BY 1 HAVING count(*) >= 30"""))
def _(spark, d):
    return rounded(eda.payment_segments(feats(spark, d)))


@query("bounded_sample", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS available_rows, (SELECT count(*) > 1000 FROM orders) AS is_sampled
    FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000""")
def _(spark, d):
    return eda.bounded_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1_000, key="o_orderkey")


@query("complete_cases", on_features("SELECT client_id FROM feat WHERE utilisation_latest IS NOT NULL AND repayment_ratio_m1 IS NOT NULL"))
def _(spark, d):
    return correlation.complete_rows(feats(spark, d), ["utilisation_latest", "repayment_ratio_m1"]).select("client_id")


# ---------------------------------------------------------------- correlations

def pair_sql(columns, value, source="feat", ctes="") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {R(value(a, b), 'correlation')}, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in combinations(columns, 2))


CORR = ["credit_limit", "age", "bill_amt_m1", "utilisation_latest", "repayment_ratio_median", "max_delinquency"]


@query("pearson_pairs", on_features(pair_sql(CORR, lambda a, b: f"corr({a}, {b})")))
def _(spark, d):
    return rounded(correlation.correlation_pairs(feats(spark, d), CORR, "pearson").select("left", "right", "correlation", "n"))


@query("pearson_lineitem", pair_sql(LINE, lambda a, b: f"corr({a}, {b})", "lineitem"))
def _(spark, d):
    return rounded(correlation.correlation_pairs(table(spark, d, "lineitem"), LINE, "pearson").select("left", "right", "correlation", "n"))


AVG_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def spearman_sql(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {R('corr(x, y)', 'correlation')}, count(*) AS n FROM "
        f"(SELECT {AVG_RANK.format(c=a)} AS x, {AVG_RANK.format(c=b)} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in combinations(columns, 2))


@query("spearman_pairs", on_features(spearman_sql(CORR, "feat")))
def spearman(spark, d):
    return rounded(correlation.correlation_pairs(feats(spark, d), CORR).select("left", "right", "correlation", "n"))


O_COLUMNS = ["o_totalprice", "o_month", "o_bucket"]
O_SQL = "(SELECT o_orderkey, o_totalprice, month(o_orderdate) AS o_month, o_custkey % 100 AS o_bucket FROM orders)"


@query("spearman_orders", spearman_sql(O_COLUMNS, O_SQL))
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", "month(o_orderdate) AS o_month", "o_custkey % 100 AS o_bucket")
    out = correlation.correlation_pairs(o, O_COLUMNS, key=("o_orderkey",))
    return rounded(out.select("left", "right", "correlation", "n"))


KENDALL = ["age", "max_delinquency", "months_zero_payment"]


@query("kendall_pairs", on_features(" UNION ALL ".join(
    f"""SELECT '{a}' AS "left", '{b}' AS "right", {R(f'sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / sqrt(sum(abs(sign(p.{a} - q.{a}))) * sum(abs(sign(p.{b} - q.{b}))))', 'correlation')},
    (SELECT count(*) FROM feat) AS n FROM feat p CROSS JOIN feat q""" for a, b in combinations(KENDALL, 2))))
def _(spark, d):
    return rounded(correlation.correlation_pairs(feats(spark, d), KENDALL, "kendall").select("left", "right", "correlation", "n"))


@query("average_ranks", "SELECT o_orderkey, CAST(" + AVG_RANK.format(c="floor(o_totalprice / 1000)") + " AS DOUBLE) AS rank FROM orders")
def _(spark, d):
    values = table(spark, d, "orders").selectExpr("o_orderkey", "'x' AS feature", "double(floor(o_totalprice / 1000)) AS value")
    return ranking.attach_ranks(values, ["feature"]).selectExpr("o_orderkey", "double(rank) AS rank")


@query("average_ranks_sliced", "SELECT DISTINCT floor(l_extendedprice) AS value, CAST(" + AVG_RANK.format(c="floor(l_extendedprice)") + " AS DOUBLE) AS rank FROM lineitem")
def _(spark, d):
    """The range-partitioned ranks, whatever the size of the input."""
    counts = agg(table(spark, d, "lineitem").selectExpr("'x' AS feature", "double(floor(l_extendedprice)) AS value"), {"rows": "count(*)"},
                 ["feature", "value"])
    return ranking.value_ranks(counts, ["feature"], small=False).selectExpr("value", "double(rank) AS rank")


@query("top_correlations", on_features(f"SELECT * FROM ({spearman_sql(CORR, 'feat')}) WHERE NOT (\"left\" = 'credit_limit' AND \"right\" = 'utilisation_latest') "
       "AND NOT (\"left\" = 'bill_amt_m1' AND \"right\" IN ('utilisation_latest', 'repayment_ratio_median')) ORDER BY abs(correlation) DESC, \"left\", \"right\" LIMIT 5"))
def _(spark, d):
    pairs = correlation.correlation_pairs(feats(spark, d), CORR)
    return rounded(correlation.top_pairs(pairs, 5).select("left", "right", "correlation", "n"))


@query("busiest_columns", on_features(f"""SELECT c AS "column", {R('avg(abs(correlation))', 'mean_abs', 5)} FROM (SELECT "left" AS c, correlation FROM ({spearman_sql(CORR, 'feat')})
    UNION ALL SELECT "right", correlation FROM ({spearman_sql(CORR, 'feat')})) GROUP BY 1 ORDER BY avg(abs(correlation)) DESC, 1 LIMIT 4"""))
def _(spark, d):
    return rounded(correlation.busiest_columns(correlation.correlation_pairs(feats(spark, d), CORR), 4), 5)


# --------------------------------------------------------------------- drivers

DRIVE = ["credit_limit", "age", "bill_amt_m1", "utilisation_latest", "pay_amt_m3", "max_delinquency", "months_zero_payment", "is_revolver"]
LEVELS = ["education", "age_band", "delinquency_trend", "limit_band"]
D_MELT = melted("(SELECT * EXCLUDE (is_revolver), CAST(is_revolver AS INTEGER) AS is_revolver FROM feat)", DRIVE, extra=T)
RANKED = f"""m AS ({D_MELT}), rk AS (SELECT feature, {T} AS y, value, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, rank() OVER (PARTITION BY feature ORDER BY {T})
    + (count(*) OVER (PARTITION BY feature, {T}) - 1) / 2.0 AS ry FROM m)"""
MW = f"""SELECT feature, 'mann_whitney_u' AS method, sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2 AS statistic,
    2 * (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) - 1 AS effect_size,
    count(*) AS n_used FROM rk GROUP BY feature"""
SP = "SELECT feature, 'spearman_correlation' AS method, corr(r, ry) AS statistic, corr(r, ry) AS effect_size, count(*) AS n_used FROM rk GROUP BY feature"
CHI = f"""lv AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS level, {T} AS y FROM feat WHERE {c} IS NOT NULL" for c in LEVELS)}),
    ct AS (SELECT feature, level, count(*) AS n, sum(y) AS e FROM lv GROUP BY ALL),
    tt AS (SELECT feature, sum(n) AS total, sum(e) AS alle, count(*) AS k FROM ct GROUP BY ALL),
    cells AS (SELECT feature, k, total, e AS seen, n * alle / total AS expected FROM ct JOIN tt USING (feature)
      UNION ALL SELECT feature, k, total, n - e, n * (total - alle) / total FROM ct JOIN tt USING (feature))"""
CHI_TEST = """SELECT feature, 'chi_square' AS method, sum((seen - expected) * (seen - expected) / expected) AS statistic,
    sqrt(sum((seen - expected) * (seen - expected) / expected) / first(total)) AS effect_size, CAST(first(total) AS BIGINT) AS n_used FROM cells GROUP BY feature"""
STRENGTH = "CASE WHEN abs(effect_size) >= 0.5 THEN 'strong' WHEN abs(effect_size) >= 0.3 THEN 'moderate' WHEN abs(effect_size) >= 0.1 THEN 'weak' ELSE 'negligible' END"


def evidence_sql(body: str) -> str:
    return f"SELECT feature, method, {R('statistic', 'statistic', 4)}, {R('effect_size', 'effect_size')}, {STRENGTH} AS strength, n_used FROM ({body})"


def evidence(df):
    return rounded(df.select("feature", "method", "statistic", "effect_size", "strength", "n_used"), 6, statistic=4)


@query("outcome_spearman", on_features(evidence_sql(SP), RANKED))
def _(spark, d):
    return evidence(drivers.spearman_with_outcome(drivers.ranked_values(feats(spark, d), T, DRIVE)))


@query("outcome_pearson", on_features(evidence_sql(f"SELECT feature, 'pearson_correlation' AS method, corr(value, {T}) AS statistic, corr(value, {T}) AS effect_size, count(*) AS n_used FROM m GROUP BY feature"), f"m AS ({D_MELT})"))
def _(spark, d):
    return evidence(drivers.pearson_with_outcome(feats(spark, d), T, DRIVE))


@query("mann_whitney", on_features(evidence_sql(MW), RANKED))
def _(spark, d):
    return evidence(drivers.mann_whitney(drivers.ranked_values(feats(spark, d), T, DRIVE)))


@query("class_profiles", on_features(f"""SELECT feature, {', '.join(R(f'{a}(value) FILTER (WHERE {T} = {k})', f'{n}_{w}', 4) for n, a in (('mean', 'avg'), ('median', 'median')) for k, w in ((1, 'positive'), (0, 'negative')))}
    FROM m GROUP BY feature""", f"m AS ({D_MELT})"))
def _(spark, d):
    return rounded(drivers.class_profiles(feats(spark, d), T, DRIVE).select(
        "feature", "mean_positive", "mean_negative", "median_positive", "median_negative"), 4)


@query("chi_square", on_features(f"""SELECT feature, {R('statistic', 'statistic', 4)}, {R('effect_size', 'effect_size')}, n_used, {R('min_expected', 'min_expected', 4)} FROM ({CHI_TEST})
    JOIN (SELECT feature, min(expected) AS min_expected FROM cells GROUP BY 1) USING (feature)""", CHI))
def _(spark, d):
    out = drivers.chi_square(feats(spark, d), T, LEVELS).select("feature", "statistic", "effect_size", "n_used", "min_expected")
    return rounded(out, 4, effect_size=6)


@query("chi_square_two_by_two", f"""WITH t AS (SELECT o_orderstatus = 'F' AS a, o_totalprice > 150000 AS y, count(*) AS n FROM orders GROUP BY ALL),
    x AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS e, sum(n) OVER () AS total FROM t)
    SELECT {R('sum(pow(greatest(abs(n - e) - 0.5, 0), 2) / e)', 'statistic', 4)}, {R('sqrt(sum(pow(greatest(abs(n - e) - 0.5, 0), 2) / e) / first(total))', 'effect_size')} FROM x""")
def _(spark, d):
    two = table(spark, d, "orders").selectExpr("IF(o_orderstatus = 'F', 'yes', 'no') AS finished", "int(o_totalprice > 150000) AS y")
    return rounded(drivers.chi_square(two, "y", ["finished"]).select("statistic", "effect_size"), 4, effect_size=6)


@query("driver_consensus", on_features(f"""SELECT feature, count(*) AS n_methods, count(*) FILTER (WHERE {STRENGTH} <> 'negligible') AS n_methods_non_negligible,
    {R('round(avg(round(abs(effect_size), 6)), 6)', 'mean_effect_size', 4)}, {R('max(abs(effect_size))', 'max_effect_size')},
    CASE WHEN count(*) FILTER (WHERE method <> 'chi_square') = 0 THEN 'n/a' WHEN min(sign(effect_size)) = max(sign(effect_size)) THEN CASE WHEN max(effect_size) > 0 THEN 'positive' ELSE 'negative' END
    ELSE 'mixed' END AS direction FROM ({SP} UNION ALL {MW} UNION ALL {CHI_TEST}) GROUP BY feature""", RANKED + ", " + CHI))
def _(spark, d):
    f = feats(spark, d)
    ranks = drivers.ranked_values(f, T, DRIVE)
    union = drivers.spearman_with_outcome(ranks).unionByName(drivers.mann_whitney(ranks)).unionByName(
        drivers.chi_square(f, T, LEVELS).select(*drivers.EVIDENCE))
    return rounded(drivers.consensus(union).drop("methods"), 6, mean_effect_size=4)


@query("driver_candidates", on_features("SELECT 'numeric' AS kind, 'age, bill_amt_m1, credit_limit, is_revolver' AS names, count(*) AS n_rows FROM feat "
       "UNION ALL SELECT 'categorical', 'education, limit_band', count(*) FROM feat"))
def _(spark, d):
    f = feats(spark, d).selectExpr("client_id", "sex", "education_code", "education", "age", "credit_limit", "bill_amt_m1", "is_revolver", "limit_band",
                                   "string(client_id) AS free_text", "1 AS fixed", T)
    numeric, categorical = drivers.candidate_features(f, T)
    return agg(f, {"n_rows": "count(*)"}).selectExpr(
        f"inline(array(struct('numeric' AS kind, '{', '.join(sorted(numeric))}' AS names, n_rows), "
        f"struct('categorical' AS kind, '{', '.join(sorted(categorical))}' AS names, n_rows)))")


SENTENCE = f"""SELECT feature, method, QUOTE || feature || CASE WHEN {STRENGTH} = 'negligible' THEN QUOTE || ' has no meaningful association with the outcome ('
    ELSE QUOTE || ' shows a ' || {STRENGTH} || ' ' || CASE WHEN effect_size > 0 THEN 'positive' ELSE 'negative' END || ' association with the outcome (' END
    || name || ' = ' || shown || ')' AS sentence""".replace("QUOTE", "chr(39)")


@query("driver_sentences", on_features(f"{SENTENCE} FROM (SELECT *, 'rank-biserial r' AS name, format('{{:.3f}}', effect_size) AS shown FROM ({MW}))", RANKED))
def _(spark, d):
    ranks = drivers.ranked_values(feats(spark, d), T, DRIVE)
    return drivers.sentences(drivers.mann_whitney(ranks))


# Tail areas as sums of positive terms: normal, Student (finite sums, whole degrees of freedom), chi-square.
NORMAL_P = """CASE WHEN z <= 0 THEN 1 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi())
    * list_sum([exp((2 * k + 1) * ln(z) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) for k in range(0, 500)]) END"""
STUDENT_P = """CASE WHEN df % 2 = 0 THEN 1 - sin(theta) * list_sum([exp(lgamma(j + 0.5) - ln(pi()) / 2 - lgamma(j + 1) + 2 * j * ln(cos(theta))) for j in range(0, df // 2)])
    ELSE 1 - 2 / pi() * (theta + sin(theta) * cos(theta) * list_sum([exp(ln(pi()) / 2 + lgamma(j + 1) - ln(2) - lgamma(j + 1.5) + 2 * j * ln(cos(theta))) for j in range(0, (df - 1) // 2)])) END"""
CHI_P = "1 - list_sum([exp(-x / 2 + (df / 2 + k) * ln(x / 2) - lgamma(df / 2 + k + 1)) for k in range(0, 3000)])"
MW_Z = """SELECT feature, greatest(abs(sum(r) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2 - n1 * n0 / 2) - 0.5, -0.5) / sqrt(n1 * n0 / 12 * (n + 1 - any_value(tied) / (n * (n - 1)))) AS z
    FROM rk JOIN (SELECT feature, sum(CAST(c AS DOUBLE) * c * c - c) AS tied FROM (SELECT feature, r, count(*) AS c FROM rk GROUP BY ALL) GROUP BY feature) USING (feature)
    JOIN (SELECT feature, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE y = 1))::DOUBLE AS n1, (count(*) FILTER (WHERE y = 0))::DOUBLE AS n0 FROM rk GROUP BY feature) USING (feature) GROUP BY feature, n, n1, n0"""


@query("driver_p_values", on_features(f"""SELECT feature, 'spearman_correlation' AS method, {R(STUDENT_P, 'p_value')}
      FROM (SELECT feature, n_used - 2 AS df, atan(abs(statistic) / sqrt(1 - statistic * statistic)) AS theta FROM ({SP}))
    UNION ALL SELECT feature, 'mann_whitney_u', {R(NORMAL_P, 'p_value')} FROM ({MW_Z})
    UNION ALL SELECT feature, 'chi_square', {R(CHI_P, 'p_value')} FROM (SELECT feature, statistic AS x, k - 1 AS df FROM ({CHI_TEST}) JOIN tt USING (feature))""", RANKED + ", " + CHI))
def _(spark, d):
    f = feats(spark, d)
    ranks = drivers.ranked_values(f, T, DRIVE)
    union = drivers.spearman_with_outcome(ranks).unionByName(drivers.mann_whitney(ranks)).unionByName(drivers.chi_square(f, T, LEVELS).select(*drivers.EVIDENCE))
    return rounded(union.select("feature", "method", "p_value"))


@query("tree_importance")
def _(spark, d):
    return drivers.tree_importance(feats(spark, d), T, DRIVE).select("feature", "effect_size", "strength", "n_used")


@query("driver_analysis")
def _(spark, d):
    return drivers.run_drivers(feats(spark, d))["consensus"]


@query("exploration_bundle")
def _(spark, d):
    f = feats(spark, d).select("client_id", "education", T, *CORR)
    tables = eda.exploratory_bundle(f, ["education"])
    counts = [agg(part, {"n_rows": "count(*)"}).select(F.lit(name).alias("part"), "n_rows") for name, part in tables.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
