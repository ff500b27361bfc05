"""Queries over the client table: cleaning, features, panel, KPIs, trends and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import clean, feats, long, raw, rounded, table
from catalog.oracle import (DELAY, DELAY_ORD, M, R, Rs, UTIL_BAND, UTIL_ORD, each, melted, on_clean, on_clients, on_features,
                            on_panel)
from catalog.registry import query
from ledgerlens import session
from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions import text
from ledgerlens.functions.tables import agg
from ledgerlens.operators import cleaning, duplicates, features, kpis, panel, selection, trends
from ledgerlens.plans import star
from ledgerlens.roles import describe, month_label
from ledgerlens.sources import files

RAW = ["credit_limit", *[f"bill_amt_m{k}" for k in M], *[f"pay_amt_m{k}" for k in M]]
CODES = ["sex_code", "education_code", "marriage_code", "age", *[f"pay_status_m{k}" for k in M]]
UTIL = [f"utilisation_m{k}" for k in M] + ["utilisation_latest", "utilisation_mean_6m", "utilisation_max_6m", "utilisation_volatility"]
RATIO = [f"repayment_ratio_m{k}" for k in M[:5]] + ["repayment_ratio_mean", "repayment_ratio_median", "repayment_ratio_capped_mean"]


# ------------------------------------------------------------ sources, sinks

@query("star_client_table", on_clients(f"SELECT client_id, {', '.join(CODES)}, default_next_month, {Rs(RAW, 4)} FROM clients"))
def _(spark, d):
    return rounded(star.clients(spark, d), 4)


@query("dataset_discovery")
def _(spark, d):
    path = files.find_dataset(spark, d)
    data = spark.read.parquet(path)
    return agg(data, {"n_rows": "count(*)", "n_columns": f"{len(data.columns)}"}).withColumn(
        "file", F.lit(path.rsplit("/", 1)[-1]))


def _folder(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    session.use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", on_clients(f"SELECT client_id, age, default_next_month, {Rs(RAW, 4)} FROM clients"))
def _(spark, d):
    path = files.export_csv(raw(spark, d), _folder(spark, "clients") + ".csv")
    back = files.load(spark, path).selectExpr("bigint(client_id) AS client_id", "int(age) AS age",
                                              "int(default_next_month) AS default_next_month",
                                              *[f"double({c}) AS {c}" for c in RAW])
    return rounded(back, 4)


@query("parquet_round_trip", on_clients(f"SELECT client_id, age, default_next_month, {Rs(RAW, 4)} FROM clients"))
def _(spark, d):
    path = files.save(raw(spark, d), _folder(spark, "clients"))
    return rounded(files.load(spark, path).select("client_id", "age", "default_next_month", *RAW), 4)


@query("raw_file_load", on_clients(f"SELECT client_id, age, {Rs(RAW[:4], 4)} FROM clients"))
def _(spark, d):
    """A CSV extract with the source's own headers, through loading, renaming and typing."""
    headers = {canonical: header for header, canonical in reversed(v.SOURCE_HEADERS.items())}
    named = raw(spark, d).toDF(*[headers[c] for c in raw(spark, d).columns])
    path = _folder(spark, "extract") + ".csv"
    named.coalesce(1).write.csv(path, header=True) if named.rdd.getNumPartitions() == 1 else named.write.csv(path, header=True)
    data, _how = files.read_csv(spark, path)
    typed = cleaning.convert_types(files.normalise_columns(data)[0])
    return rounded(typed.selectExpr("bigint(client_id) AS client_id", "int(age) AS age", *RAW[:4]), 4)


def _part_files(spark, name: str, lines, heads: list[str]) -> str:
    """CSV lines (client_id, line) as four files, each below its own first lines."""
    path = _folder(spark, name)
    body = lines.selectExpr("int(client_id % 4) AS part", f"{len(heads)} AS seq", "client_id", "line AS value")
    top = spark.range(4).selectExpr("int(id) AS part", f"posexplode(array({', '.join(map(s.text, heads))})) AS (seq, value)").selectExpr("part", "seq", "0L AS client_id", "value")
    ordered = body.union(top).repartition("part").sortWithinPartitions("part", "seq", "client_id")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return f"{path}/part=*"


LOADED = [*RAW[:2], "pay_amt_m1"]
HEADS = {"client_id": "ID", "age": "AGE", "credit_limit": "LIMIT_BAL", "bill_amt_m1": "BILL_AMT1", "pay_amt_m1": "PAY_AMT1"}


def _lines(spark, d, before: str = ""):
    cells = ", ',', ".join(f"coalesce(string({c}), '')" for c in HEADS)
    return raw(spark, d).selectExpr("client_id", f"concat({before}{cells}) AS line")


def _loaded(data):
    typed = cleaning.convert_types(files.normalise_columns(data)[0])
    return rounded(typed.selectExpr("bigint(client_id) AS client_id", "int(age) AS age", *LOADED), 4)


@query("banner_file_load", on_clients(f"SELECT client_id, age, {Rs(LOADED, 4)} FROM clients"))
def _(spark, d):
    """A banner whose first cell is also the id of a client: the client stays, the banner goes."""
    path = _part_files(spark, "banner", _lines(spark, d), ["1,title,,,", ",".join(HEADS.values())])
    return _loaded(files.read_csv(spark, path)[0])


@query("index_column_load", on_clients(f"SELECT client_id, age, {Rs(LOADED, 4)}, client_id * 10 AS column_1 FROM clients"))
def _(spark, d):
    """A first column without a name, as written with a row index."""
    path = _part_files(spark, "index", _lines(spark, d, "client_id * 10, ',', "), ["," + ",".join(HEADS.values())])
    data = files.read_csv(spark, path)[0]
    number = data.selectExpr("bigint(ID) AS client_id", "bigint(column_1) AS column_1")
    return _loaded(data.drop("column_1")).join(number, "client_id")


NOTE = "concat('5 € “', client_id, IF(client_id % 10 = 0, '”\n\"é\"', '”'))"


@query("latin_file_load", on_clients("""SELECT client_id, '5 € “' || client_id || CASE WHEN client_id % 10 = 0 THEN '”' || chr(10) || '"é"' ELSE '”' END AS note,
    'windows-1252' AS encoding, true AS multi_line FROM clients"""))
def _(spark, d):
    """Windows text with quoted line breaks and doubled quotes."""
    path = _folder(spark, "windows")
    notes = raw(spark, d).selectExpr("client_id AS ID", f"{NOTE} AS note")
    stored = notes.withColumn("note", F.translate("note", files.TO_1252, files.FROM_1252))  # the writer knows ISO-8859-1 only
    stored.write.options(encoding="ISO-8859-1", escape='"').csv(path, header=True)
    data, how = files.read_csv(spark, path)
    return data.selectExpr("bigint(ID) AS client_id", "note").withColumn("encoding", F.lit(how["encoding"])).withColumn("multi_line", F.lit(how["multi_line"]))


@query("raw_load_checks", """SELECT 'parquet' AS source_format, count(*) AS n_rows, 0 AS columns_recognised, false AS looks_expected FROM customer""")
def _(spark, d):
    data, meta = files.load_raw(spark, f"{d}/customer.parquet")
    return meta.select("source_format", "columns_recognised", "looks_expected").crossJoin(data.agg(F.count(F.lit(1)).alias("n_rows")))


@query("header_normalisation", on_clients(f"SELECT client_id, age, {Rs(RAW[:3], 4)}, CAST(education_code AS BIGINT) AS region_code FROM clients"))
def _(spark, d):
    source = raw(spark, d).selectExpr("client_id AS `ID`", "age AS ` AGE `", "credit_limit AS `LIMIT_BAL`",
                                      "bill_amt_m1 AS `BILL_AMT1`", "bill_amt_m2 AS `BILL_AMT2`",
                                      "bigint(education_code) AS `Region (Code)`")
    return rounded(files.normalise_columns(source)[0], 4)


# ---------------------------------------------------------- types and cleaning

TEXT_AGE = ("CASE WHEN client_id % 5 = 0 THEN 'unknown' WHEN client_id % 7 = 0 THEN ' ' || age || ' ' "
            "WHEN client_id % 11 = 0 THEN NULL ELSE CAST(age AS VARCHAR) END")


@query("numeric_coercion", on_clients(f"""SELECT client_id, CASE WHEN client_id % 5 <> 0 AND NOT coalesce(client_id % 7 <> 0 AND client_id % 11 = 0, false)
    THEN CAST(age AS DOUBLE) END AS age, (SELECT count(*) FROM clients WHERE client_id % 5 = 0) AS lost FROM clients"""))
def _(spark, d):
    dirty = raw(spark, d).selectExpr("client_id", TEXT_AGE.replace("VARCHAR", "STRING") + " AS age")
    lost = cleaning.conversion_counts(dirty)["age"]
    return cleaning.convert_types(dirty).withColumn("lost", F.lit(lost).cast("long"))


@query("safe_division", """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount = 0 OR l_tax = 0.02) AS undefined,
    round(avg(CASE WHEN l_discount <> 0 AND l_tax <> 0.02 THEN l_tax / l_discount END), 6) + 0.0 AS mean_ratio
    FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    ratio = s.divide("l_tax", "IF(l_tax = 0.02D, 0D, l_discount)")
    return rounded(agg(table(spark, d, "lineitem"), {
        "n": "count(*)", "undefined": f"count_if({ratio} IS NULL)", "mean_ratio": f"avg({ratio})"}, ["l_returnflag"]))


@query("exact_duplicates_dropped", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    return duplicates.drop_exact(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


KEYED = "SELECT o_orderkey AS client_id, o_custkey, o_orderstatus, o_orderpriority FROM orders"


def keyed(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS client_id", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("duplicates_flagged", f"""WITH k AS ({KEYED}) SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) > 1
    AS is_duplicate_excluding_id FROM k""")
def _(spark, d):
    return duplicates.flag_ignoring_key(keyed(spark, d))


@query("duplicates_without_id_dropped", f"""WITH k AS ({KEYED}) SELECT min(client_id) AS client_id, o_custkey, o_orderstatus, o_orderpriority
    FROM k GROUP BY ALL""")
def _(spark, d):
    return duplicates.drop_ignoring_key(keyed(spark, d))


@query("duplicate_report", f"""WITH k AS ({KEYED}), g AS (SELECT count(*) AS n FROM k GROUP BY o_custkey, o_orderstatus, o_orderpriority)
    SELECT (SELECT count(*) FROM k) AS rows, CAST(0 AS BIGINT) AS exact_duplicates, CAST(sum(n - 1) AS BIGINT) AS duplicates_without_id,
    CAST(0 AS BIGINT) AS repeated_ids, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS rows_in_duplicate_groups FROM g""")
def _(spark, d):
    return duplicates.duplicate_counts(keyed(spark, d))


@query("duplicate_examples", f"""WITH k AS ({KEYED}), g AS (SELECT client_id, min(client_id) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority)
    AS first_key FROM k) SELECT * FROM g WHERE client_id > first_key ORDER BY client_id LIMIT 5""")
def _(spark, d):
    return duplicates.duplicate_examples(keyed(spark, d))


@query("imputation_median", on_clean(f"SELECT client_id, {Rs([f'bill_amt_m{k}' for k in M], 4)}, {each('bill_amt_m{k}_was_missing')} FROM cleaned"))
def _(spark, d):
    c = raw(spark, d)
    fills = cleaning.fill_values(c, [f"bill_amt_m{k}" for k in M])
    return rounded(cleaning.impute(c, fills).select("client_id", *fills, *[f"{x}_was_missing" for x in fills]), 4)


@query("imputation_mean_and_mode", """SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END,
    (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 9 <> 0)), 4) + 0.0 AS o_totalprice,
    coalesce(CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END, (SELECT o_orderpriority FROM orders WHERE o_orderkey % 8 <> 0
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM orders""")
def _(spark, d):
    gaps = table(spark, d, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 9 <> 0, o_totalprice, NULL) AS o_totalprice",
                                                "IF(o_orderkey % 8 <> 0, o_orderpriority, NULL) AS o_orderpriority")
    fills = cleaning.fill_values(gaps, ["o_totalprice", "o_orderpriority"], "mean", "mode")
    return rounded(cleaning.impute(gaps, fills, indicators=False), 4)


@query("code_labels", on_clean("SELECT education_code, education, sex, marriage, count(*) AS clients FROM cleaned GROUP BY ALL"))
def _(spark, d):
    return agg(cleaning.label_codes(raw(spark, d)), {"clients": "count(*)"}, ["education_code", "education", "sex", "marriage"])


@query("limit_and_row_flags", on_clean("""SELECT client_id, credit_limit, credit_limit_original, age_is_implausible, has_negative_balance,
    has_extreme_value FROM cleaned"""))
def _(spark, d):
    return clean(spark, d).select("client_id", "credit_limit", "credit_limit_original", "age_is_implausible",
                                  "has_negative_balance", "has_extreme_value")


@query("cleaning_audit", on_clean(f"""SELECT * FROM (VALUES (1, 'convert_dtypes', CAST(0 AS BIGINT)), (2, 'remove_duplicates', 0),
    (3, 'handle_missing_values', (SELECT {each('count(*) FILTER (WHERE bill_amt_m{k} IS NULL)', sep=' + ')} FROM clients)),
    (4, 'normalise_categoricals', (SELECT count(*) FILTER (WHERE education = 'Unknown') + count(*) FILTER (WHERE marriage = 'Unknown')
      + count(*) FILTER (WHERE sex = 'Unknown') FROM cleaned)),
    (5, 'handle_invalid_numeric_values', (SELECT count(*) FILTER (WHERE age_is_implausible) + count(*) FILTER (WHERE credit_limit_original <= 0) FROM cleaned)),
    (6, 'flag_extreme_outliers', (SELECT count(*) FILTER (WHERE has_extreme_value) FROM cleaned))) AS t(step, name, affected_rows)"""))
def _(spark, d):
    return cleaning.clean(raw(spark, d))[1].select("step", "name", "affected_rows")


# -------------------------------------------------------------------- features

@query("utilisation_features", on_features(f"SELECT client_id, {Rs(UTIL)}, is_high_utilisation, is_over_limit FROM feat"))
def _(spark, d):
    out = features.add_utilisation(clean(spark, d))
    return rounded(out.select("client_id", *UTIL, "is_high_utilisation", "is_over_limit"))


@query("repayment_features", on_features(f"""SELECT client_id, {Rs(RATIO)}, is_full_payer, is_revolver, months_zero_payment,
    {Rs(['total_paid_6m', 'avg_payment_6m'])} FROM feat"""))
def _(spark, d):
    out = features.add_repayment(clean(spark, d))
    return rounded(out.select("client_id", *RATIO, "is_full_payer", "is_revolver", "months_zero_payment", "total_paid_6m",
                              "avg_payment_6m"))


@query("delinquency_features", on_features("""SELECT client_id, delinquent_months_count, max_delinquency, current_delinquency,
    ever_delinquent, is_currently_delinquent, delinquency_trend FROM feat"""))
def _(spark, d):
    return features.add_delinquency(clean(spark, d)).select(
        "client_id", "delinquent_months_count", "max_delinquency", "current_delinquency", "ever_delinquent",
        "is_currently_delinquent", "delinquency_trend")


@query("trajectory_features", on_features(f"""SELECT client_id, {Rs(['bill_volatility', 'bill_trend_slope'], 3)},
    {Rs(['avg_bill_6m', 'balance_growth_6m'])} FROM feat"""))
def _(spark, d):
    out = features.add_trajectory(clean(spark, d)).select("client_id", "avg_bill_6m", "bill_volatility", "bill_trend_slope", "balance_growth_6m")
    return rounded(out, 3, avg_bill_6m=6, balance_growth_6m=6)


@query("balance_slope_from_panel", on_panel(f"SELECT client_id, {R('regr_slope(bill_amt, month_order)', 'slope', 3)} FROM panel GROUP BY client_id"))
def _(spark, d):
    """The row-wise slope against a grouped regression on the long panel."""
    return rounded(features.add_trajectory(clean(spark, d)).selectExpr("client_id", "bill_trend_slope AS slope"), 3)


@query("band_features", on_features("SELECT client_id, limit_band, limit_band_ord, age_band, age_band_ord FROM feat"))
def _(spark, d):
    return feats(spark, d).select("client_id", "limit_band", "limit_band_ord", "age_band", "age_band_ord")


@query("utilisation_bands", on_features(f"SELECT client_id, {UTIL_BAND} AS utilisation_band, {UTIL_ORD} AS utilisation_band_ord FROM feat"))
def _(spark, d):
    label, place = features.utilisation_band("utilisation_latest")
    return s.project(feats(spark, d), {"utilisation_band": label, "utilisation_band_ord": place}).select(
        "client_id", "utilisation_band", "utilisation_band_ord")


@query("delay_groups", on_features(f"SELECT {DELAY} AS delay_group, {DELAY_ORD} AS delay_ord, count(*) AS clients FROM feat GROUP BY ALL"))
def _(spark, d):
    label, place = features.delay_group("current_delinquency")
    return agg(s.project(feats(spark, d), {"delay_group": label, "delay_ord": place}), {"clients": "count(*)"}, ["delay_group", "delay_ord"])


@query("status_labels", on_clients("SELECT CASE WHEN pay_status_m1 IS NULL THEN 'Unknown' ELSE pay_status_m1 || ' · ' || CASE pay_status_m1 "
       + " ".join(f"WHEN {k} THEN '{x}'" for k, x in v.PAY_STATUS_LABELS.items())
       + " ELSE 'Unknown' END END AS status, count(*) AS clients FROM clients GROUP BY 1"))
def _(spark, d):
    return agg(raw(spark, d).selectExpr(f"{features.status_label('pay_status_m1')} AS status"), {"clients": "count(*)"}, ["status"])


@query("column_meanings", on_panel("""SELECT 'bill_amt_m' || month_index AS column_name, month_label,
    'Statement balance of ' || month_label || ' in NT$; negative means in credit.' AS meaning, count(bill_amt) AS n FROM panel GROUP BY ALL"""))
def _(spark, d):
    months = " ".join(f"WHEN {k} THEN {s.text(describe(f'bill_amt_m{k}'))}" for k in M)
    labels = " ".join(f"WHEN {k} THEN {s.text(month_label(k))}" for k in M)
    return agg(long(spark, d).selectExpr("concat('bill_amt_m', month_index) AS column_name", f"CASE month_index {labels} END AS month_label",
                                         f"CASE month_index {months} END AS meaning", "bill_amt"),
               {"n": "count(bill_amt)"}, ["column_name", "month_label", "meaning"])


FMT = "format('{:,}', CAST(round_even(abs({x}), 0) AS BIGINT))"


@query("display_formats", f"""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || 'NT$' || {FMT.replace('{x}', 'c_acctbal')} AS as_currency,
    format('{{:.2f}}%', c_acctbal) AS as_percentage,
    CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || 'NT$' || CASE WHEN abs(c_acctbal) >= 1000 THEN format('{{:.2f}}', abs(c_acctbal) / 1000) || 'K'
      ELSE {FMT.replace('{x}', 'c_acctbal')} END AS as_compact FROM customer""")
def _(spark, d):
    rows = table(spark, d, "customer")
    return rows.selectExpr("c_custkey", f"{text.currency('c_acctbal')} AS as_currency", f"{text.decimal('c_acctbal', 2, '%')} AS as_percentage",
                           f"{text.currency_compact('c_acctbal')} AS as_compact")


# ----------------------------------------------------------------------- panel

@query("long_panel", on_panel(f"""SELECT client_id, month_index, month_label, month_order, {Rs(['bill_amt', 'pay_amt'], 4)}, pay_status,
    is_delinquent, {R('utilisation', 'utilisation')} FROM panel"""))
def _(spark, d):
    return rounded(long(spark, d), bill_amt=4, pay_amt=4)


@query("panel_repayment_ratio", on_panel(f"""SELECT client_id, month_index, {R('CASE WHEN prior > 0 THEN pay_amt / prior END', 'repayment_ratio')} FROM
    (SELECT *, lag(bill_amt) OVER (PARTITION BY client_id ORDER BY month_order) AS prior FROM panel)"""))
def _(spark, d):
    return rounded(panel.panel_repayment_ratio(long(spark, d)).select("client_id", "month_index", "repayment_ratio"))


SUMMARY_COLUMNS = {"mean_bill": "avg(bill_amt)", "median_bill": "median(bill_amt)", "mean_payment": "avg(pay_amt)",
                   "mean_utilisation_pct": "avg(utilisation) * 100", "delinquency_rate_pct": "avg(CAST(is_delinquent AS INTEGER)) * 100",
                   "active_share_pct": "avg(CAST(bill_amt > 0 AS INTEGER)) * 100"}


@query("panel_summary", on_panel(f"""SELECT month_index, month_label, month_order, count(DISTINCT client_id) AS n_clients,
    {', '.join(R(e, n, 4) for n, e in SUMMARY_COLUMNS.items())}, {R('sum(bill_amt)', 'total_bill', 2)}, {R('sum(pay_amt)', 'total_payment', 2)}
    FROM panel GROUP BY ALL"""))
def _(spark, d):
    return rounded(trends.panel_summary(long(spark, d)), 4, total_bill=2, total_payment=2)


# ------------------------------------------------------------------------ KPIs

KPI_SQL = {
    "total_clients": "count(DISTINCT client_id)", "total_records": "count(*)", "client_month_records": "count(*) * 6",
    "observed_default_rate": "avg(default_next_month) * 100", "default_client_count": "count(*) FILTER (WHERE default_next_month = 1)",
    "avg_credit_limit": "avg(credit_limit)", "median_credit_limit": "median(credit_limit)", "total_credit_limit": "sum(credit_limit)",
    "total_outstanding_balance": "sum(bill_amt_m1)", "avg_outstanding_balance": "avg(bill_amt_m1)",
    "median_outstanding_balance": "median(bill_amt_m1)", "avg_utilisation": "avg(utilisation_latest) * 100",
    "median_utilisation": "median(utilisation_latest) * 100",
    "high_utilisation_share": "avg(CAST(is_high_utilisation AS INTEGER)) * 100",
    "high_utilisation_count": "count(*) FILTER (WHERE is_high_utilisation)",
    "over_limit_share": "avg(CAST(is_over_limit AS INTEGER)) * 100", "total_repayments": "sum(total_paid_6m)",
    "median_repayment_ratio": "median(repayment_ratio_median) * 100",
    "avg_capped_repayment_ratio": "avg(repayment_ratio_capped_mean) * 100",
    "full_payer_share": "avg(CAST(is_full_payer AS INTEGER)) * 100", "revolver_share": "avg(CAST(is_revolver AS INTEGER)) * 100",
    "currently_delinquent_share": "avg(CAST(is_currently_delinquent AS INTEGER)) * 100",
    "currently_delinquent_count": "count(*) FILTER (WHERE is_currently_delinquent)",
    "ever_delinquent_share": "avg(CAST(ever_delinquent AS INTEGER)) * 100", "avg_delinquent_months": "avg(delinquent_months_count)",
    "avg_max_delinquency": "avg(max_delinquency)", "avg_age": "avg(age)", "median_age": "median(age)",
    "median_balance_trend": "median(bill_trend_slope)",
    "share_growing_balance": "avg(CAST(bill_trend_slope > 0 AS INTEGER)) * 100",
}


def kpi_union(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS key, CAST(({e}) AS DOUBLE) AS value FROM {source}" for k, e in KPI_SQL.items())


@query("portfolio_kpis", on_features(f"SELECT key, {R('value', 'value', 3)}, (SELECT count(*) FROM feat) AS n_rows FROM ({kpi_union('feat')})"))
def portfolio_kpis(spark, d):
    return rounded(kpis.calculate_kpis(feats(spark, d)).select("key", "value", "n_rows"), 3)


@query("kpi_unavailable", on_features("SELECT 'role:' || x AS key FROM (VALUES ('income'), ('savings'), ('expenses'), ('credit_score'), "
       "('employment'), ('loan_amount'), ('date')) AS t(x) WHERE (SELECT count(*) FROM feat) > 0 UNION ALL SELECT 'median_balance_trend' "
       "UNION ALL SELECT 'share_growing_balance'"))
def _(spark, d):
    from ledgerlens.roles import Roles

    part = feats(spark, d).drop("bill_trend_slope")
    return kpis.unavailable(kpis.calculate_kpis(part), Roles.of(part)).select("key")


@query("custom_kpi", on_features(f"SELECT 'p95_limit_share' AS key, {R('avg(CAST(credit_limit > 950000 AS INTEGER)) * 100', 'value')} FROM feat"))
def _(spark, d):
    own = kpis.Kpi("p95_limit_share", "Very high limits", "Credit capacity", "percentage", "custom", "",
                   expression="avg(int(credit_limit > 950000)) * 100")
    return rounded(kpis.calculate_kpis(feats(spark, d), [own]).select("key", "value"))


OLDER = "(SELECT * FROM feat WHERE age BETWEEN 30 AND 50 AND education IN ('Others', 'University'))"


@query("kpi_deltas", on_features(f"""SELECT key, {R('a.value', 'selection', 3)}, {R('b.value', 'portfolio', 3)},
    {R('a.value - b.value', 'difference', 3)}, abs(a.value - b.value) / greatest(abs(b.value), 1e-9) < 0.005 AS is_flat
    FROM ({kpi_union(OLDER)}) a JOIN ({kpi_union('feat')}) b USING (key) WHERE a.value IS NOT NULL AND b.value IS NOT NULL"""))
def _(spark, d):
    f = feats(spark, d)
    chosen = selection.apply(f, selection.Spec(age=(30, 50), education=("Others", "University")))
    own = kpis.calculate_kpis(chosen.data)
    return rounded(kpis.kpi_deltas(own, kpis.calculate_kpis(f)).select("key", "selection", "portfolio", "difference", "is_flat"), 3)


# ---------------------------------------------------------------------- trends

POINT_SQL = {
    "balance_mean": ("avg(bill_amt)", "bill_amt"), "balance_median": ("median(bill_amt)", "bill_amt"),
    "balance_total": ("sum(bill_amt)", "bill_amt"), "payment_mean": ("avg(pay_amt)", "pay_amt"),
    "payment_median": ("median(pay_amt)", "pay_amt"), "payment_total": ("sum(pay_amt)", "pay_amt"),
    "utilisation_mean": ("avg(utilisation) * 100", "utilisation"), "utilisation_median": ("median(utilisation) * 100", "utilisation"),
    "delinquency_rate": ("avg(CAST(pay_status >= 1 AS INTEGER)) * 100", "pay_status"),
    "active_accounts": ("avg(CAST(bill_amt > 0 AS INTEGER)) * 100", "bill_amt"),
}
POINTS = "points AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, month_index, month_label, month_order, CAST({e} AS DOUBLE) AS value, count({c}) AS n FROM panel GROUP BY ALL"
    for m, (e, c) in POINT_SQL.items()) + ")"
CHANGES = POINTS + """, changes AS (SELECT *, value - lag(value) OVER w AS change,
    CASE WHEN lag(value) OVER w <> 0 THEN (value - lag(value) OVER w) / abs(lag(value) OVER w) * 100 END AS change_pct
    FROM points WINDOW w AS (PARTITION BY measure ORDER BY month_order))"""


@query("trend_points", on_panel(f"SELECT measure, month_index, month_label, month_order, {R('value', 'value', 2)}, n FROM points", POINTS))
def _(spark, d):
    return rounded(trends.measure_points(long(spark, d), list(POINT_SQL)), 2)


@query("period_changes", on_panel(f"SELECT measure, month_order, {R('change', 'change', 2)}, {R('change_pct', 'change_pct', 4)} FROM changes", CHANGES))
def _(spark, d):
    points = trends.measure_points(long(spark, d), list(POINT_SQL))
    return rounded(trends.period_changes(points).select("measure", "month_order", "change", "change_pct"), 2, change_pct=4)


ANOMALY = CHANGES + """, mids AS (SELECT measure, median(change) AS mid, avg(change) AS centre, stddev_pop(change) AS sd FROM changes GROUP BY measure),
    mads AS (SELECT measure, median(abs(change - mid)) AS mad FROM changes JOIN mids USING (measure) GROUP BY measure),
    scores AS (SELECT measure, month_order, CASE WHEN mad > 0 THEN 0.6745 * (change - mid) / mad ELSE (change - centre) / nullif(sd, 0) END AS score, mad
    FROM changes JOIN mids USING (measure) JOIN mads USING (measure))"""


@query("trend_anomalies", on_panel(f"SELECT measure, month_order, {R('score', 'score', 4)}, "
       "coalesce(abs(score) > CASE WHEN mad > 0 THEN 3.5 ELSE 2.0 END, false) AS is_anomaly FROM scores", ANOMALY))
def _(spark, d):
    points = trends.measure_points(long(spark, d), list(POINT_SQL))
    flagged = trends.flag_anomalies(trends.period_changes(points))
    return rounded(flagged.select("measure", "month_order", "score", "is_anomaly"), 4)


@query("trends", on_panel(f"""SELECT measure, count(*) AS n_periods, {R('arg_min(value, month_order)', 'first_value', 2)},
    {R('arg_max(value, month_order)', 'last_value', 2)}, {R('arg_max(value, month_order) - arg_min(value, month_order)', 'total_change', 2)},
    {R('regr_slope(value, month_order)', 'slope', 2)}, first(month_label ORDER BY value DESC, month_order) AS peak, first(month_label ORDER BY value, month_order) AS trough,
    CASE WHEN abs((arg_max(value, month_order) - arg_min(value, month_order)) / arg_min(value, month_order)) * 100 < 2 THEN 'flat'
      WHEN arg_max(value, month_order) > arg_min(value, month_order) THEN 'increasing' ELSE 'decreasing' END AS direction
    FROM points GROUP BY measure""", POINTS))
def _(spark, d):
    t = trends.trends(long(spark, d), list(POINT_SQL))
    return rounded(t.select("measure", "n_periods", "first_value", "last_value", "total_change", "slope", "peak", "trough", "direction"), 2)


@query("period_movement", on_panel(f"""SELECT measure, arg_min(month_label, month_order) AS first_period, arg_max(month_label, month_order) AS last_period,
    {R('arg_min(value, month_order)', 'first_value', 2)}, {R('arg_max(value, month_order)', 'last_value', 2)},
    {R('(arg_max(value, month_order) - arg_min(value, month_order)) / abs(arg_min(value, month_order)) * 100', 'total_change_pct', 4)}
    FROM points WHERE measure IN ('balance_mean', 'payment_mean', 'utilisation_mean', 'delinquency_rate') GROUP BY measure""", POINTS))
def _(spark, d):
    m = trends.movement(long(spark, d))
    return rounded(m.select("measure", "first_period", "last_period", "first_value", "last_value", "total_change_pct"), 2, total_change_pct=4)


# ------------------------------------------------------------------- selections

@query("filter_bounds", on_features(f"""SELECT count(*) AS n_rows, CAST(min(age) AS DOUBLE) AS age_min, CAST(max(age) AS DOUBLE) AS age_max,
    min(credit_limit) AS limit_min, max(credit_limit) AS limit_max, {R('floor(min(utilisation_latest) * 100) / 100', 'utilisation_min')},
    {R('ceil(quantile_cont(utilisation_latest, 0.995) * 100) / 100', 'utilisation_max')},
    array_to_string(list_sort(list(DISTINCT education)), ', ') AS education_options,
    array_to_string(list_sort(list(DISTINCT marriage)), ', ') AS marriage_options,
    array_to_string(list_sort(list(DISTINCT sex)), ', ') AS sex_options FROM feat"""))
def _(spark, d):
    row = selection.bounds_table(feats(spark, d))
    return rounded(s.project(row, {f"{c}_options": f"concat_ws(', ', {c}_options)" for c in selection.CATEGORIES}))


SPEC = selection.Spec(age=(30, 50), limit=(100_000, 800_000), education=("Others", "University", "Unknown"), delinquency="ever")
SPEC_SQL = "age BETWEEN 30 AND 50 AND credit_limit BETWEEN 100000 AND 800000 AND education IN ('Others', 'University', 'Unknown') AND ever_delinquent"


@query("filtered_clients", on_features(f"SELECT client_id, age, credit_limit, education FROM feat WHERE {SPEC_SQL}"))
def _(spark, d):
    return selection.apply(feats(spark, d), SPEC).data.select("client_id", "age", "credit_limit", "education")


@query("selection_counts", on_features(f"""SELECT count(*) AS n_total, count(*) FILTER (WHERE {SPEC_SQL}) AS n_selected,
    count(*) - count(*) FILTER (WHERE {SPEC_SQL}) AS n_excluded, {R(f'count(*) FILTER (WHERE {SPEC_SQL}) / count(*) * 100', 'share_pct')} FROM feat"""))
def _(spark, d):
    f = feats(spark, d)
    return rounded(selection.selection_counts(f, selection.apply(f, SPEC)))


@query("full_range_is_no_filter", on_features("SELECT true AS is_default, count(*) AS n FROM feat"))
def _(spark, d):
    f = feats(spark, d)
    bounds = selection.derive_bounds(f)
    spec = selection.default_spec(bounds)
    return agg(selection.apply(f, spec, bounds).data, {"is_default": str(selection.is_default(spec, bounds)).lower(), "n": "count(*)"})


@query("option_differences", on_features("""SELECT 'education' AS category, array_to_string(list_sort(list(DISTINCT education)), ', ') AS available,
    'Doctorate' AS not_available, array_to_string(list_sort(list(DISTINCT education) FILTER (WHERE education <> 'University')), ', ') AS left_out FROM feat
    UNION ALL SELECT 'sex', array_to_string(list_sort(list(DISTINCT sex)), ', '), '', '' FROM feat"""))
def _(spark, d):
    return selection.option_differences(feats(spark, d), {"education": ["University", "Doctorate"], "sex": ["Male", "Female"]})


@query("text_search", on_features("SELECT client_id, education, marriage FROM feat WHERE regexp_matches(CAST(client_id AS VARCHAR), '(?i)^1.2') "
       "OR regexp_matches(education, '(?i)^1.2|UNIV') OR regexp_matches(marriage, '(?i)^1.2|UNIV') OR regexp_matches(CAST(client_id AS VARCHAR), '(?i)UNIV')"))
def _(spark, d):
    return selection.search(feats(spark, d).select("client_id", "education", "marriage"), "^1.2|UNIV")


@query("literal_search", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), '1-u') OR contains(CAST(o_orderkey AS VARCHAR), '1-u')")
def _(spark, d):
    return selection.search(selection.project(table(spark, d, "orders"), ["o_orderkey", "o_orderpriority", "not_there"]), "1-U", literal=True)


@query("pagination", on_features(f"SELECT client_id, age, {R('credit_limit', 'credit_limit', 2)} FROM feat ORDER BY client_id LIMIT 25 OFFSET 50"))
def _(spark, d):
    return rounded(selection.page(feats(spark, d).select("client_id", "age", "credit_limit"), 3, 25), 2)


@query("pagination_by_ranges", f"SELECT o_orderkey, o_custkey, {R('o_totalprice', 'o_totalprice', 2)} FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 5700")
def _(spark, d):
    """A far page: only the key ranges it lies in are sorted."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(selection.pages(orders, 100, "o_orderkey", ranges=16).page(58), 2)


@query("page_count", "SELECT count(*) AS n_rows, CAST(ceil(count(*) / 100) AS BIGINT) AS pages FROM lineitem")
def _(spark, d):
    return selection.page_count(table(spark, d, "lineitem"), 100)
