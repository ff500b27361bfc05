import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.operators import cleaning, features, kpis, panel, trends
from ledgerlens.roles import Roles, describe

M = range(1, 7)


def by_id(df):
    return {r["client_id"]: r for r in df.collect()}


# ----------------------------------------------------------------- registry

def test_roles_come_from_names_only():
    roles = Roles.of(["client_id", "education_code", "education", "bill_amt_m10", "bill_amt_m2", "bill_amt_mx", "utilisation_latest"])
    assert roles.one("education") == "education"
    assert roles.months("bill_amount") == {2: "bill_amt_m2", 10: "bill_amt_m10"}
    assert roles.all("utilisation") == ("utilisation_latest",)
    assert not roles.has("target") and "income" in roles.absent()


def test_descriptions():
    assert "Sep 2005" in describe("bill_amt_m1") and "age" in describe("age_was_missing") and "No description" in describe("zzz")


# ----------------------------------------------------------------- cleaning

def test_edge_cases_survive_cleaning(edge):
    cleaned, report = cleaning.clean(edge)
    rows = by_id(cleaned)
    assert len(rows) == 9
    assert rows[2]["credit_limit"] is None and rows[2]["credit_limit_original"] == 0
    assert rows[1]["credit_limit"] is None and rows[1]["credit_limit_original"] == -750
    assert rows[3]["has_negative_balance"] and rows[3]["bill_amt_m1"] == -320 and not rows[1]["has_negative_balance"]
    assert rows[4]["education"] == rows[4]["marriage"] == "Unknown" and rows[4]["education_code"] == 6
    assert rows[8]["age_is_implausible"] and rows[8]["age"] == 131
    assert {i for i, r in rows.items() if r["is_duplicate_excluding_id"]} == {6, 7}
    steps = {r["name"]: r for r in report.collect()}
    assert [r["name"] for r in report.orderBy("step").collect()] == list(cleaning.RATIONALE)
    assert steps["remove_duplicates"]["affected_rows"] == 1 and steps["remove_duplicates"]["rows_removed"] == 0
    assert steps["normalise_categoricals"]["affected_rows"] == 3
    assert steps["handle_invalid_numeric_values"]["affected_rows"] == 3


def test_dropping_key_only_duplicates_keeps_the_first(edge):
    cleaned, report = cleaning.clean(edge, drop_without_id=True)
    assert set(by_id(cleaned)) == {1, 2, 3, 4, 5, 6, 8, 9}
    step = report.filter("name = 'remove_duplicates'").first()
    assert step["rows_removed"] == 1 and step["affected_rows"] == 2  # removed and counted, both


def test_exact_duplicates_go(minimal):
    assert cleaning.clean(minimal.unionByName(minimal.limit(2)))[0].count() == 6


def test_conditional_columns_follow_the_data(minimal):
    columns = cleaning.clean(minimal, conditional_columns=True)[0].columns
    assert not {"is_duplicate_excluding_id", "age_is_implausible", "has_negative_balance", "credit_limit_original"} & set(columns)


def gaps(minimal):
    return minimal.withColumns({
        "age": F.expr("IF(client_id = 2, NULL, age)"), "bill_amt_m2": F.expr("IF(client_id > 4, double('NaN'), bill_amt_m2)"),
        "note": F.expr("IF(client_id < 4, 'a', IF(client_id < 6, 'b', NULL))"), "empty": F.lit(None).cast("double"),
    })


@pytest.mark.parametrize("strategy, wanted", [("median", 44.0), ("mean", 41.0), ("zero", 0.0), ("leave", None)])
def test_numeric_imputation(minimal, strategy, wanted):
    rows = by_id(cleaning.clean(gaps(minimal), numeric=strategy)[0])
    assert rows[2]["age"] == (pytest.approx(wanted) if wanted is not None else None)
    assert rows[2]["age_was_missing"] and not rows[1]["age_was_missing"]
    assert rows[5]["bill_amt_m2_was_missing"] and rows[1]["empty"] is None and "empty_was_missing" not in rows[1].asDict()


@pytest.mark.parametrize("strategy, wanted", [("unknown", "Unknown"), ("mode", "a"), ("leave", None)])
def test_categorical_imputation(minimal, strategy, wanted):
    assert by_id(cleaning.clean(gaps(minimal), categorical=strategy)[0])[6]["note"] == wanted


def test_text_columns_are_parsed(minimal):
    dirty = minimal.withColumn("age", F.expr("CASE client_id WHEN 1 THEN '1,000' WHEN 2 THEN ' 32 ' ELSE string(age) END"))
    cleaned, report = cleaning.clean(dirty, numeric="leave")
    rows = by_id(cleaned)
    assert rows[1]["age"] is None and rows[2]["age"] == 32
    assert report.filter("name = 'convert_dtypes'").first()["affected_rows"] == 1


def test_extreme_fence_ignores_columns_with_two_values(spark):
    df = spark.range(100).selectExpr("id AS client_id", "double(IF(id = 0, 1e6, 10)) AS credit_limit", "double(IF(id = 0, 9e9, id)) AS bill_amt_m1")
    assert set(cleaning.extreme_fences(df)) == {"bill_amt_m1"}


# ----------------------------------------------------------------- features

def test_hand_computed_features(small_featured):
    r = by_id(small_featured)[1]
    used = [1500 / 24e3, 2700 / 24e3, 3900 / 24e3, 5100 / 24e3, 6300 / 24e3, 7500 / 24e3]
    assert r["utilisation_m1"] == pytest.approx(used[5]) and r["utilisation_latest"] == pytest.approx(used[5])
    assert r["utilisation_mean_6m"] == pytest.approx(0.1875) and r["utilisation_max_6m"] == pytest.approx(used[5])
    assert r["utilisation_volatility"] == pytest.approx(np.std(used))
    assert r["repayment_ratio_m1"] == pytest.approx(900 / 6300) and r["repayment_ratio_m5"] == pytest.approx(500 / 1500)
    assert r["repayment_ratio_median"] == pytest.approx(np.median([900 / 6300, 800 / 5100, 700 / 3900, 600 / 2700, 500 / 1500]))
    assert r["bill_trend_slope"] == pytest.approx(1200) and r["balance_growth_6m"] == pytest.approx(4.0)
    assert r["total_paid_6m"] == 3900 and r["avg_payment_6m"] == 650 and r["months_zero_payment"] == 0
    assert by_id(small_featured)[3]["max_delinquency"] == 0 and by_id(small_featured)[6]["delinquent_months_count"] == 6


def test_undefined_ratios_are_null(edge_featured):
    rows = by_id(edge_featured)
    assert rows[1]["utilisation_latest"] is None and rows[2]["utilisation_latest"] is None and rows[2]["is_high_utilisation"] is False
    assert rows[5]["repayment_ratio_mean"] is None and rows[3]["repayment_ratio_mean"] is None and rows[5]["is_revolver"] is False
    assert rows[3]["utilisation_latest"] < 0 and rows[6]["utilisation_latest"] == 1.75 and rows[6]["is_over_limit"]
    assert rows[5]["balance_growth_6m"] is None
    bad = [c for c, t in edge_featured.dtypes if t == "double" and edge_featured.filter(f"isnan(`{c}`) OR abs(`{c}`) = double('Infinity')").count()]
    assert bad == []


def test_all_null_payments_sum_to_zero(minimal):
    none = minimal.withColumns({f"pay_amt_m{m}": F.lit(None).cast("double") for m in M})
    r = features.add_features(none)[0].first()
    assert r["total_paid_6m"] == 0 and r["avg_payment_6m"] is None and r["months_zero_payment"] == 0


def test_delinquency_direction(minimal):
    shaped = minimal.withColumns({f"pay_status_m{m}": F.expr(f"CASE client_id WHEN 1 THEN IF({m} <= 3, 1, 0) WHEN 2 THEN IF({m} > 3, 1, 0) ELSE 0 END") for m in M})
    rows = by_id(features.add_delinquency(shaped))
    assert [rows[i]["delinquency_trend"] for i in (1, 2, 3)] == ["Worsening", "Improving", "Stable"]


def test_limit_bands_need_two_distinct_edges(minimal):
    constant, skipped = features.add_features(minimal.withColumn("credit_limit", F.lit(5000.0)))
    assert "limit_band" not in constant.columns and "limit_band" in skipped
    colliding, skipped = features.add_features(minimal.withColumn("credit_limit", F.col("client_id") * 1.0))
    assert "limit_band" not in colliding.columns and "same label" in skipped["limit_band"]


def test_feature_report_names_what_is_missing(minimal):
    part, _ = features.add_features(minimal.drop("credit_limit"))
    report = {r["feature"]: r for r in features.feature_report(part).collect()}
    assert len(report) == 42 and sum(r["ml_safe"] for r in features.feature_report(features.add_features(minimal)[0]).collect()) == 20
    assert not report["utilisation_latest"]["created"] and "credit_limit" in report["utilisation_latest"]["skip_reason"]
    assert report["bill_trend_slope"]["created"] and not report["savings_rate"]["created"]


def test_feature_coverage_counts_what_is_missing(edge_featured):
    rows = {r["feature"]: r for r in features.feature_coverage(edge_featured).collect()}
    assert rows["utilisation_latest"]["missing"] == 2 and rows["utilisation_latest"]["missing_pct"] == pytest.approx(200 / 9)
    assert rows["total_paid_6m"]["missing"] == 0 and rows["savings_rate"]["missing"] is None and not rows["savings_rate"]["created"]


def test_later_utilisation_band_wins_for_a_low_threshold(spark):
    label, _ = features.utilisation_band("u", 0.4)
    rows = spark.sql("SELECT * FROM VALUES (-1D), (0.35D), (0.5D), (0.7D), (null) AS t(u)")
    assert [r[0] for r in rows.selectExpr(label).collect()] == ["Negative / zero", "Moderate (30-60%)", "Very high (40%+)", "Very high (40%+)", None]


def test_status_labels(spark):
    rows = spark.sql("SELECT * FROM VALUES (-1), (9), (42), (null) AS t(c)")
    assert [r[0] for r in rows.selectExpr(features.status_label("c")).collect()] == ["-1 · Paid in full", "9 · 9+ months delay", "42 · Unknown", "Unknown"]


# ----------------------------------------------------------------- panel

def test_panel_shape_and_order(minimal):
    long = panel.build_panel(minimal)
    assert long.count() == 36
    r = long.filter("client_id = 2 AND month_index = 6").first()
    assert (r["month_order"], r["month_label"], r["bill_amt"], r["utilisation"]) == (1, "Apr 2005", 3000.0, 0.1)


def test_panel_months_are_dense_when_some_are_missing(minimal):
    kept = minimal.drop(*[f"{p}_m{m}" for p in ("bill_amt", "pay_amt", "pay_status") for m in (2, 5)])
    orders = {r["month_index"]: r["month_order"] for r in panel.build_panel(kept).select("month_index", "month_order").distinct().collect()}
    assert orders == {6: 1, 4: 2, 3: 3, 1: 4}


def test_no_panel_columns_give_an_empty_panel(minimal):
    empty = panel.build_panel(minimal.select("client_id", "age"))
    assert empty.count() == 0 and len(empty.columns) == 9


# ----------------------------------------------------------------- KPIs

def test_kpis_against_pandas(featured):
    got = {r["key"]: r["value"] for r in kpis.calculate_kpis(featured).collect()}
    data = featured.toPandas()
    assert len(got) == 30
    assert got["observed_default_rate"] == pytest.approx(data["default_next_month"].mean() * 100)
    assert got["median_utilisation"] == pytest.approx(data["utilisation_latest"].median() * 100)
    assert got["total_outstanding_balance"] == pytest.approx(data["bill_amt_m1"].sum())
    assert got["share_growing_balance"] == pytest.approx((data["bill_trend_slope"] > 0).mean() * 100)
    assert got["client_month_records"] == 2400 and got["total_clients"] == 400


def test_flag_shares_count_null_as_false(featured):
    holes = featured.withColumn("is_revolver", F.expr("IF(client_id % 2 = 0, NULL, true)"))
    got = {r["key"]: r["value"] for r in kpis.calculate_kpis(holes).collect()}
    assert got["revolver_share"] == 50.0


def test_kpis_that_cannot_be_computed_say_why(minimal):
    table = kpis.calculate_kpis(minimal.drop("age"))
    rows = {r["key"]: r for r in table.collect()}
    assert rows["avg_age"]["value"] is None and "age" in rows["avg_age"]["reason"] and rows["avg_age"]["formatted"] == "n/a"
    assert rows["total_clients"]["value"] == 6 and rows["total_clients"]["insufficient_data"]
    empty = kpis.calculate_kpis(minimal.limit(0))
    assert kpis.available(empty).count() == 0


def test_deltas_know_good_from_bad(featured):
    portfolio = kpis.calculate_kpis(featured)
    own = kpis.calculate_kpis(featured.filter("default_next_month = 1"))
    rows = {r["key"]: r for r in kpis.kpi_deltas(own, portfolio).collect()}
    assert rows["avg_utilisation"]["verdict"] == "bad" and "pp" in rows["avg_utilisation"]["text"]
    assert all(r["is_flat"] for r in kpis.kpi_deltas(portfolio, portfolio).collect())


# ----------------------------------------------------------------- trends

def points(spark, values, measure="m"):
    rows = [(measure, 7 - i, v.MONTH_LABELS.get(7 - i, f"Month {7 - i}"), i, float(x), 10) for i, x in enumerate(values, start=1)]
    return spark.createDataFrame(rows, "measure string, month_index int, month_label string, month_order int, value double, n long")


def test_trend_of_a_straight_line(spark):
    t = trends.assemble_trends(points(spark, [10, 20, 30, 40, 50, 60])).first()
    assert (t["total_change"], t["total_change_pct"], t["average_change"], t["direction"], t["peak"], t["trough"]) == (50, 500, 10, "increasing", "Sep 2005", "Apr 2005")
    assert t["slope"] == pytest.approx(10) and t["anomalies"] == ""


@pytest.mark.parametrize("values, direction", [([100, 101], "flat"), ([100, 97], "decreasing"), ([0, 5], "increasing"), ([0, 0], "flat"), ([-10, -5], "increasing")])
def test_direction(spark, values, direction):
    assert trends.assemble_trends(points(spark, values)).first()["direction"] == direction


def test_a_spike_is_flagged_and_a_calm_series_is_not(spark):
    assert trends.assemble_trends(points(spark, [10, 11, 12.5, 13, 60, 61])).first()["anomalies"] == "May 2005".replace("May", "Aug")
    assert trends.assemble_trends(points(spark, [10, 20, 30, 40, 50, 60])).first()["anomalies"] == ""
    assert trends.assemble_trends(points(spark, [1, 2, 50])).first()["anomalies"] == ""


def test_a_lone_deviation_with_zero_mad(spark):
    flagged = trends.flag_anomalies(trends.period_changes(points(spark, [10, 20, 30, 40, 50, 60, 70, 500])))
    assert [r["month_order"] for r in flagged.filter("is_anomaly").collect()] == [8]


def test_one_period_is_no_trend(spark):
    t = trends.assemble_trends(points(spark, [5])).first()
    assert t["status"] == "unavailable" and t["slope"] is None


def test_the_two_delinquency_rates_differ_on_nulls(minimal):
    holes = minimal.withColumn("pay_status_m1", F.expr("IF(client_id <= 2, NULL, pay_status_m1)"))
    long = panel.build_panel(holes)
    trend = trends.measure_points(long, ["delinquency_rate"]).filter("month_index = 1").first()
    summary = trends.panel_summary(long).filter("month_index = 1").first()
    assert (trend["value"], trend["n"]) == (25.0, 4) and summary["delinquency_rate_pct"] == pytest.approx(100 / 6)


def test_forecasts_are_refused(minimal):
    rows = {r["capability"]: r["supported"] for r in trends.temporal_capability(minimal).collect()}
    assert rows["period_comparison"] and not rows["forecasting"] and not rows["daily_weekly"]
