import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.operators import drivers, eda, findings, line, profile, quality, segments, selection
from ledgerlens.plans import pipeline
from ledgerlens.sources import files

T = v.TARGET
CAUSAL = re.compile(r"\b(causes?|caused|because of|leads? to|results? in|due to|will default|predicts?)\b", re.I)


# ------------------------------------------------------------ profile, quality

def test_contract_checks(minimal, edge):
    checks = {r["check"]: r for r in profile.validate(minimal).collect()}
    assert len(checks) == 16 and profile.is_valid(profile.validate(minimal)) and not checks["row_count"]["passed"]
    assert not profile.is_valid(profile.validate(minimal, strict=True))
    assert not profile.is_valid(profile.validate(minimal.drop(T)))
    found = {r["check"]: r["affected"] for r in profile.validate(edge).collect()}
    assert found["limit_positive"] == 2 and found["age_plausible"] == 1
    assert not profile.is_valid(profile.validate(minimal.limit(0)))


def test_quality_of_edge_cases(edge):
    issues = {(r["check"], r["column"]): r for r in quality.issues(edge).collect()}
    assert issues["value_out_of_range", "credit_limit"]["severity"] == "high" and issues["value_out_of_range", "credit_limit"]["affected_rows"] == 2
    assert issues["undocumented_category_code", "education_code"]["affected_rows"] == 2
    assert issues["duplicate_rows_excluding_id", None]["affected_rows"] == 1
    score = quality.quality_score(edge).first()
    assert score["invalid_cells"] == 2 + 1 + 2 + 1 and score["cells_checked"] == 9 * 12
    assert score["uniqueness"] == pytest.approx(8 / 9) and score["completeness"] == 1.0
    assert score["score"] == pytest.approx(30 + 20 * 8 / 9 + 35 * (1 - 6 / 108) + 15 * score["consistency"])


def test_contradictions_count_a_client_once(minimal):
    odd = minimal.withColumns({"pay_status_m1": F.lit(-1), "pay_status_m2": F.lit(-1), "pay_amt_m1": F.lit(0.0), "pay_amt_m2": F.lit(0.0)})
    row = quality.consistency(odd).filter("check = 'status_payment_contradiction'").first()
    assert (row["affected_rows"], row["records"], row["by_month"]["Sep 2005"]) == (6, 12, 6)


def test_empty_and_constant_columns(minimal):
    rows = {r["column"]: r["check"] for r in quality.constant_issues(minimal.withColumns({"c": F.lit(1), "e": F.lit(None).cast("int")})).collect()}
    assert (rows["c"], rows["e"]) == ("constant_column", "empty_column") and "age" not in rows


# ------------------------------------------------------------------------- eda

def test_summary_equals_pandas(featured):
    columns = ["credit_limit", "utilisation_latest", "months_zero_payment"]
    data = featured.select(*columns).toPandas()
    for r in eda.numeric_summary(featured, columns).collect():
        x = data[r["column"]].astype(float)
        for name, wanted in (("mean", x.mean()), ("std", x.std()), ("skewness", x.skew()), ("kurtosis", x.kurt()), ("q1", x.quantile(0.25)), ("median", x.median())):
            assert r[name] == pytest.approx(wanted, rel=1e-9), (r["column"], name)


def test_histogram_equals_numpy_and_refuses_constants(featured, spark):
    got = [r["count"] for r in eda.histogram(featured, "age", 10).orderBy("bin").collect()]
    assert got == np.histogram(featured.toPandas()["age"], bins=10)[0].tolist()
    assert eda.histogram(spark.sql("SELECT 1D AS x FROM range(5)"), "x").columns[0] == "analysis"


def test_outliers_fall_back_when_spread_is_zero(spark):
    df = spark.range(50).selectExpr("double(IF(id = 0, 1000, 5)) AS spike", "double(IF(id < 20, id, 50)) AS mad", "5D AS same")
    rows = {r["column"]: r for r in eda.outlier_analysis(df, ["spike", "mad", "same"]).collect()}
    assert "modal" in rows["spike"]["method"] and rows["spike"]["n_outliers"] == 1 and "same" not in rows


def test_small_groups_stay_but_cannot_rank(featured):
    few = featured.withColumn("g", F.expr("IF(client_id <= 10, 'tiny', IF(client_id % 2 = 0, 'a', 'b'))")).withColumn(T, F.expr(f"IF(g = 'tiny', 1, {T})"))
    rates = eda.outcome_rates(few, "g")
    assert not {r["g"]: r["meets_min_size"] for r in rates.collect()}["tiny"]
    assert eda.outcome_extremes(rates, "g").first()["highest_category"] in ("a", "b")


def test_frequency_shares_sum_to_hundred_after_top_n(featured):
    rows = eda.frequency(featured, "education", top_n=2).collect()
    assert len(rows) == 2 and sum(r["percentage"] for r in rows) == pytest.approx(100)


# --------------------------------------------------------------------- drivers

@pytest.fixture(scope="module")
def analysis(featured):
    return drivers.run_drivers(featured)


def test_planted_signal_is_found(analysis):
    rows = {r["feature"]: r for r in analysis["correlations"].collect()}
    assert rows["utilisation_latest"]["effect_size"] > 0.5 and rows["utilisation_latest"]["p_value"] < 1e-6
    assert rows["delinquent_months_count"]["direction"] == "positive" and rows["age"]["strength"] in ("negligible", "weak")
    top = analysis["consensus"].first()
    assert top["n_methods_non_negligible"] >= 2


def test_protected_columns_are_never_drivers(featured):
    numeric, categorical = drivers.candidate_features(featured)
    assert not {"client_id", "sex", "sex_code", "marriage", "marriage_code", "education_code", T} & set(numeric + categorical)
    assert "education" in categorical and "is_revolver" in numeric


def test_driver_sentences_claim_no_cause(analysis):
    for r in analysis["sentences"].collect():
        assert not CAUSAL.search(r["sentence"]), r["sentence"]


def test_mann_whitney_of_separated_classes(spark):
    df = spark.range(40).selectExpr("double(id) AS x", "int(id >= 20) AS y")
    row = drivers.mann_whitney(drivers.ranked_values(df, "y", ["x"])).first()
    assert row["statistic"] == 400 and row["effect_size"] == 1.0 and row["p_value"] == pytest.approx(6.8e-8, rel=0.02)


def test_driver_refusals(featured):
    assert "status" in drivers.run_drivers(featured.limit(20)) and "status" in drivers.run_drivers(featured.drop(T))
    assert "one class" in drivers.run_drivers(featured.withColumn(T, F.lit(0)))["status"].first()["reason"]


# -------------------------------------------------------------------- segments

CONFIG = segments.Config(k_max=4, n_init=3, silhouette_sample=150)


@pytest.fixture(scope="module")
def segmented(featured):
    return segments.run_segmentation(featured, CONFIG)


def test_every_client_gets_one_segment(segmented, featured):
    labels = segmented["labels"]
    assert labels.count() == labels.select("client_id").distinct().count() == featured.count()
    named = segmented["segments"].collect()
    assert sum(r["share_pct"] for r in named) == pytest.approx(100)
    sizes = [r["size"] for r in sorted(named, key=lambda r: r["cluster"])]
    assert sizes == sorted(sizes, reverse=True)


def test_the_outcome_cannot_influence_the_segments(segmented, featured):
    flipped = featured.withColumn(T, 1 - F.col(T))
    again = segments.run_segmentation(flipped, CONFIG)["labels"].select("client_id", "cluster").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in segmented["labels"].select("client_id", "cluster").collect()}


def test_forbidden_features_are_refused():
    for bad in ("default_next_month", "age", "sex_code", "client_id"):
        with pytest.raises(ValueError, match="may not be clustered"):
            segments.Config(features=("credit_limit", bad))


def test_segmentation_refuses_small_selections(featured):
    assert "Too few" in segments.run_segmentation(featured.limit(100), CONFIG)["status"].first()["reason"]


def test_samples_keep_every_cluster(spark):
    rows = spark.range(5_000).selectExpr("id AS client_id", "int(IF(id < 3, 1, 0)) AS cluster")
    got = {r["cluster"]: r["count"] for r in segments.stratified_sample(rows, 100).groupBy("cluster").count().collect()}
    assert got == {0: 100, 1: 2}
    again = segments.stratified_sample(rows, 100).select("client_id")
    assert again.exceptAll(segments.stratified_sample(rows, 100).select("client_id")).count() == 0


def test_silhouette_equals_the_definition(spark):
    rows = spark.range(60).selectExpr("id AS client_id", "int(id % 3) AS cluster", "double(id % 3 * 2 + pmod(xxhash64(id), 100) / 80D) AS z_a", "double(pmod(xxhash64(id, 1), 100) / 50D) AS z_b")
    data = rows.toPandas()
    x, c = data[["z_a", "z_b"]].to_numpy(), data["cluster"].to_numpy()
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(60):
        a = gap[i][(c == c[i]) & (np.arange(60) != i)].mean()
        b = min(gap[i][c == o].mean() for o in set(c) - {c[i]})
        scores.append((b - a) / max(a, b))
    assert segments.silhouette(rows, ["a", "b"]).first()["silhouette"] == pytest.approx(np.mean(scores))
    assert segments.silhouette(rows.filter("cluster = 0"), ["a", "b"]).first()["silhouette"] is None


def test_separated_groups_are_recovered(spark):
    rows = spark.range(900).selectExpr("id AS client_id", "double(id % 3 * 10 + pmod(xxhash64(id), 100) / 100D) AS z_a", "double(id % 3 * -5 + pmod(xxhash64(id, 1), 100) / 100D) AS z_b").cache()
    model = segments.fit_many(rows, ["a", "b"], [3], segments.Config(n_init=2))[3]
    pairs = segments.assign(model, rows).selectExpr("cluster", "client_id % 3 AS truth").distinct().collect()
    assert len(pairs) == 3


@pytest.mark.parametrize(("k", "column"), [(2, "x"), (3, "x"), (3, "few"), (4, "x"), (3, "far")])
def test_one_feature_gets_the_best_of_all_cuts(spark, monkeypatch, k, column):
    monkeypatch.setattr(line, "BLOCKS", 16)
    rows = spark.range(240).selectExpr("id AS client_id", "pow(pmod(xxhash64(id), 997) / 300D, 2) AS x", "double(pmod(xxhash64(id), 7)) AS few",
                                       "IF(id % 40 = 0, 1e6D * id, pmod(xxhash64(id), 997) / 1e3D) AS far").selectExpr("client_id", f"{column} AS z_a").cache()
    model = segments.fit_many(rows, ["a"], [k], segments.Config(n_init=1, tolerance=0.0))[k]
    x = np.sort(rows.toPandas()["z_a"].to_numpy())
    one, two = np.concatenate([[0], x.cumsum()]), np.concatenate([[0], (x * x).cumsum()])
    n = np.arange(241)
    size = np.maximum(n[None] - n[:, None], 1)
    cost = np.where(n[None] >= n[:, None], two[None] - two[:, None] - (one[None] - one[:, None]) ** 2 / size, np.inf)
    best = cost[0]
    for _ in range(k - 1):
        best = (best[:, None] + cost).min(axis=0)
    assert model.inertia == pytest.approx(best[-1], rel=1e-9) and model.centres.shape == (k, 1)
    near = np.abs(x[:, None] - model.centres[:, 0]).min(axis=1)
    assert (near ** 2).sum() == pytest.approx(best[-1], rel=1e-9)


def test_one_feature_of_one_value(spark):
    model = segments.fit_many(spark.range(9).selectExpr("id AS client_id", "2D AS z_a"), ["a"], [2])[2]
    assert model.inertia == 0 and model.centres.tolist() == [[2.0], [2.0]]


def test_runs_settle_on_the_starting_rows(spark):
    """Without groups in the rows K-Means is slow; what a bounded sample can do needs no pass over all rows."""
    rows = spark.range(20_000).selectExpr("id AS client_id", "pmod(xxhash64(id), 10007) / 1e4D AS z_a", "pmod(xxhash64(id, 1), 10007) / 1e4D AS z_b").cache()
    model = segments.fit_many(rows, ["a", "b"], [8], segments.Config(n_init=4))[8]
    assert model.iterations <= 2
    x = rows.select("z_a", "z_b").toPandas().to_numpy()
    near = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    again = np.array([x[near == g].mean(axis=0) for g in range(8)])
    assert ((again - model.centres) ** 2).sum() <= 1e-4 * x.var(axis=0).mean()


def test_elbow():
    assert segments.elbow([(2, 100.0), (3, 20.0), (4, 15.0), (5, 10.0)]) == 3
    assert segments.elbow([(2, 5.0)]) == 2 and segments.elbow([(2, 5.0), (3, 5.0), (4, 5.0)]) == 2


def test_centred_projection_has_a_fixed_sign(featured):
    prepared = segments.prepare(featured)
    points, shares = segments.project_2d(prepared.data, prepared.features)
    row = points.selectExpr("avg(pc1) m1", "avg(pc2) m2").first()
    assert abs(row["m1"]) < 1e-6 and abs(row["m2"]) < 1e-6 and shares[0] >= shares[1] > 0


# ------------------------------------------------------- findings and signals

@pytest.fixture(scope="module")
def found(featured):
    return findings.key_findings(featured).cache()


def test_planted_gradients_fire_with_evidence(found):
    rows = {r["key"]: r for r in found.collect()}
    assert {"delinquency_gradient", "utilisation_gradient"} <= set(rows)
    assert findings.unsupported(found).count() == 0
    d = rows["delinquency_gradient"]
    assert d["evidence"][1]["value"] - d["evidence"][0]["value"] >= 3 and d["severity"] in ("high", "critical")


def test_finding_text_claims_no_cause(found):
    for r in found.collect():
        for part in ("title", "fact", "insight", "implication", "action"):
            assert r[part] and not CAUSAL.search(r[part]), r[part]


def test_findings_need_rows_and_two_classes(featured):
    assert findings.key_findings(featured.limit(50)).count() == 0
    assert findings.key_findings(featured.withColumn(T, F.lit(1))).count() == 0
    assert findings.key_findings(featured.drop(T)).count() == 0
    assert findings.refusal(featured.limit(50)).count() == 1 and findings.refusal(featured).count() == 0


@pytest.mark.parametrize("share, spread, wanted", [(5, 0, 1), (12, 0, 2), (12, 20, 3), (12, 35, 4), (45, 40, 4), (0, 50, 2)])
def test_gradient_severity(spark, share, spread, wanted):
    assert spark.range(1).selectExpr(findings.gradient_severity(str(share), str(spread))).first()[0] == wanted


def test_signals_are_shares_with_bounded_intensity(featured):
    rows = findings.signals(featured).collect()
    assert all(0 <= r["intensity"] <= 1 and 0 <= r["value"] <= 100 for r in rows) and {r["kind"] for r in rows} == {"risk", "opportunity"}


# ------------------------------------------------------------------ selections

def test_selection_semantics(featured):
    b = selection.derive_bounds(featured)
    assert selection.is_default(selection.default_spec(b), b) and not selection.apply(featured, selection.default_spec(b), b).is_filtered
    assert selection.apply(featured, selection.Spec(education=()), b).data.count() == 0
    assert selection.apply(featured.drop("sex"), selection.Spec(sex=("Male",)), b).skipped == ("sex",)
    never = selection.apply(featured, selection.Spec(delinquency="never"), b).data.count()
    ever = selection.apply(featured, selection.Spec(delinquency="ever"), b).data.count()
    assert never + ever == 400


def test_full_utilisation_range_keeps_the_tail(featured):
    b = selection.derive_bounds(featured)
    assert selection.apply(featured, selection.Spec(utilisation=b.utilisation), b).data.count() == 400


def test_search_modes(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a.b'), ('axb'), (null) AS t(x)")
    assert selection.search(rows, "A.B").count() == 2 and selection.search(rows, "A.B", literal=True).count() == 1


# --------------------------------------------------------------- files and runs

HEADER = "ID,LIMIT_BAL,SEX,EDUCATION,AGE,PAY_0,BILL_AMT1,PAY_AMT1,default payment next month"


def test_banner_rows_are_skipped(spark, tmp_path):
    (tmp_path / "banner.csv").write_text(f"X1,X2,X3,X4,X5,X6,X7,X8,Y\n{HEADER}\n1,20000,2,2,24,2,3913,0,1\n2,120000,2,2,26,-1,2682,1000,0\n")
    data, meta = files.load_raw(spark, str(tmp_path / "banner.csv"))
    named, unknown = files.normalise_columns(data)
    assert data.count() == 2 and meta.first()["header_row"] == 1 and unknown == []
    assert named.columns[:2] == ["client_id", "credit_limit"] and named.columns[-1] == T


def test_encodings_and_byte_order_marks(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes((HEADER + ",Café Nom\n1,2,1,1,30,0,5,5,0,déjà\n").encode("latin-1"))
    data, meta = files.load_raw(spark, str(tmp_path / "latin.csv"))
    assert meta.first()["encoding"] == "ISO-8859-1" and data.first()["Café Nom"] == "déjà"
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + (HEADER + "\n1,2,1,1,30,0,5,5,0\n").encode())
    data, _ = files.load_raw(spark, str(tmp_path / "bom.csv"))
    assert data.columns[0] == "ID" and data.count() == 1


def test_rows_are_skipped_by_place_and_never_by_content(spark, tmp_path):
    body = "1,20000,2,2,24,2,3913,0,1\n2,120000,2,2,26,-1,2682,1000,0\n"
    for name, banner in (("same.csv", "1,title,,,,,,,"), ("blank.csv", ",X1,X2,X3,X4,X5,X6,X7,Y"), ("narrow.csv", "Clients")):
        (tmp_path / name).write_text(f"{banner}\n{HEADER}\n{body}")
        data, meta = files.load_raw(spark, str(tmp_path / name))
        assert [r["ID"] for r in data.collect()] == ["1", "2"] and meta.first()["header_row"] == 1, name
        assert data.first()["LIMIT_BAL"] == "20000"


def test_an_index_column_keeps_its_place(spark, tmp_path):
    (tmp_path / "index.csv").write_text(f",{HEADER}\n0,1,20000,2,2,24,2,3913,0,1\n1,2,120000,2,2,26,-1,2682,1000,0\n")
    data, _ = files.load_raw(spark, str(tmp_path / "index.csv"))
    assert data.columns[:3] == ["column_1", "ID", "LIMIT_BAL"] and [(r["ID"], r["LIMIT_BAL"]) for r in data.collect()] == [("1", "20000"), ("2", "120000")]


def test_quoted_line_breaks_and_windows_text(spark, tmp_path):
    (tmp_path / "broken.csv").write_text(f'{HEADER},note\n1,2,1,1,30,0,5,5,0,"two\nlines, ""quoted"""\n2,2,1,1,30,0,5,5,0,plain\n')
    data, meta = files.load_raw(spark, str(tmp_path / "broken.csv"))
    assert [r["note"] for r in data.orderBy("ID").collect()] == ['two\nlines, "quoted"', "plain"] and meta.first()["multi_line"]
    (tmp_path / "euro.csv").write_bytes((HEADER + ",note\n1,2,1,1,30,0,5,5,0,5 € “x” é\n").encode("cp1252"))
    data, meta = files.load_raw(spark, str(tmp_path / "euro.csv"))
    assert data.first()["note"] == "5 € “x” é" and meta.first()["encoding"] == "windows-1252" and not meta.first()["multi_line"]


def test_loading_errors_are_distinct(spark, tmp_path):
    with pytest.raises(files.LoadError, match="does not exist"):
        files.find_dataset(spark, str(tmp_path / "nowhere"))
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(files.LoadError, match="No dataset"):
        files.find_dataset(spark, str(tmp_path))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(files.LoadError, match="empty"):
        files.load_raw(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text(HEADER + "\n")
    with pytest.raises(files.LoadError, match="no data rows"):
        files.load_raw(spark, str(tmp_path / "head.csv"))
    with pytest.raises(files.LoadError, match="Unsupported"):
        files.load_raw(spark, str(tmp_path / "notes.txt"))
    (tmp_path / "~$big.csv").write_text("x" * 9_999)
    assert files.find_dataset(spark, str(tmp_path)).endswith("head.csv")


def test_unknown_headers_are_kept():
    assert files.snake_case(" Some  Col-Name (x) ") == "some_col_name_x" and files.snake_case("--") == "unnamed_column"


def test_batch_run_writes_and_reads_back(minimal, tmp_path):
    result = pipeline.run_table(minimal, str(tmp_path))
    assert set(result.saved) == {"clients", "panel"} and result.save_problem is None
    assert result.data.count() == 6 and result.panel.count() == 36
    assert files.load(minimal.sparkSession, result.saved["clients"]).count() == 6
    assert pipeline.as_json(result.quality).first()["json"].startswith("{")


def test_results_survive_a_failed_write(minimal):
    result = pipeline.run_table(minimal, "/proc/nowhere")
    assert result.save_problem and result.data.count() == 6


def test_selection_context(featured):
    context = pipeline.selection_context(featured, selection.Spec(age=(30, 40)))
    assert context["counts"].first()["n_selected"] == context["data"].count() < 400
    assert context["kpis"].filter("key = 'total_records'").first()["value"] == context["data"].count()


def test_segments_of_given_labels_keep_clients_without_a_key_or_with_a_repeated_one(featured, spark, monkeypatch):
    from catalog import portfolio

    varied = featured.withColumn("months_zero_payment", F.col("client_id") % 3)
    first = varied.filter("client_id = 1")
    odd = varied.unionByName(first).unionByName(first.withColumn("client_id", F.lit(None).cast("long")))
    monkeypatch.setattr(portfolio, "feats", lambda *_: odd)
    got = portfolio.given(spark, "")
    assert got.count() == odd.count() == 402
    assert got.filter("default_next_month IS NULL").count() == 0
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_a_repeated_key_counts_once_in_the_profile_of_a_run(featured):
    odd = featured.unionByName(featured.filter("client_id <= 3"))
    profile = segments.run_segmentation(odd, segments.Config(k_min=2, k_max=2, n_init=1), compare=False)["profile"]
    assert sum(r["size"] for r in profile.select("cluster", "size").distinct().collect()) == 403
