"""The operators that replace a single-task sort, against brute force, with a third of the rows on one value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.functions.tables import agg
from ledgerlens.operators import correlation, duplicates, quantiles, ranking, selection


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(60_000).selectExpr(
        "id", "IF(id % 3 = 0, 7D, (pmod(xxhash64(id), 1000003) / 1000D)) AS x", "double(id % 17) AS y",
        "IF(id % 11 = 0, NULL, double(pmod(xxhash64(id, 'z'), 50))) AS z", "id % 2 AS g").cache()


def test_quantiles_equal_numpy(skewed):
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.995, 1.0)
    got = {(r["feature"], r["prob"]): r["quantile"] for r in quantiles.quantiles(skewed, ["x", "y", "z"], probs).collect()}
    data = skewed.toPandas()
    for c in ("x", "y", "z"):
        for p in probs:
            assert got[c, p] == pytest.approx(data[c].quantile(p), rel=1e-12), (c, p)


@pytest.mark.parametrize("n", [1, 2, 3, 999, 5000])
def test_quantiles_at_every_size(spark, n):
    df = spark.range(n).selectExpr("double(pmod(xxhash64(id), 1000)) AS x")
    got = {r["prob"]: r["quantile"] for r in quantiles.quantiles(df, ["x"], (0.1, 0.5, 0.9)).collect()}
    values = df.toPandas()["x"]
    assert got == {p: pytest.approx(values.quantile(p)) for p in (0.1, 0.5, 0.9)}


def test_quantiles_of_hostile_doubles(spark):
    """Both signs, zeros, the smallest and greatest doubles, neighbours in the last bit: order statistics are exact."""
    rng = np.random.default_rng(4)
    bits = rng.integers(-(1 << 63), (1 << 63) - 1, 3_000).view(np.float64)
    near = 1 + np.arange(400) * np.finfo(float).eps
    x = np.concatenate([bits[np.isfinite(bits)], near, -near, [0.0, -0.0, 5e-324, -5e-324, 1e-323, 1.7976931348623157e308, -1.7976931348623157e308]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = tuple(float(k / (len(x) - 1)) for k in rng.choice(len(x), 25, replace=False))
    got = {r["prob"]: r["quantile"] for r in quantiles.quantiles(df, ["x"], probs).collect()}
    ordered = np.sort(x)
    for p in probs:
        at = p * (len(x) - 1)
        below, above = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        with np.errstate(over="ignore"):
            assert got[p] == below + (above - below) * (at - np.floor(at)), p


def test_quantiles_without_values(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 1D AS y")
    assert [tuple(r) for r in quantiles.quantiles(df, ["x", "y"], (0.5,)).collect()] == [("y", 0.5, 1, 1.0)]
    assert quantiles.quantiles(df.limit(0), ["x"], (0.5,), by=["y"]).count() == 0


@pytest.mark.parametrize("held", [10_000, 2])
def test_grouped_quantiles(skewed, held, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", held)
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantiles.quantiles(skewed, ["x"], (0.5, 0.9), by=["g"]).collect()}
    data = skewed.toPandas()
    for g, part in data.groupby("g"):
        for p in (0.5, 0.9):
            assert got[g, p] == pytest.approx(part["x"].quantile(p))
    nulls = skewed.selectExpr("IF(g = 0, NULL, g) AS g", "y")
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantiles.quantiles(nulls, ["y"], (0.5,), by=["g"]).collect()}
    assert got == {(None if g == 0 else g, 0.5): part["y"].quantile(0.5) for g, part in data.groupby("g")}


def rounds_of(monkeypatch):
    calls, plain = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: calls.append(a) or plain(*a))
    return calls


def test_small_ranges_take_one_round(spark, monkeypatch):
    """Neighbours in the last bit: steps need two rounds, a range of few rows is counted by its values."""
    calls = rounds_of(monkeypatch)
    x = np.concatenate([1 + np.arange(400) * np.finfo(float).eps, [1.001]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert [r["quantile"] for r in quantiles.quantiles(df, ["x"], (0.5,)).collect()] == [np.sort(x)[200]]
    assert len(calls) == 1


@pytest.mark.parametrize("steps", [16, 4_096])
def test_large_ranges_are_dealt_to_steps(skewed, steps, monkeypatch):
    calls = rounds_of(monkeypatch)
    monkeypatch.setattr(quantiles, "STEPS", steps)
    monkeypatch.setattr(quantiles, "OCTAVE", 1)
    got = {(r["feature"], r["prob"]): r["quantile"] for r in quantiles.quantiles(skewed, ["x", "z"], (0.1, 0.5, 0.9)).collect()}
    data = skewed.toPandas()
    assert got == {(c, p): pytest.approx(data[c].quantile(p), rel=1e-12) for c in ("x", "z") for p in (0.1, 0.5, 0.9)}
    assert len(calls) > 1


def test_kept_tables_have_as_many_partitions_as_they_need(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    change = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.unset(change)
    kept = session.reuse(spark.range(10_000).selectExpr("id % 999 AS g").groupBy("g").count())
    assert kept.count() == 999 and kept.rdd.getNumPartitions() <= 8
    kept.unpersist()
    spark.conf.set(change, "false")  # the session's own choice stays
    session.reuse(spark.range(1)).unpersist()
    assert spark.conf.get(change) == "false"
    spark.conf.unset(change)
    spark.conf.set("spark.sql.shuffle.partitions", own)


def test_the_matrix_computes_its_pairs_once(skewed):
    found = correlation.matrix(correlation.pearson_pairs(skewed, ["x", "y", "z"]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    cells = {(r["row"], r["column"]): r["correlation"] for r in found.collect()}
    data = skewed.toPandas()[["x", "y", "z"]].corr()
    assert cells == {(a, b): pytest.approx(data.loc[a, b]) for a in "xyz" for b in "xyz"}


def test_spearman_ranks_are_computed_once_for_both_scans(skewed):
    found = correlation.spearman_pairs(skewed, ["x", "y", "z"], ["id"])
    assert "InMemoryRelation [ranks" in found._jdf.queryExecution().withCachedData().toString()
    data = skewed.toPandas()[["x", "y", "z"]]
    assert {(r["left"], r["right"]): r["correlation"] for r in found.collect()} == {
        (a, b): pytest.approx(data[[a, b]].dropna().rank().corr().iloc[0, 1]) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))}


def test_complete_cases_of_the_tree_are_computed_once(spark, monkeypatch):
    from ledgerlens.operators import drivers

    kept = []
    monkeypatch.setattr(session, "reuse", lambda df, plain=session.reuse: kept.append(plain(df)) or kept[-1])
    df = spark.range(400).selectExpr("int(id % 2) AS y", "IF(id % 7 = 0, NULL, double(id % 2 + id % 3)) AS x")
    assert drivers.tree_importance(df, "y", ["x"]).first()["n_used"] == 342
    assert len(kept) == 1 and not kept[0].is_cached


def test_lines_neither_paid_nor_returned_stay_out_of_the_shuffle(spark, tmp_path):
    from ledgerlens.plans import star

    spark.sql("SELECT 1L AS c_custkey, 3 AS c_nationkey, 5D AS c_acctbal UNION ALL SELECT 2L, 4, 6D").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, 1 + id % 2 AS o_custkey, 10D AS o_totalprice, 'P' AS o_orderstatus, TIMESTAMP '2000-05-01' AS o_orderdate FROM range(4)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id % 4 AS l_orderkey, IF(id % 4 = 0, 'A', element_at(array('N', 'R', NULL, 'A'), 1 + int(id DIV 4) % 4)) AS l_returnflag, "
              "8D AS l_extendedprice, 0.5D AS l_discount FROM range(32)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = star.clients(spark, str(tmp_path))
    got = {r["client_id"]: (r["bill_amt_m1"], r["pay_amt_m1"], r["pay_status_m1"]) for r in found.collect()}
    assert got == {1: (20.0, 8.0, 0), 2: (20.0, 16.0, 2)}
    assert "l_returnflag#" in found._jdf.queryExecution().optimizedPlan().toString().split("Filter (")[-1].split("+- Relation")[0]


def test_sliced_ranks_equal_pandas(skewed):
    counts = agg(skewed.selectExpr("'x' AS f", "x AS value"), {"rows": "count(*)"}, ["f", "value"])
    got = {r["value"]: r["rank"] for r in ranking.value_ranks(counts, ["f"], small=False).collect()}
    data = skewed.toPandas()["x"]
    wanted = pd.Series(data.rank().to_numpy(), index=data.to_numpy()).groupby(level=0).first()
    assert got == {k: float(x) for k, x in wanted.items()}


def test_ranks_reach_every_row_through_the_hot_value_path(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 10)
    long = skewed.selectExpr("id", "'x' AS f", "x AS value")
    got = ranking.attach_ranks(long, ["f"]).select("id", "rank").toPandas().sort_values("id")
    assert len(got) == 60_000
    assert np.allclose(got["rank"].astype(float).to_numpy(), skewed.orderBy("id").toPandas()["x"].rank().to_numpy())


def test_running_totals_across_slices(spark):
    df = spark.range(1_000).selectExpr("id % 3 AS k", "id AS o", "id % 7 AS v")
    got = ranking.running_before(df, ["k"], "o", ["v"], small=False).toPandas().sort_values(["k", "o"])
    wanted = got.groupby("k")["v"].cumsum() - got["v"]
    assert (got["v_before"] == wanted).all()


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations_are_pairwise_complete(skewed, method):
    part = skewed.filter("id < 1500")
    got = correlation.correlation_pairs(part, ["x", "y", "z"], method, key=("id",)).collect()
    data = part.toPandas()
    assert len(got) == 3
    for r in got:
        pair = data[[r["left"], r["right"]]].dropna()
        assert r["n"] == len(pair)
        if method == "kendall":
            a, b = pair[r["left"]].to_numpy(), pair[r["right"]].to_numpy()
            sa, sb = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
            wanted = (sa * sb).sum() / np.sqrt(np.abs(sa).sum() * np.abs(sb).sum())
        else:
            wanted = pair.corr(method=method).iloc[0, 1]
        assert r["correlation"] == pytest.approx(wanted, abs=1e-12)


def test_a_key_that_repeats_is_refused_for_ranks(spark):
    rows = spark.sql("SELECT 1L AS id, double(id) AS a, double(id * 3 % 5) AS b FROM range(20)")
    with pytest.raises(Exception, match="key does not identify"):
        correlation.spearman_pairs(rows, ["a", "b"], ("id",)).collect()


def test_duplicates_with_one_dominant_payload(spark):
    df = spark.range(9_000).selectExpr("id AS client_id", "IF(id % 3 = 0, 0L, id) AS a", "IF(id % 3 = 0, NULL, 'x') AS b")
    flagged = duplicates.flag_ignoring_key(df)
    assert flagged.count() == 9_000 and flagged.filter("is_duplicate_excluding_id").count() == 3_000
    kept = duplicates.drop_ignoring_key(df)
    assert kept.count() == 6_001 and kept.filter("b IS NULL").first()["client_id"] == 0
    counts = duplicates.duplicate_counts(df).first()
    assert (counts["exact_duplicates"], counts["duplicates_without_id"], counts["repeated_ids"]) == (0, 2_999, 0)


def test_duplicate_counts_hash_the_rows_once(spark, capsys):
    df = spark.range(60).selectExpr("IF(id < 50, id, 7L) AS client_id", "IF(id < 50, id % 40, 3L) AS a", "CAST(NULL AS STRING) AS b")
    counts = duplicates.duplicate_counts(df)
    assert counts.first().asDict() == {"rows": 60, "exact_duplicates": 9, "duplicates_without_id": 20, "repeated_ids": 10, "rows_in_duplicate_groups": 30}
    counts.explain("formatted")
    plan = capsys.readouterr().out.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    assert plan.count("xxhash64(second") <= 2  # one projection, listed once


def test_wide_features_never_run_in_a_method_too_long_to_compile(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    session.reuse(spark.range(1)).unpersist()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "20000")  # the session's own limit stays
    session.reuse(spark.range(1)).unpersist()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "20000"
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_checkpoint_folder_is_read_from_the_session(spark, tmp_path):
    assert session.pin(spark.range(5)).count() == 5
    assert spark.sparkContext.getCheckpointDir() is not None


def test_scan_reads_only_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id AS client_id", "int(id % 60 + 20) AS age", "double(id) AS credit_limit", "'x' AS other").write.parquet(path)
    from ledgerlens.operators import selection

    df = spark.read.parquet(path)
    chosen = selection.apply(df, selection.Spec(age=(30, 40), limit=(5.0, 50.0)), selection.Bounds(age=(20, 79), limit=(0, 99)))
    plan = chosen.data.select("client_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(age), IsNotNull(credit_limit)" in plan and "other" not in plan.split("ReadSchema")[1]
    assert F is not None


def test_pages_by_ranges(spark):
    df = spark.range(0, 3000).selectExpr("IF(id % 100 = 3, NULL, pmod(xxhash64(id), 100000)) AS k", "id AS v").repartition(5)
    wanted = [r["k"] for r in df.orderBy("k").collect()]
    for ranges in (1, 7):
        pages = selection.pages(df, 70, "k", ranges)
        assert pages.n_rows == 3000
        found = [[r["k"] for r in pages.page(n).collect()] for n in (1, 2, 20, 43, 44)]
        assert found == [wanted[(n - 1) * 70:n * 70] for n in (1, 2, 20, 43, 44)]
    assert selection.pages(df.limit(0), 70, "k").page(1).count() == 0
    plan = selection.pages(df, 70, "k", 7).page(20)._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" in plan and "<=" in plan  # the key range is a filter


def test_correlations_by_cross_sums(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 6)) * [1, 1e3, 1e-3, 1, 1, 1] + [0, 1e6, 5, 0, 0, 0]
    x[:, 1] += 500 * x[:, 0]
    x[:, 3] = 7.1  # no variance
    data = pd.DataFrame(x, columns=list("abcdef"))
    data.loc[rng.random(500) < 0.3, "e"] = np.nan
    data.loc[5:, "f"] = np.nan  # few pairs
    got = {(r["left"], r["right"]): (r["correlation"], r["n"]) for r in correlation.pearson_pairs(spark.createDataFrame(data).repartition(3), list("abcdef")).collect()}
    for i, p in enumerate("abcdef"):
        for q in "abcdef"[i + 1:]:
            r, n = got[p, q]
            wanted = data[p].corr(data[q])
            assert n == (data[p].notna() & data[q].notna()).sum()
            assert r is None if "d" in (p, q) else r == pytest.approx(wanted, abs=1e-9), (p, q)


def test_a_scan_that_does_not_read_the_duplicate_flag_looks_nothing_up(spark):
    df = spark.range(300).selectExpr("id AS client_id", "IF(id < 200, id % 100, NULL) AS a", "double(id % 2) AS b")
    flagged = duplicates.flag_ignoring_key(df)
    assert flagged.columns == ["client_id", "a", "b", "is_duplicate_excluding_id"]
    assert flagged.filter("is_duplicate_excluding_id").count() == 300  # 100 pairs, and two payloads with a null
    plan = flagged.selectExpr("sum(a)", "count_if(b > 0)")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and "Join" not in plan
    assert flagged.selectExpr("count_if(is_duplicate_excluding_id) AS n").first()["n"] == 300  # also inside an aggregation


def test_kendall_reads_the_rows_once(spark, monkeypatch):
    small = []
    real = correlation.running_before
    monkeypatch.setattr(correlation, "running_before", lambda *a: small.append(a[4] if len(a) > 4 else None) or real(*a))
    df = spark.range(2_000).selectExpr("double(id % 7) AS x", "double(id * 11 % 13) AS y", "double(id % 5) AS z")
    got = correlation.kendall_pairs(df, ["x", "y", "z"])
    leaves = got._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {leaves.apply(i).nodeName().split()[0] for i in range(leaves.size())} == {"InMemoryRelation"}
    assert small[-1] is True  # a few cells are no reason to write slices, whatever the plan expects of a join
    assert got.count() == 3
