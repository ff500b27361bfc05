"""Queries on segments, findings, signals and the composed runs."""

from __future__ import annotations



from catalog.base import feats, raw, rounded, table
from catalog.oracle import DELAY, DELAY_ORD, R, Rs, UTIL_BAND, UTIL_ORD, melted, on_features
from catalog.registry import query
from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg
from ledgerlens.operators import features, findings, segments, selection
from ledgerlens.plans import pipeline

T = v.TARGET
SEG = list(segments.FEATURES)
ZS = [f"z_{c}" for c in SEG]
WHOLE = segments.Config()


# ---------------------------------------------------------------- given labels

FILLED = "fm AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in SEG) + """ FROM feat),
  base AS MATERIALIZED (SELECT client_id, """ + f"{T}, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in SEG) + " FROM feat, fm)"
SCALED = FILLED + ", sm AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in SEG) + """ FROM base),
  z AS MATERIALIZED (SELECT client_id, CAST(client_id % 3 AS INTEGER) AS cluster, """ + ", ".join(f"({c} - a_{c}) / s_{c} AS z_{c}" for c in SEG) + " FROM base, sm)"
ROBUST = FILLED + ", sm AS (SELECT " + ", ".join(
    f"median({c}) AS a_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in SEG) + """ FROM base),
  z AS MATERIALIZED (SELECT client_id, """ + ", ".join(f"({c} - a_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END) AS z_{c}" for c in SEG) + " FROM base, sm)"


def prepared(spark, d, scaler: str = "standard"):
    return segments.prepare(feats(spark, d), segments.Config(scaler=scaler))


def labelled(spark, d):
    return s.project(prepared(spark, d).data, {"cluster": "int(client_id % 3)"})


@query("standard_scaling", on_features(f"SELECT client_id, {Rs(ZS, 5)} FROM z", SCALED))
def _(spark, d):
    return rounded(prepared(spark, d).data.select("client_id", *ZS), 5)


@query("robust_scaling", on_features(f"SELECT client_id, {Rs(ZS, 5)} FROM z", ROBUST))
def _(spark, d):
    return rounded(prepared(spark, d, "robust").data.select("client_id", *ZS), 5)


@query("feature_assessment", on_features(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, {R(f'(count(*) - count({c})) / count(*) * 100', 'missing_pct')}, {R(f'avg({c})', 'mean', 4)}, "
    f"{R(f'stddev_samp({c})', 'std', 4)}, {R(f'skewness({c})', 'skewness', 4)} FROM feat" for c in SEG)))
def _(spark, d):
    return rounded(segments.assess_features(feats(spark, d)).drop("max_abs_corr", "partner"), 4, missing_pct=6)


SQ = " + ".join(f"pow(z.{c} - c.{c}, 2)" for c in ZS)


@query("cluster_metrics", on_features(f"""SELECT CAST(3 AS BIGINT) AS k, sum(n)::BIGINT AS n_rows, {R('sum(within)', 'inertia', 4)}, {R('(SELECT avg(r) FROM db)', 'davies_bouldin')},
    {R('(sum(between_) / 2) / (sum(within) / (sum(n) - 3))', 'calinski_harabasz', 4)}, {R('min(n) / sum(n) * 100', 'smallest_share_pct')} FROM w""",
    SCALED + f""", c AS (SELECT cluster, count(*) AS n, {', '.join(f'avg({x}) AS {x}' for x in ZS)} FROM z GROUP BY 1),
    g AS (SELECT {', '.join(f'avg({x}) AS g_{x}' for x in ZS)} FROM z),
    w AS (SELECT cluster, first(c.n) AS n, sum({SQ}) AS within, avg(sqrt({SQ})) AS scatter, first(c.n * ({' + '.join(f'pow(c.{x} - g_{x}, 2)' for x in ZS)})) AS between_
      FROM z JOIN c USING (cluster), g GROUP BY 1),
    db AS (SELECT a.cluster, max((wa.scatter + wb.scatter) / sqrt({' + '.join(f'pow(a.{x} - b.{x}, 2)' for x in ZS)})) AS r FROM c a JOIN c b ON a.cluster <> b.cluster
      JOIN w wa ON wa.cluster = a.cluster JOIN w wb ON wb.cluster = b.cluster GROUP BY 1)"""))
def _(spark, d):
    out = segments.cluster_metrics(labelled(spark, d), SEG).drop("is_degenerate")
    return rounded(out, 4, davies_bouldin=6, smallest_share_pct=6)


@query("silhouette_given_labels", on_features(f"SELECT {R('avg(CASE WHEN a = b THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')}, count(*) AS sample_rows FROM ab",
    SCALED + f""", ranked AS (SELECT *, count(*) OVER () AS rows_all, count(*) OVER (PARTITION BY cluster) AS rows_own,
      row_number() OVER (PARTITION BY cluster ORDER BY md5('42:' || client_id), client_id) AS place FROM z),
    drawn AS (SELECT * FROM ranked WHERE rows_all <= 5000 OR place <= least(greatest(round_even(5000 * rows_own / rows_all, 0), 2), rows_own)),
    pd AS (SELECT p.client_id, p.cluster, q.cluster AS other, sum(sqrt({' + '.join(f'pow(p.{x} - q.{x}, 2)' for x in ZS)})) AS total, count(*) AS n
      FROM drawn p CROSS JOIN drawn q GROUP BY ALL),
    ab AS (SELECT client_id, max(CASE WHEN cluster = other THEN total / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN total / n END) AS b FROM pd GROUP BY 1)"""))
def _(spark, d):
    return rounded(segments.silhouette(segments.stratified_sample(labelled(spark, d), 5_000), SEG))


PROFILE = FILLED + f""", lab AS (SELECT *, CAST(client_id % 3 AS INTEGER) AS cluster FROM base), mm AS ({melted('lab', SEG, extra='cluster, ' + T)}),
    o AS (SELECT feature, avg(value) AS a, stddev_pop(value) AS sd FROM mm GROUP BY 1),
    prof AS (SELECT cluster, feature, count(*) AS size, avg({T}) * 100 AS rate, avg(value) AS mean, (avg(value) - first(a)) / first(sd) AS zz, first(a) AS a FROM mm JOIN o USING (feature) GROUP BY ALL)"""


def given(spark, d):
    p = segments.prepare(feats(spark, d), segments.Config(scaler="standard"), keep=[T])
    return p.data.selectExpr("client_id", "int(client_id % 3) AS cluster", *[f"{s.name('raw_' + c)} AS {s.name(c)}" for c in SEG], T)


@query("segment_profiles", on_features(f"""SELECT cluster, feature, size, {R('size / (SELECT count(*) FROM feat) * 100', 'share_pct')}, {R('rate', 'observed_default_rate_pct')},
    {R('mean', 'mean', 3)}, {R('zz', 'z', 5)}, {R('a', 'portfolio_mean', 3)} FROM prof""", PROFILE))
def _(spark, d):
    return rounded(segments.profile_segments(given(spark, d), SEG), 3, share_pct=6, observed_default_rate_pct=6, z=5)


@query("segment_names", on_features("""SELECT cluster, size, CASE count(trait) FILTER (WHERE place <= 2) WHEN 0 THEN 'Mid-Range / Typical-Behaviour'
    WHEN 1 THEN max(trait) FILTER (WHERE place = 1) || ' / Otherwise-Typical' ELSE max(trait) FILTER (WHERE place = 1) || ' / ' || max(trait) FILTER (WHERE place = 2) END AS label
    FROM (SELECT cluster, size, row_number() OVER (PARTITION BY cluster ORDER BY abs(zz) DESC) AS place, CASE WHEN abs(zz) >= 0.35 THEN CASE feature """
    + " ".join(f"WHEN '{c}' THEN CASE WHEN zz > 0 THEN '{hi}' ELSE '{lo}' END" for c, (hi, lo) in segments.TRAITS.items())
    + " END END AS trait FROM prof) GROUP BY ALL",
    PROFILE.replace("client_id % 3", "CASE WHEN repayment_ratio_capped_mean > 0.5 THEN 0 WHEN months_zero_payment > 3 THEN 1 ELSE 2 END")))
def _(spark, d):
    g = s.project(given(spark, d), {"cluster": "CASE WHEN repayment_ratio_capped_mean > 0.5 THEN 0 WHEN months_zero_payment > 3 THEN 1 ELSE 2 END"})
    return segments.name_segments(segments.profile_segments(g, SEG)).select("cluster", "size", "label")


@query("segment_profiles_normalised", on_features(f"""SELECT cluster, feature, {R('CASE WHEN hi = lo THEN 0.5 ELSE (mean - lo) / (hi - lo) END', 'normalised', 5)} FROM
    (SELECT *, min(mean) OVER (PARTITION BY feature) AS lo, max(mean) OVER (PARTITION BY feature) AS hi FROM prof)""", PROFILE))
def _(spark, d):
    return rounded(segments.normalised_profiles(segments.profile_segments(given(spark, d), SEG)), 5)


@query("segment_assignment", on_features("SELECT client_id, CASE WHEN client_id % 4 <> 0 THEN 'S' || client_id % 3 END AS segment FROM feat WHERE age > 40"))
def _(spark, d):
    f = feats(spark, d)
    labels = f.filter("client_id % 4 <> 0").selectExpr("client_id", "concat('S', client_id % 3) AS segment")
    return segments.assign_to(f.filter("age > 40").select("client_id"), labels)


@query("segment_shares", on_features(f"""SELECT segment, a.n AS clients, {R('a.p', 'selection_pct')}, {R('b.p', 'portfolio_pct')}, {R('a.p - b.p', 'difference_pp')} FROM
    (SELECT limit_band AS segment, count(*) AS n, count(*) / (SELECT count(*) FROM feat WHERE age > 40) * 100 AS p FROM feat WHERE age > 40 AND limit_band IS NOT NULL GROUP BY 1) a
    JOIN (SELECT limit_band AS segment, count(*) / (SELECT count(*) FROM feat) * 100 AS p FROM feat WHERE limit_band IS NOT NULL GROUP BY 1) b USING (segment)"""))
def _(spark, d):
    f = feats(spark, d).withColumnRenamed("limit_band", "segment")
    out = segments.share_comparison(f.filter("age > 40"), f).drop("portfolio_clients")
    return rounded(out)


@query("segment_interpretation", on_features("SELECT cluster, format('{:,}', size) || ' customers (' || format('{:.1f}', size / (SELECT count(*) FROM feat) * 100) || '% of the portfolio).' AS fact FROM "
       "(SELECT CAST(client_id % 3 AS INTEGER) AS cluster, count(*) AS size FROM feat GROUP BY 1)"))
def _(spark, d):
    named = segments.name_segments(segments.profile_segments(given(spark, d), SEG))
    return segments.interpret(named, 25.0).select("cluster", "fact")


# ------------------------------------------------------------------ clustering

@query("kmeans_segments")
def _(spark, d):
    p = prepared(spark, d)
    data = segments.matrix_of(p)
    model = segments.fit_many(data, p.features, [3], segments.Config())[3]
    return agg(segments.assign(model, data), {"clients": "count(*)"}, ["cluster"])


ONE = "repayment_ratio_capped_mean" if "repayment_ratio_capped_mean" in SEG else SEG[0]


@query("kmeans_one_feature", on_features(f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, centre) - 1 AS INTEGER) AS cluster, n AS clients, {R('centre', 'centre')}, {R('total', 'inertia', 4)}
    FROM (SELECT n, centre, sum(cost) OVER () AS total FROM parts)""",
    SCALED + f""", p AS MATERIALIZED (SELECT i, sum(x) OVER (ORDER BY i) AS s1, sum(x * x) OVER (ORDER BY i) AS s2 FROM (SELECT z_{ONE} AS x, row_number() OVER (ORDER BY z_{ONE}, client_id) AS i FROM z)),
    whole AS (SELECT max(i) AS n, max_by(s1, i) AS t1, max_by(s2, i) AS t2 FROM p),
    best AS (SELECT a.i AS ai, a.s1 AS a1, a.s2 AS a2, b.i AS bi, b.s1 AS b1, b.s2 AS b2 FROM p a JOIN p b ON a.i < b.i, whole WHERE b.i < n
      ORDER BY -a.s1 * a.s1 / a.i - pow(b.s1 - a.s1, 2) / (b.i - a.i) - pow(t1 - b.s1, 2) / (n - b.i) LIMIT 1),
    parts AS (SELECT ai AS n, a1 / ai AS centre, a2 - a1 * a1 / ai AS cost FROM best
      UNION ALL SELECT bi - ai, (b1 - a1) / (bi - ai), (b2 - a2) - pow(b1 - a1, 2) / (bi - ai) FROM best
      UNION ALL SELECT n - bi, (t1 - b1) / (n - bi), (t2 - b2) - pow(t1 - b1, 2) / (n - bi) FROM best, whole)"""))
def _(spark, d):
    """K-Means on one feature, whose best three groups SQL finds by trying every pair of cuts."""
    config = segments.Config(features=(ONE,), scaler="standard", tolerance=0.0)
    p = segments.prepare(feats(spark, d), config)
    data = segments.matrix_of(p)
    model = segments.fit_many(data, p.features, [3], config)[3]
    groups = agg(segments.assign(model, data), {"clients": "count(*)", "centre": f"avg(z_{ONE})"}, ["cluster"])
    return rounded(groups.selectExpr("*", f"{s.number(model.inertia)} AS inertia"), 6, inertia=4)


CUTS = SCALED + f""", q AS MATERIALIZED (SELECT i, x, sum(x) OVER (ORDER BY i) AS s1 FROM (SELECT z_{ONE} AS x, row_number() OVER (ORDER BY z_{ONE}, client_id) AS i FROM z)),
    whole AS (SELECT max(i) AS n, max_by(s1, i) AS t1 FROM q),
    two AS (SELECT i AS a FROM q, whole WHERE i < n ORDER BY -s1 * s1 / i - pow(t1 - s1, 2) / (n - i) LIMIT 1),
    three AS (SELECT a.i AS a, b.i AS b FROM q a JOIN q b ON a.i < b.i, whole WHERE b.i < n ORDER BY -a.s1 * a.s1 / a.i - pow(b.s1 - a.s1, 2) / (b.i - a.i) - pow(t1 - b.s1, 2) / (n - b.i) LIMIT 1),
    cut AS (SELECT 2 AS k, CAST(i > a AS INTEGER) AS g, x FROM q, two UNION ALL SELECT 3, CAST(i > a AS INTEGER) + CAST(i > b AS INTEGER), x FROM q, three),
    c AS (SELECT k, g, count(*) AS n, avg(x) AS centre FROM cut GROUP BY ALL),
    w AS (SELECT k, g, any_value(c.n) AS n, any_value(centre) AS centre, sum(pow(x - centre, 2)) AS within, avg(abs(x - centre)) AS scatter FROM cut JOIN c USING (k, g) GROUP BY ALL),
    db AS (SELECT k, avg(worst) AS davies FROM (SELECT u.k, u.g, max((u.scatter + o.scatter) / abs(u.centre - o.centre)) AS worst FROM w u JOIN w o ON u.k = o.k AND u.g <> o.g GROUP BY ALL) GROUP BY k)"""


@query("k_sweep_one_feature", on_features(f"""SELECT k, {R('sum(within)', 'inertia', 4)}, {R('any_value(davies)', 'davies_bouldin', 5)},
    {R('sum(n * pow(centre, 2)) / (k - 1) / (sum(within) / (sum(n) - k))', 'calinski_harabasz', 3)}, {R('min(n) / sum(n) * 100', 'smallest_share_pct')} FROM w JOIN db USING (k) GROUP BY k""", CUTS))
def _(spark, d):
    """The sweep's scores on one feature for two and three groups, from the best of all cuts."""
    config = segments.Config(features=(ONE,), scaler="standard", k_min=2, k_max=3, tolerance=0.0)
    p = segments.prepare(feats(spark, d), config)
    scores = segments.evaluate(p, config).frame(spark)
    return rounded(scores.select("k", "inertia", "davies_bouldin", "calinski_harabasz", "smallest_share_pct"), 4, davies_bouldin=5, calinski_harabasz=3, smallest_share_pct=6)


@query("k_sweep")
def _(spark, d):
    p = prepared(spark, d)
    config = segments.Config(scaler="standard")
    return segments.evaluate(p, config).frame(spark)


@query("scaler_comparison")
def _(spark, d):
    return segments.scaler_table(segments.compare_scalers(feats(spark, d), WHOLE)[1])


@query("stratified_sample", on_features("SELECT CAST(client_id % 3 AS INTEGER) AS cluster, CAST(round_even(300 * count(*) / (SELECT count(*) FROM feat), 0) AS BIGINT) AS n FROM feat GROUP BY 1"))
def _(spark, d):
    return agg(segments.stratified_sample(labelled(spark, d), 300), {"n": "count(*)"}, ["cluster"])


@query("principal_components")
def _(spark, d):
    p = prepared(spark, d)
    return rounded(segments.project_2d(p.data, p.features)[0].select("client_id", "pc1", "pc2"), 4)


TWO = SEG[:2]


@query("principal_components_pair", on_features(f"""SELECT client_id, {R('(x * u + y * w) * sign_', 'pc1', 5)}, {R('(y * u - x * w) * other', 'pc2', 5)} FROM xy, axis""",
    ROBUST + f""", m AS (SELECT avg(z_{TWO[0]}) AS mx, avg(z_{TWO[1]}) AS my, var_samp(z_{TWO[0]}) AS a, covar_samp(z_{TWO[0]}, z_{TWO[1]}) AS b, var_samp(z_{TWO[1]}) AS c FROM z),
    xy AS (SELECT client_id, z_{TWO[0]} - mx AS x, z_{TWO[1]} - my AS y FROM z, m),
    turned AS (SELECT 0.5 * atan2(2 * b, a - c) AS angle FROM m),
    axis AS (SELECT cos(angle) AS u, sin(angle) AS w, CASE WHEN abs(cos(angle)) >= abs(sin(angle)) THEN sign(cos(angle)) ELSE sign(sin(angle)) END AS sign_,
      CASE WHEN abs(sin(angle)) >= abs(cos(angle)) THEN -sign(sin(angle)) ELSE sign(cos(angle)) END AS other FROM turned)"""))
def _(spark, d):
    """Two features, whose principal axes SQL knows in closed form."""
    p = segments.prepare(feats(spark, d), segments.Config(features=tuple(TWO), scaler="robust"))
    return rounded(segments.project_2d(p.data, p.features)[0].select("client_id", "pc1", "pc2"), 5)


@query("segmentation_run")
def _(spark, d):
    return segments.run_segmentation(feats(spark, d), WHOLE)["segments"]


@query("embedding_clusters")
def _(spark, d):
    """K-Means on the given vectors, scored per cluster size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=4, seed=42, maxIter=300, predictionCol="cluster").fit(rows)
    return agg(model.transform(rows), {"vectors": "count(*)"}, ["cluster"])


# -------------------------------------------------------- findings and signals

BANDS = f"""bands AS (SELECT 'delay' AS dimension, {DELAY} AS level, {DELAY_ORD} AS ord, {T} AS y FROM feat
    UNION ALL SELECT 'utilisation', {UTIL_BAND}, {UTIL_ORD}, {T} FROM feat WHERE utilisation_latest IS NOT NULL
    UNION ALL SELECT 'limit', limit_band, limit_band_ord, {T} FROM feat WHERE limit_band IS NOT NULL UNION ALL SELECT 'age', age_band, age_band_ord, {T} FROM feat),
    lev AS (SELECT dimension, level, ord, count(*) AS n, avg(y) * 100 AS rate FROM bands GROUP BY ALL HAVING count(*) >= 30)"""
GRAD = BANDS + """, gr AS (SELECT dimension, count(*) AS levels, min(rate) AS low_rate, arg_min(level, rate) AS low_level, max(rate) AS high_rate, arg_max(level, rate) AS high_level,
    arg_min(rate, ord) AS first_rate, arg_max(rate, ord) AS last_rate, arg_min(n, ord) AS first_n, max(rate) FILTER (WHERE level = 'No delay') AS base_rate,
    coalesce(sum(n) FILTER (WHERE level <> 'No delay'), 0) AS delayed FROM lev WHERE level <> 'Negative / zero' GROUP BY 1)"""


@query("band_rates", on_features(f"SELECT dimension, level, CAST(ord AS INTEGER) AS ord, n, {R('rate', 'rate_pct')} FROM lev", BANDS))
def _(spark, d):
    return rounded(findings.level_rates(feats(spark, d), T).drop("events"))


@query("gradients", on_features(f"SELECT dimension, levels, low_level, high_level, {Rs(['low_rate', 'high_rate', 'first_rate', 'last_rate'])}, first_n FROM gr", GRAD))
def _(spark, d):
    out = findings.gradients(findings.level_rates(feats(spark, d), T))
    return rounded(out.select("dimension", "levels", "low_level", "high_level", "low_rate", "high_rate", "first_rate", "last_rate", "first_n"))


SEV = "CASE WHEN {s} >= 40 THEN 4 WHEN {s} >= 25 THEN 3 WHEN {s} >= 10 THEN 2 WHEN {s} > 0 THEN 1 ELSE 0 END"
STEP = "CASE WHEN {g} >= 35 THEN 2 WHEN {g} >= 20 THEN 1 ELSE 0 END"
N = "(SELECT count(*) FROM feat)"
FLAG_N = "(SELECT count(*) FILTER (WHERE {}) FROM feat)"


def _grade(share: str, gap: str) -> str:
    return f"least(4, {SEV.format(s=share)} + {STEP.format(g=gap)})"


HIGH, FULL, REV = FLAG_N.format("is_high_utilisation"), FLAG_N.format("is_full_payer"), FLAG_N.format("is_revolver")
LATE_GAP = "(SELECT avg(CAST(pay_status_m1 >= 1 AS INTEGER)) * 100 - avg(CAST(pay_status_m6 >= 1 AS INTEGER)) * 100 FROM feat)"
RATIO_GAP = f"(SELECT abs(avg(repayment_ratio_capped_mean) FILTER (WHERE {T} = 1) - avg(repayment_ratio_capped_mean) FILTER (WHERE {T} = 0)) FROM feat)"
FIND = GRAD + f""", fnd AS (
    SELECT 'delinquency_gradient' AS key, 'risk' AS type, CAST(delayed AS BIGINT) AS affected_clients, delayed / {N} * 100 AS share, {_grade(f'delayed / {N} * 100', '(high_rate - base_rate)')} AS sev
      FROM gr WHERE dimension = 'delay' AND high_level <> 'No delay' AND high_rate - base_rate >= 3 AND levels >= 2
    UNION ALL SELECT 'utilisation_gradient', 'risk', {HIGH}, {HIGH} / {N} * 100, {_grade(f'{HIGH} / {N} * 100', '(high_rate - low_rate)')} FROM gr WHERE dimension = 'utilisation' AND high_rate - low_rate >= 3 AND levels >= 2
    UNION ALL SELECT 'limit_band_gradient', 'observation', first_n, first_n / {N} * 100, {_grade(f'first_n / {N} * 100', 'abs(last_rate - first_rate)')} FROM gr WHERE dimension = 'limit' AND abs(first_rate - last_rate) >= 3
    UNION ALL SELECT 'age_band_pattern', 'observation', NULL, NULL, 1 FROM gr WHERE dimension = 'age' AND high_rate - low_rate >= 3
    UNION ALL SELECT 'repayment_behaviour', 'risk', {REV}, {REV} / {N} * 100, {SEV.format(s=f'({REV} / {N} * 100)')} WHERE {RATIO_GAP} >= 0.02
    UNION ALL SELECT 'delinquency_trend', CASE WHEN {LATE_GAP} > 0 THEN 'risk' ELSE 'opportunity' END, NULL, abs({LATE_GAP}) * 2, {SEV.format(s=f'(abs({LATE_GAP}) * 2)')} WHERE abs({LATE_GAP}) >= 1
    UNION ALL SELECT 'full_payer_segment', 'opportunity', {FULL}, {FULL} / {N} * 100, {SEV.format(s=f'({FULL} / {N} * 100)')} WHERE {FULL} >= 30
      AND (SELECT avg({T}) FILTER (WHERE is_full_payer) < avg({T}) FROM feat))"""


@query("key_findings", on_features(f"SELECT key, type, affected_clients, {R('share', 'affected_share_pct')}, CAST(sev AS INTEGER) AS severity_ord FROM fnd", FIND))
def _(spark, d):
    out = findings.key_findings(feats(spark, d))
    return rounded(out.select("key", "type", "affected_clients", "affected_share_pct", "severity_ord"))


PLANTED = "CASE WHEN current_delinquency >= 1 OR client_id % 5 = 0 THEN 1 ELSE 0 END"


@query("key_findings_planted", on_features(f"SELECT key, type, affected_clients, {R('share', 'affected_share_pct')}, CAST(sev AS INTEGER) AS severity_ord FROM fnd", FIND)
       .replace(f"{T} AS y", f"{PLANTED} AS y").replace(f", {T} FROM feat", f", {PLANTED} FROM feat").replace(f"FILTER (WHERE {T} =", f"FILTER (WHERE {PLANTED} =")
       .replace(f"avg({T})", f"avg({PLANTED})"))
def _(spark, d):
    """An outcome that follows recent delay, so that more rules fire."""
    f = s.project(feats(spark, d), {T: PLANTED})
    out = findings.key_findings(f)
    return rounded(out.select("key", "type", "affected_clients", "affected_share_pct", "severity_ord"))


@query("findings_without_evidence", on_features("SELECT key FROM fnd WHERE false", FIND))
def _(spark, d):
    return findings.unsupported(findings.key_findings(feats(spark, d)))


BAND_N = "(SELECT n FROM lev WHERE lev.dimension = gr.dimension AND lev.level = gr.{}_level)"
EVIDENCE = FIND + f""", ev AS (
    SELECT 'delinquency_gradient' AS key, 'default_rate_no_delay' AS metric, base_rate AS value, (SELECT n FROM lev WHERE dimension = 'delay' AND level = 'No delay') AS n FROM gr WHERE dimension = 'delay'
    UNION ALL SELECT 'delinquency_gradient', 'default_rate_worst_delay', high_rate, {BAND_N.format('high')} FROM gr WHERE dimension = 'delay'
    UNION ALL SELECT 'utilisation_gradient', 'default_rate_low_utilisation', low_rate, {BAND_N.format('low')} FROM gr WHERE dimension = 'utilisation'
    UNION ALL SELECT 'utilisation_gradient', 'default_rate_high_utilisation', high_rate, {BAND_N.format('high')} FROM gr WHERE dimension = 'utilisation'
    UNION ALL SELECT 'utilisation_gradient', 'default_rate_in_credit', rate, n FROM lev WHERE dimension = 'utilisation' AND level = 'Negative / zero'
    UNION ALL SELECT 'limit_band_gradient', 'default_rate_lowest_limit', first_rate, first_n FROM gr WHERE dimension = 'limit'
    UNION ALL SELECT 'limit_band_gradient', 'default_rate_highest_limit', last_rate, (SELECT arg_max(n, ord) FROM lev WHERE dimension = 'limit') FROM gr WHERE dimension = 'limit'
    UNION ALL SELECT 'age_band_pattern', 'age_band_highest_rate', high_rate, {BAND_N.format('high')} FROM gr WHERE dimension = 'age'
    UNION ALL SELECT 'age_band_pattern', 'age_band_lowest_rate', low_rate, {BAND_N.format('low')} FROM gr WHERE dimension = 'age'
    UNION ALL SELECT 'repayment_behaviour', 'repayment_ratio_defaulters', avg(repayment_ratio_capped_mean), count(repayment_ratio_capped_mean) FROM (SELECT repayment_ratio_capped_mean, {T} AS y FROM feat) WHERE y = 1
    UNION ALL SELECT 'repayment_behaviour', 'repayment_ratio_non_defaulters', avg(repayment_ratio_capped_mean), count(repayment_ratio_capped_mean) FROM (SELECT repayment_ratio_capped_mean, {T} AS y FROM feat) WHERE y = 0
    UNION ALL SELECT 'delinquency_trend', 'delinquency_first_period', avg(CAST(pay_status_m6 >= 1 AS INTEGER)) * 100, count(*) FROM feat
    UNION ALL SELECT 'delinquency_trend', 'delinquency_last_period', avg(CAST(pay_status_m1 >= 1 AS INTEGER)) * 100, count(*) FROM feat
    UNION ALL SELECT 'delinquency_trend', 'utilisation_change', (avg(utilisation_m1) - avg(utilisation_m6)) * 100, count(*) FROM feat
    UNION ALL SELECT 'full_payer_segment', 'full_payer_count', {FULL}, count(*) FROM feat
    UNION ALL SELECT 'full_payer_segment', 'full_payer_default_rate', (SELECT avg({T}) FILTER (WHERE is_full_payer) * 100 FROM feat), {FULL}
    UNION ALL SELECT 'full_payer_segment', 'full_payer_avg_limit', (SELECT avg(credit_limit) FILTER (WHERE is_full_payer) FROM feat), {FULL})"""
# of levels with one rate the first counts
EVIDENCE = EVIDENCE.replace("arg_min(level, rate)", "arg_min(level, rate * 1000000 + ord)").replace("arg_max(level, rate)", "arg_max(level, rate * 1000000 - ord)")
EVIDENCE_SQL = on_features(f"""SELECT key, metric, {R('value', 'value', 4)}, CAST(n AS BIGINT) AS n,
    CASE WHEN key = 'repayment_behaviour' AND {N} >= 1000 THEN 'high' WHEN max(n) OVER (PARTITION BY key) >= 100 THEN 'medium' ELSE 'low' END AS confidence FROM ev JOIN fnd USING (key)""", EVIDENCE)


@query("finding_evidence", EVIDENCE_SQL)
def evidence(spark, d):
    """Every piece of evidence behind the findings, with the confidence it gives."""
    found = findings.key_findings(feats(spark, d))
    return rounded(found.selectExpr("key", "confidence", "inline(evidence)").select("key", "metric", "value", "n", "confidence"), 4)


@query("finding_evidence_planted", EVIDENCE_SQL.replace(f"{T} AS y", f"{PLANTED} AS y").replace(f", {T} FROM feat", f", {PLANTED} FROM feat")
       .replace(f"FILTER (WHERE {T} =", f"FILTER (WHERE {PLANTED} =").replace(f"avg({T})", f"avg({PLANTED})"))
def _(spark, d):
    found = findings.key_findings(s.project(feats(spark, d), {T: PLANTED}))
    return rounded(found.selectExpr("key", "confidence", "inline(evidence)").select("key", "metric", "value", "n", "confidence"), 4)


@query("finding_counts", on_features("""SELECT facet, name, count(key) AS findings FROM (VALUES ('type', 'risk'), ('type', 'opportunity'), ('type', 'observation'), ('type', 'data_quality'),
    ('severity', 'info'), ('severity', 'low'), ('severity', 'medium'), ('severity', 'high'), ('severity', 'critical')) AS t(facet, name)
    LEFT JOIN fnd ON (facet = 'type' AND type = name) OR (facet = 'severity' AND ['info', 'low', 'medium', 'high', 'critical'][sev + 1] = name) GROUP BY ALL""", FIND))
def _(spark, d):
    return findings.finding_counts(findings.key_findings(feats(spark, d)))


@query("top_findings", on_features("SELECT key, ['info', 'low', 'medium', 'high', 'critical'][sev + 1] AS severity FROM fnd ORDER BY sev DESC, coalesce(share, 0) DESC, key LIMIT 2", FIND))
def _(spark, d):
    return findings.by_priority(findings.key_findings(feats(spark, d)), 2).select("key", "severity")


GROUPS = [("high_utilisation", "risk", "is_high_utilisation", 50, "true"), ("payment_delinquency", "risk", "is_currently_delinquent", 40, "true"),
          ("repayment_behaviour", "risk", "is_revolver", 80, "true"), ("over_limit", "risk", "is_over_limit", 30, "n > 0"),
          ("full_payers", "opportunity", "is_full_payer", 50, "n >= 30"),
          ("low_utilisation_headroom", "opportunity", "coalesce(utilisation_latest >= 0 AND utilisation_latest < 0.3, false)", 60, "n >= 30 AND rate < overall"),
          ("improving_delinquency", "opportunity", "delinquency_trend = 'Improving'", 30, "n >= 30")]
CUTS = {"high_utilisation": (25, 10), "payment_delinquency": (20, 10), "repayment_behaviour": (55, 35), "over_limit": (1000, 10)}


def _level(key: str) -> str:
    if key not in CUTS:
        return "'info'"
    return f"CASE WHEN n / total * 100 >= {CUTS[key][0]} THEN 'high' WHEN n / total * 100 >= {CUTS[key][1]} THEN 'medium' ELSE 'low' END"


@query("signals", on_features(" UNION ALL ".join(
    f"SELECT '{key}' AS key, '{kind}' AS kind, n AS clients, {R('n / total * 100', 'value')}, {R('rate', 'rate_pct')}, {_level(key)} AS severity, "
    f"{R(f'least(1, n / total * 100 / {top})', 'intensity')} FROM (SELECT count(*) FILTER (WHERE {cond}) AS n, count(*) AS total, "
    f"avg({T}) FILTER (WHERE {cond}) * 100 AS rate, avg({T}) * 100 AS overall FROM feat) WHERE {shown}" for key, kind, cond, top, shown in GROUPS)))
def _(spark, d):
    return rounded(findings.signals(feats(spark, d)).select("key", "kind", "clients", "value", "rate_pct", "severity", "intensity"))


# -------------------------------------------------------------- composed runs

@query("portfolio_run", on_features("SELECT count(*) AS clients, count(*) * 6 AS panel_rows, count(*) FILTER (WHERE is_revolver) AS revolvers, CAST(37 AS BIGINT) AS features_made FROM feat"))
def _(spark, d):
    result = pipeline.run_table(raw(spark, d))
    made = result.features.filter("created").count()
    return agg(result.data, {"clients": "count(*)", "panel_rows": "count(*) * 6", "revolvers": "count_if(is_revolver)", "features_made": f"{made}L"})


@query("selection_context", on_features("SELECT count(*) AS n_total, count(*) FILTER (WHERE age BETWEEN 30 AND 50) AS n_selected FROM feat"))
def _(spark, d):
    context = pipeline.selection_context(feats(spark, d), selection.Spec(age=(30, 50)))
    return context["counts"].select("n_total", "n_selected")


@query("feature_report", on_features("SELECT created, count(*) AS n FROM (SELECT true AS created FROM range(37) UNION ALL SELECT false FROM range(5)) WHERE (SELECT count(*) FROM feat) > 0 GROUP BY 1"))
def _(spark, d):
    return agg(features.feature_report(feats(spark, d)), {"n": "count(*)"}, ["created"])


@query("feature_coverage", on_features(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{definition[0]}' AS category, count(*) AS n_rows, count(*) - count({c}) AS missing, {R(f'(count(*) - count({c})) / count(*) * 100', 'missing_pct')} FROM feat"
    for c, definition in features.DEFINITIONS.items())))
def _(spark, d):
    out = features.feature_coverage(feats(spark, d)).filter("created")
    return rounded(out.select("feature", "category", "n_rows", "missing", "missing_pct"))


@query("results_as_json", "SELECT '{\"o_orderpriority\":\"' || o_orderpriority || '\",\"n\":' || count(*) || '}' AS json FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return pipeline.as_json(agg(table(spark, d, "orders"), {"n": "count(*)"}, ["o_orderpriority"]))
