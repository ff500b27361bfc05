"""Behaviour-based K-Means segments and what they look like.

The outcome and personal attributes can never reach the feature matrix; the
outcome rate of a segment is computed after clustering.  Rows are looked at
through aggregates per cluster; only centroids and scores (k rows) come to the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, beside, unpivot
from ledgerlens.operators import eda
from ledgerlens.operators.correlation import correlation_pairs, matrix
from ledgerlens.operators.line import best_intervals
from ledgerlens.operators.spread import spreads

# fixed values: candidate features and the words that name a segment
FEATURES = (
    "credit_limit", "utilisation_mean_6m", "repayment_ratio_capped_mean", "delinquent_months_count", "bill_trend_slope",
    "utilisation_volatility", "months_zero_payment",
)
FORBIDDEN = {
    "default_next_month", "default payment next month", "default.payment.next.month", "sex", "sex_code", "marriage",
    "marriage_code", "education", "education_code", "age", "age_band", "client_id", "is_duplicate_excluding_id",
    "has_extreme_value",
}
TRAITS = {
    "credit_limit": ("High-Limit", "Low-Limit"),
    "utilisation_mean_6m": ("High-Utilisation", "Low-Utilisation"),
    "repayment_ratio_capped_mean": ("High-Repayment", "Low-Repayment"),
    "delinquent_months_count": ("Delinquent", "Consistently-Current"),
    "bill_trend_slope": ("Growing-Balance", "Shrinking-Balance"),
    "utilisation_volatility": ("Volatile-Usage", "Steady-Usage"),
    "months_zero_payment": ("Frequent-Non-Payment", "Regular-Payment"),
}
# feature -> (name in prose, how its mean is written)
WORDING = {
    "credit_limit": ("avg credit limit", "concat('NT$', format_number({x}, 0))"),
    "utilisation_mean_6m": ("avg utilisation", "format_string('%.1f%%', {x} * 100)"),
    "repayment_ratio_capped_mean": ("avg repayment ratio", "format_string('%.1f%%', {x} * 100)"),
    "delinquent_months_count": ("avg delinquent months", "format_string('%.2f', {x})"),
    "bill_trend_slope": ("avg balance trend", "concat('NT$', format_string('%+,.0f', {x}), '/month')"),
    "utilisation_volatility": ("avg utilisation volatility", "format_string('%.3f', {x})"),
    "months_zero_payment": ("avg zero-payment months", "format_string('%.2f', {x})"),
}
TRAIT_FROM = 0.35
DEGENERATE_BELOW_PCT = 1.0
MIN_ROWS = 200
SCALERS = ("standard", "robust")


@dataclass(frozen=True)
class Config:
    features: tuple[str, ...] = FEATURES
    k_min: int = 2
    k_max: int = 8
    scaler: str = "robust"
    seed: int = 42
    n_init: int = 10
    max_iter: int = 300
    silhouette_sample: int = 5_000
    tolerance: float = 1e-4  # a run has settled when its centroids move by less than this share of the mean variance (squared); 0: not at all
    start_rows: int = 131_072  # weighted rows on which the starts are chosen and settle before they see all rows

    def __post_init__(self):
        leaked = sorted(set(self.features) & FORBIDDEN)
        if leaked:
            raise ValueError(f"these columns may not be clustered on: {', '.join(leaked)}")
        if self.scaler not in SCALERS:
            raise ValueError(f"unknown scaler {self.scaler!r}; choose from {', '.join(SCALERS)}")
        if self.k_min < 2 or self.k_max < self.k_min:
            raise ValueError("k_min must be at least 2 and k_max at least k_min")


@dataclass(frozen=True)
class Prepared:
    """Filled columns ``raw_*`` and scaled columns ``z_*`` beside the key, plus disclosures."""

    data: DataFrame
    features: tuple[str, ...]
    imputed: dict[str, float]
    excluded: dict[str, str]
    n_rows: int
    key: str = v.ID
    missing: dict[str, int] = field(default_factory=dict)


def assess_features(df: DataFrame, features: Sequence[str] = FEATURES, key: str = v.ID) -> DataFrame:
    """Missing share, moments and the strongest Spearman partner of each candidate."""
    present = [c for c in features if c in df.columns]
    stats = eda.numeric_summary(df, present)
    partners = matrix(correlation_pairs(df, present, "spearman", (key,))).filter("row <> column")
    best = agg(partners, {"partner": "max_by(column, struct(abs(correlation), column))", "max_abs_corr": "max(abs(correlation))"},
               ["row"]).withColumnRenamed("row", "column")
    return stats.join(F.broadcast(best), "column", "left").selectExpr(
        "column AS feature", "missing", "missing / (missing + count) * 100 AS missing_pct", "mean", "std", "skewness",
        "max_abs_corr", "partner",
    )


def prepare(df: DataFrame, config: Config = Config(), key: str = v.ID, keep: Sequence[str] = ()) -> Prepared:
    """Drop unusable features, fill nulls with the median, scale.  No client is dropped.

    ``keep`` names columns that stay beside the key as they are and reach no feature.
    """
    present = [c for c in config.features if c in df.columns]
    excluded = {c: "column not present" for c in config.features if c not in present}
    found = spreads(df, present)
    for c in present:
        if c not in found:
            excluded[c] = "every value is missing"
        elif found[c].least == found[c].most:
            excluded[c] = "constant in this selection"
    used = tuple(c for c in present if c not in excluded)
    if not used:
        raise ValueError("no usable clustering feature: " + "; ".join(f"{c} ({why})" for c, why in excluded.items()))
    nulls = agg(df, {"__rows": "count(*)", **{c: f"count_if({s.value(df, c)} IS NULL)" for c in used}}).first().asDict()
    n_rows = nulls.pop("__rows")
    imputed = {c: found[c].median for c in used if nulls[c]}
    raw = df.selectExpr(s.name(key), *map(s.name, keep), *[
        f"coalesce({s.value(df, c)}, {s.number(found[c].median)}) AS {s.name('raw_' + c)}" for c in used
    ])
    return Prepared(scale(raw, used, config.scaler), used, imputed, excluded, n_rows, key,
                    {c: n for c, n in nulls.items() if n})


def scale(raw: DataFrame, features: Sequence[str], scaler: str) -> DataFrame:
    """Standard: mean and population deviation.  Robust: median and IQR.  A zero spread divides by 1."""
    names = {c: f"raw_{c}" for c in features}
    if scaler == "standard":
        m = agg(raw, {**{f"m_{c}": f"avg({s.name(n)})" for c, n in names.items()},
                      **{f"s_{c}": f"stddev_pop({s.name(n)})" for c, n in names.items()}}).first()
        centre = {c: (m[f"m_{c}"], m[f"s_{c}"]) for c in features}
    else:
        found = spreads(raw, list(names.values()))
        centre = {c: (found[n].median, found[n].iqr) for c, n in names.items()}
    return s.project(raw, {
        f"z_{c}": f"({s.name(names[c])} - {s.number(mid)}) / {s.number(width or 1.0)}" for c, (mid, width) in centre.items()
    })


def matrix_of(prepared: Prepared) -> DataFrame:
    """The cached rows all fits read."""
    return session.reuse(prepared.data)


@dataclass(frozen=True)
class Model:
    """Centroids in the order they are numbered: by falling size, then by position."""

    centres: np.ndarray
    inertia: float
    iterations: int
    features: tuple[str, ...]

    @property
    def k(self) -> int:
        return len(self.centres)


def _refining():
    """The refinement of one start; local, so that tasks get its code and need not import this package."""

    def plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """k starting points, each drawn with probability proportional to weight and squared distance so far."""
        chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
        gap = ((points - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < k:
            mass = weight * gap
            pick = rng.choice(len(points), p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(len(points))
            chosen.append(points[pick])
            gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
        return np.array(chosen)

    def warm_start(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, steps: int, settled: float) -> np.ndarray:
        """Starting centroids: k-means++ on the bounded, weighted starting rows, refined until they settle there."""
        centres = plus_plus(points, weight, k, rng)
        heavy = np.column_stack([weight, weight[:, None] * points])
        for _ in range(steps):
            near = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            sums = (near[:, None] == np.arange(k)).astype("float64").T @ heavy
            n = sums[:, :1]
            moved = np.where(n > 0, sums[:, 1:] / np.where(n > 0, n, 1), centres)
            shift = ((moved - centres) ** 2).sum()
            centres = moved
            if shift <= settled:
                break
        return centres

    return warm_start


def _starts(data: DataFrame, points: np.ndarray, weight: np.ndarray, runs: list[tuple[int, int]], config: Config, settled: float) -> dict:
    """The starting centroids of every run, one task a run."""
    context = data.sparkSession.sparkContext
    shared, seed, steps, warm_start = context.broadcast((points, weight)), config.seed, config.max_iter, _refining()

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                centres = warm_start(*shared.value, runs[i][0], np.random.default_rng([seed, *runs[i]]), steps, settled)
                yield pd.DataFrame({"run": [i], "centres": [centres.ravel()]})

    rows = data.sparkSession.range(0, len(runs), 1, len(runs)).mapInPandas(refine, "run long, centres array<double>").collect()
    shared.unpersist()
    return {runs[r["run"]]: np.array(r["centres"]).reshape(runs[r["run"]][0], -1) for r in rows}


def _starting_rows(data: DataFrame, cols: Sequence[str], config: Config, key: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(points, weights, mean variance): a bounded weighted sample that keeps the far rows.

    Half of the chance is uniform and half grows with the squared distance from
    the mean (a lightweight coreset), so a small remote group is not missed.
    The draw is a race of seeded hashes and therefore repeatable.
    """
    m = agg(data, {"n": "count(*)", **{f"a_{c}": f"avg({s.name(c)})" for c in cols}, **{f"v_{c}": f"var_pop({s.name(c)})" for c in cols}}).first()
    total = sum(m[f"v_{c}"] or 0.0 for c in cols)
    away = s.plus(f"({s.name(c)} - {s.number(m[f'a_{c}'])}) * ({s.name(c)} - {s.number(m[f'a_{c}'])})" for c in cols)
    chance = f"(0.5D + 0.5D * {away} / {s.number(total or 1.0)}) / {m['n']}"
    unit = f"(xxhash64({config.seed}, {s.name(key)}) / 18446744073709551616D + 0.5D)"
    drawn = s.project(data.select(key, *cols), {"__q": chance, "__u": unit}).selectExpr("*", "-ln(greatest(__u, 1e-300D)) / __q AS __race")
    rows = drawn.orderBy("__race", key).limit(config.start_rows).select("__q", *cols).toPandas()
    weight = 1.0 / np.minimum(1.0, config.start_rows * rows["__q"].to_numpy()) if m["n"] > config.start_rows else np.ones(len(rows))
    return rows[list(cols)].to_numpy(dtype="float64"), weight, total / len(cols)


def _distinct_starts(runs: list[tuple[int, int]], centres: dict, settled: float) -> list[tuple[int, int]]:
    """Runs of one K whose refined starts coincide would take the same path, so one of them is kept."""
    kept: list[tuple[int, int]] = []
    for r in runs:
        own = centres[r][np.lexsort(centres[r].T)]
        seen = (centres[q][np.lexsort(centres[q].T)] for q in kept if q[0] == r[0])
        if not any(((own - other) ** 2).sum() <= settled for other in seen):
            kept.append(r)
    return kept


def _line_model(data: DataFrame, column: str, k: int, features: Sequence[str]) -> Model:
    centres, sizes, cost, scans = best_intervals(data, column, k)
    order = sorted(range(k), key=lambda g: (-sizes[g], centres[g, 0]))
    return Model(centres[order], cost, scans, tuple(features))


def fit_many(data: DataFrame, features: Sequence[str], ks: Sequence[int], config: Config = Config(),
             key: str = v.ID) -> dict[int, Model]:
    """The best of ``n_init`` K-Means runs for every K, all runs sharing each pass over the data.

    A sweep of seven K with ten starts is seventy models.  Fitted one by one,
    every iteration of every model would scan the data; here one pass per
    iteration serves all runs that have not settled.  A task reduces its rows to
    one partial sum per run and cluster, and a grouped sum merges the tasks.
    On one feature no run is needed: the best of all cuts is found.
    """
    cols = [f"z_{c}" for c in features]
    if len(cols) == 1:
        return {k: _line_model(data, cols[0], k, features) for k in ks}
    points, weight, variance = _starting_rows(data, cols, config, key)
    settled = config.tolerance * variance
    runs = [(k, i) for k in ks for i in range(config.n_init)]
    centres = _starts(data, points, weight, runs, config, settled / 100)
    runs = _distinct_starts(runs, centres, settled)
    cost, sizes, steps = {}, {}, dict.fromkeys(runs, 0)
    active = list(runs)
    schema = "run int, cluster int, n double, cost double, " + ", ".join(f"s{j} double" for j in range(len(cols)))
    sums = {x: f"sum({x})" for x in ["n", "cost", *[f"s{j}" for j in range(len(cols))]]}

    for _ in range(config.max_iter):
        current = [centres[r] for r in active]

        def partial(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            totals = [np.zeros((len(c), 2 + len(cols))) for c in current]
            for batch in batches:
                x = batch.to_numpy(dtype="float64")
                length = (x ** 2).sum(axis=1)
                for c, total in zip(current, totals):
                    gaps = length[:, None] - 2 * x @ c.T + (c ** 2).sum(axis=1)
                    near = gaps.argmin(axis=1)
                    known = np.column_stack([np.ones(len(x)), np.maximum(gaps.min(axis=1), 0), x])
                    total += (near[:, None] == np.arange(len(c))).astype("float64").T @ known
            rows = [(i, g, *total[g]) for i, total in enumerate(totals) for g in range(len(total))]
            yield pd.DataFrame(rows, columns=["run", "cluster", "n", "cost", *[f"s{j}" for j in range(len(cols))]])

        merged = agg(data.select(*cols).mapInPandas(partial, schema), sums, ["run", "cluster"]).toPandas()
        merged = merged.sort_values(["run", "cluster"])
        still = []
        for i, r in enumerate(active):
            part = merged[merged["run"] == i]
            n = part["n"].to_numpy()
            moved = np.where(n[:, None] > 0, part[[f"s{j}" for j in range(len(cols))]].to_numpy() / np.maximum(n, 1)[:, None], centres[r])
            shift = ((moved - centres[r]) ** 2).sum()
            cost[r] = float(part["cost"].sum())
            centres[r], sizes[r], steps[r] = moved, n, steps[r] + 1
            if shift > settled:
                still.append(r)
        # every run goes on until it settles; of runs that have met, one goes on for both
        active = _distinct_starts(still, centres, settled)
        if not active:
            break

    models = {}
    for k in ks:
        best = min((r for r in runs if r[0] == k), key=lambda r: (cost[r], r))
        order = sorted(range(k), key=lambda g: (-sizes[best][g], tuple(centres[best][g])))
        models[k] = Model(centres[best][order], cost[best], steps[best], tuple(features))
    return models


def assign(model: Model, data: DataFrame) -> DataFrame:
    """Nearest centroid per row, as a plain column expression."""
    away = [
        s.plus(f"({s.name('z_' + c)} - {s.number(x)}) * ({s.name('z_' + c)} - {s.number(x)})" for c, x in zip(model.features, centre))
        for centre in model.centres
    ]
    gaps = s.project(data, {"__gaps": f"array({', '.join(away)})"})
    return s.project(gaps, {"cluster": "int(array_position(__gaps, array_min(__gaps)) - 1)"}).drop("__gaps")


# ------------------------------------------------------------ scores of a fit

METRIC_SCHEMA = ("k long, n_rows long, inertia double, davies_bouldin double, calinski_harabasz double, "
                 "smallest_share_pct double, is_degenerate boolean")


def partition_metrics(labelled: DataFrame, features: Sequence[str]) -> list[Row]:
    """Scores of every partition in a (partition, cluster, z...) table.

    Two aggregations in all, whatever the number of partitions; what remains is
    arithmetic on their centroids.
    """
    cols = [f"z_{c}" for c in features]
    keys = ["partition", "cluster"]
    means = session.reuse(agg(labelled, {"n": "count(*)", **{f"c_{c}": f"avg({s.name(c)})" for c in cols}}, keys))
    squared = s.plus(f"({s.name(c)} - {s.name('c_' + c)}) * ({s.name(c)} - {s.name('c_' + c)})" for c in cols)
    away = labelled.select(*keys, *cols).join(F.broadcast(means), keys).selectExpr(*keys, f"{squared} AS squared")
    inside = agg(away, {"within": "sum(squared)", "scatter": "avg(sqrt(squared))"}, keys)
    table = means.join(inside, keys).toPandas().sort_values(keys)
    means.unpersist()
    out = []
    for _, part in table.groupby("partition", sort=True):
        centre, n = part[[f"c_{c}" for c in cols]].to_numpy(), part["n"].to_numpy(dtype="float64")
        k, total, within, scatter = len(part), n.sum(), float(part["within"].sum()), part["scatter"].to_numpy()
        davies = calinski = None
        if k > 1:
            apart = np.sqrt(((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2))
            np.fill_diagonal(apart, np.inf)
            davies = float(((scatter[:, None] + scatter[None, :]) / apart).max(axis=1).mean())
            between = float((n * ((centre - (n[:, None] * centre).sum(axis=0) / total) ** 2).sum(axis=1)).sum())
            calinski = float(between / (k - 1) / (within / (total - k))) if within > 0 else None
        share = float(n.min() / total * 100)
        out.append(Row(k=k, n_rows=int(total), inertia=within, davies_bouldin=davies, calinski_harabasz=calinski,
                       smallest_share_pct=share, is_degenerate=share < DEGENERATE_BELOW_PCT))
    return out


def cluster_metrics(clustered: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: inertia, Davies-Bouldin, Calinski-Harabasz, smallest share and the degenerate flag."""
    rows = partition_metrics(clustered.withColumn("partition", F.lit(0)), features)
    return clustered.sparkSession.createDataFrame(rows, METRIC_SCHEMA)


def stratified_sample(clustered: DataFrame, size: int, seed: int = 42, key: str = v.ID) -> DataFrame:
    """About ``size`` rows with every cluster in proportion (at least two rows each), repeatable.

    Rows are ranked by a seeded hash of the key.  A hash threshold a little above
    the quota keeps the ranked part of a cluster near the quota, whatever its size.
    """
    counts = {r["cluster"]: r["count"] for r in clustered.groupBy("cluster").count().collect()}
    total = sum(counts.values())
    if size >= total:
        return clustered
    quota = {c: min(max(round(size * n / total), 2), n) for c, n in counts.items()}
    case = lambda m: "CASE cluster " + " ".join(f"WHEN {c} THEN {x}" for c, x in m.items()) + " END"
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("__h", key))
    hashed = s.project(clustered, {"__h": f"md5(concat('{seed}:', {s.name(key)}))"})

    def drawn(slack: float) -> DataFrame:
        limit = {c: s.number(min(1.0, (slack * quota[c] + 64) / counts[c])) for c in counts}
        near = hashed.filter(f"double(conv(substring(__h, 1, 12), 16, 10)) / {16 ** 12}D <= {case(limit)}")
        return near.withColumn("__rank", rank).filter(f"__rank <= {case(quota)}").drop("__h", "__rank")

    sample = drawn(1.5)
    if sample.count() < sum(quota.values()):  # the hash was unlucky: rank everything
        sample = drawn(float("inf"))
    return sample


def silhouette(sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean Euclidean silhouette of a sample (one row; null with fewer than two clusters).

    Every task scores its share of the points against the sample, whose size the
    sampling step bounds, and emits one number per point.
    """
    cols = [f"z_{c}" for c in features]
    block = sample.select("cluster", *cols).toPandas()
    labels = block["cluster"].to_numpy()
    points = block[cols].to_numpy(dtype="float64")
    clusters = np.unique(labels)
    if clusters.size < 2:
        return sample.sparkSession.createDataFrame([Row(None, len(block))], "silhouette double, sample_rows long")
    shared = sample.sparkSession.sparkContext.broadcast((points, labels, clusters))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, lab, ids = shared.value
        member = np.stack([lab == c for c in ids], axis=1).astype("float64")
        sizes = member.sum(axis=0)
        for batch in batches:
            x = batch[cols].to_numpy(dtype="float64")
            out = np.empty(len(x))
            for start in range(0, len(x), 256):  # keeps the distance block small
                part = x[start:start + 256]
                own = np.searchsorted(ids, batch["cluster"].to_numpy()[start:start + 256])
                squares = np.zeros((len(part), len(p)))
                for j in range(part.shape[1]):
                    squares += (part[:, j, None] - p[None, :, j]) ** 2
                gaps = np.sqrt(squares)
                sums = gaps @ member
                rows = np.arange(len(part))
                a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
                others = sums / sizes
                others[rows, own] = np.inf
                b = others.min(axis=1)
                widest = np.maximum(a, b)
                out[start:start + 256] = np.where((sizes[own] > 1) & (widest > 0), (b - a) / np.where(widest > 0, widest, 1), 0.0)
            yield pd.DataFrame({"value": out})

    tasks = max(1, min(sample.sparkSession.sparkContext.defaultParallelism, len(block) // 256))
    spread = sample.sparkSession.createDataFrame(block).repartition(tasks)
    return agg(spread.mapInPandas(score, "value double"), {"silhouette": "avg(value)", "sample_rows": "count(*)"})


def elbow(scores: Sequence[tuple[int, float]]) -> int:
    """K furthest from the chord between the first and the last (K, inertia)."""
    if len(scores) < 3:
        return scores[0][0] if scores else 2
    (k0, y0), (k1, y1) = scores[0], scores[-1]
    if k1 <= k0 or y0 <= y1:
        return k0
    below = [(1 - (k - k0) / (k1 - k0)) - (y - y1) / (y0 - y1) for k, y in scores]
    return scores[max(range(len(scores)), key=lambda i: abs(below[i]))][0]


SCORE_SCHEMA = ("scaler string, k int, inertia double, silhouette double, davies_bouldin double, "
                "calinski_harabasz double, smallest_share_pct double, is_degenerate boolean, sample_rows long")


@dataclass(frozen=True)
class Sweep:
    scores: tuple[dict, ...]
    recommended_k: int
    silhouette_best_k: int
    elbow_k: int
    davies_bouldin_best_k: int
    rationale: str
    models: dict

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r[f.split()[0]] for f in SCORE_SCHEMA.split(", ")) for r in self.scores], SCORE_SCHEMA)


def evaluate(prepared: Prepared, config: Config = Config(), data: DataFrame | None = None) -> Sweep:
    """Score each K; a K whose silhouette is undefined is left out, never given a value."""
    data = matrix_of(prepared) if data is None else data
    models = fit_many(data, prepared.features, [k for k in range(config.k_min, config.k_max + 1) if k < prepared.n_rows],
                      config, prepared.key)
    clusters = data
    for k, model in models.items():
        clusters = assign(model, clusters).withColumnRenamed("cluster", f"c{k}")
    clusters = session.reuse(clusters)
    cols = [f"z_{c}" for c in prepared.features]
    every = unpivot(clusters, [{"partition": str(k), "cluster": f"c{k}"} for k in models], keep=cols)
    metrics = dict(zip(sorted(models), partition_metrics(every, prepared.features)))
    scores = []
    for k in models:
        clustered = clusters.select(prepared.key, F.col(f"c{k}").alias("cluster"), *cols)
        seen = silhouette(stratified_sample(clustered, config.silhouette_sample, config.seed, prepared.key), prepared.features).first()
        if seen["silhouette"] is not None:
            scores.append({**metrics[k].asDict(), "k": k, "scaler": config.scaler, **seen.asDict()})
    clusters.unpersist()
    if not scores:
        k = config.k_min
        return Sweep((), k, k, k, k, "No number of segments could be scored on this selection.", {})
    best = max(scores, key=lambda r: r["silhouette"])
    sound = [r for r in scores if not r["is_degenerate"]]
    chosen = max(sound, key=lambda r: r["silhouette"]) if best["is_degenerate"] and sound else best
    davies = min(scores, key=lambda r: r["davies_bouldin"])
    knee = elbow([(r["k"], r["inertia"]) for r in scores])
    why = (f"K={chosen['k']} has the best silhouette ({chosen['silhouette']:.4f})"
           + (" among partitions without a tiny segment" if chosen is not best else "")
           + f"; smallest segment {chosen['smallest_share_pct']:.2f}%. Elbow at K={knee}, Davies-Bouldin best at "
             f"K={davies['k']}. Silhouette on {chosen['sample_rows']:,} of {prepared.n_rows:,} rows.")
    return Sweep(tuple(scores), chosen["k"], best["k"], knee, davies["k"], why, models)


def compare_scalers(df: DataFrame, config: Config = Config(), key: str = v.ID, keep: Sequence[str] = ()) -> tuple[str, dict[str, tuple[Prepared, DataFrame, Sweep]]]:
    """(chosen scaler, sweep per scaler): the higher silhouette at the recommended K decides."""
    runs = {}
    for name in SCALERS:
        scoped = replace(config, scaler=name)
        prepared = prepare(df, scoped, key, keep)
        data = matrix_of(prepared)
        runs[name] = (prepared, data, evaluate(prepared, scoped, data))

    def at_recommended(name: str) -> float:
        sweep = runs[name][2]
        return next((r["silhouette"] for r in sweep.scores if r["k"] == sweep.recommended_k), float("-inf"))

    return max(runs, key=at_recommended), runs


def scaler_table(runs: dict[str, tuple[Prepared, DataFrame, Sweep]]) -> DataFrame:
    """All (scaler, K) scores in one table."""
    frames = [sweep.frame(data.sparkSession) for _, data, sweep in runs.values() if sweep.scores]
    return reduce(lambda a, b: a.unionByName(b), frames)


# --------------------------------------------------- profiles of given labels

def profile_segments(labelled: DataFrame, features: Sequence[str], target: str | None = v.TARGET) -> DataFrame:
    """Size, share, mean and z per feature (long form), and the observed outcome rate, per cluster."""
    features = [c for c in features if c in labelled.columns]
    x = {c: s.value(labelled, c) for c in features}
    stats = {"size": "count(*)", **{f"m_{c}": f"avg({e})" for c, e in x.items()}}
    if target and target in labelled.columns:
        stats["rate"] = f"avg({s.value(labelled, target)}) * 100"
    per = agg(labelled.filter("cluster IS NOT NULL"), stats, ["cluster"])
    whole = agg(labelled, {"total": "count(*)", **{f"a_{c}": f"avg({e})" for c, e in x.items()},
                           **{f"s_{c}": f"stddev_pop({e})" for c, e in x.items()}})
    return unpivot(beside(per, whole), [
        {"feature": s.text(c), "mean": s.name(f"m_{c}"),
         "z": f"coalesce({s.divide(s.name(f'm_{c}') + ' - ' + s.name(f'a_{c}'), s.name(f's_{c}'))}, 0D)",
         "portfolio_mean": s.name(f"a_{c}")} for c in features
    ], keep=["cluster", "size", "total", *(["rate"] if "rate" in stats else [])]).selectExpr(
        "cluster", "size", "size / total * 100 AS share_pct",
        ("rate" if "rate" in stats else "CAST(NULL AS DOUBLE)") + " AS observed_default_rate_pct",
        "feature", "mean", "z", "portfolio_mean",
    )


def name_segments(profile: DataFrame) -> DataFrame:
    """Label, traits and description per cluster from its strongest standardised distances."""
    words = lambda i: "CASE feature " + " ".join(f"WHEN '{c}' THEN '{w[i]}'" for c, w in TRAITS.items()) + " END"
    shown = "CASE feature " + " ".join(f"WHEN '{c}' THEN {e.format(x='mean')}" for c, (_, e) in WORDING.items()) \
        + " ELSE format_string('%.2f', mean) END"
    called = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, (n, _) in WORDING.items()) + " ELSE feature END"
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("z")), "feature"))
    ranked = profile.withColumn("place", place).selectExpr(
        "*", f"IF(abs(z) >= {TRAIT_FROM}, IF(z > 0, {words(0)}, {words(1)}), NULL) AS trait",
        f"concat({called}, ' ', {shown}, format_string(' (%.2f SD ', abs(z)), IF(z > 0, 'above', 'below'), "
        "' the portfolio mean)') AS fragment",
    )
    sums = agg(ranked, {
        "size": "first(size)", "share_pct": "first(share_pct)", "observed_default_rate_pct": "first(observed_default_rate_pct)",
        "traits": "slice(transform(array_sort(collect_list(IF(trait IS NOT NULL, struct(place, trait), NULL))), e -> e.trait), 1, 2)",
        "fragments": "transform(array_sort(collect_list(IF(place <= 3, struct(place, fragment), NULL))), e -> e.fragment)",
    }, ["cluster"])
    return sums.selectExpr(
        "cluster", "size", "share_pct", "observed_default_rate_pct", "concat_ws(' / ', traits) AS traits",
        "CASE size(traits) WHEN 0 THEN 'Mid-Range / Typical-Behaviour' WHEN 1 THEN concat(traits[0], ' / Otherwise-Typical') "
        "ELSE concat_ws(' / ', traits) END AS label",
        "IF(size(traits) = 0, 'Close to the portfolio average on every clustering feature.', "
        "concat('Characterised by ', concat_ws('; ', fragments), '.')) AS description",
    ).selectExpr("*", "concat('Segment ', cluster + 1, ' · ', label) AS display_name")


def interpret(named: DataFrame, overall_rate: float | None) -> DataFrame:
    """Fact, behaviour, observed outcome and implication of each segment, in plain words."""
    rate, whole = "observed_default_rate_pct", "CAST(NULL AS DOUBLE)" if overall_rate is None else s.number(overall_rate)
    gap = f"({rate} - {whole})"
    return named.selectExpr(
        "cluster", "display_name",
        "concat(format_number(size, 0), ' customers (', format_string('%.1f', share_pct), '% of the portfolio).') AS fact",
        "description AS behaviour",
        f"CASE WHEN {rate} IS NULL THEN 'No outcome column is available for this selection.' "
        f"WHEN {whole} IS NULL THEN format_string('Observed default rate %.2f%%.', {rate}) "
        f"ELSE concat(format_string('Observed default rate %.2f%%, %.2f points ', {rate}, abs({gap})), "
        f"IF({gap} > 0, 'above', 'below'), format_string(' the portfolio rate of %.2f%%. A past outcome, not a forecast.', {whole})) "
        "END AS observed_risk",
        f"CASE WHEN {rate} IS NULL OR {whole} IS NULL THEN 'Can be watched as a group once an outcome is available.' "
        f"WHEN {gap} > 0 THEN 'Defined by behaviour seen every month; a candidate for closer review.' "
        "ELSE 'A lower observed rate; worth understanding before treating it like the rest.' END AS implication",
    )


def normalised_profiles(profile: DataFrame) -> DataFrame:
    """Feature means scaled to 0-1 across the segments; 0.5 where all segments agree."""
    w = Window.partitionBy("feature")
    return profile.withColumns({"low": F.min("mean").over(w), "high": F.max("mean").over(w)}).selectExpr(
        "cluster", "feature", f"coalesce({s.divide('mean - low', 'high - low')}, 0.5D) AS normalised"
    )


def assign_to(selection: DataFrame, labels: DataFrame, key: str = v.ID) -> DataFrame:
    """Segment of each selected client; clients unknown to the model get null."""
    return selection.join(labels, key, "left")


def share_comparison(selection: DataFrame, portfolio: DataFrame, column: str = "segment") -> DataFrame:
    """Share of each segment in the selection against the portfolio, in points."""
    def shares(df: DataFrame, n: str, p: str) -> DataFrame:
        counts = agg(df.filter(f"{s.name(column)} IS NOT NULL"), {n: "count(*)"}, [column])
        return beside(counts, agg(df, {"__t": "count(*)"})).selectExpr(s.name(column), n, f"{n} / __t * 100 AS {p}")

    a, b = shares(selection, "clients", "selection_pct"), shares(portfolio, "portfolio_clients", "portfolio_pct")
    return a.join(b, column, "left").selectExpr(
        s.name(column), "clients", "selection_pct", "coalesce(portfolio_pct, 0D) AS portfolio_pct",
        "selection_pct - coalesce(portfolio_pct, 0D) AS difference_pp",
    )


def project_2d(data: DataFrame, features: Sequence[str], n_components: int = 2) -> tuple[DataFrame, list[float]]:
    """(rows with pc1, pc2, explained variance shares): centred first, largest loading positive."""
    n = min(n_components, len(features))
    cols = [f"z_{c}" for c in features]
    means = agg(data, {c: f"avg({s.name(c)})" for c in cols}).first()
    centred = s.project(data, {f"p_{c}": f"{s.name(c)} - {s.number(means[c])}" for c in cols})
    assembled = VectorAssembler(inputCols=[f"p_{c}" for c in cols], outputCol="centred").transform(centred)
    model = PCA(k=n, inputCol="centred", outputCol="components").fit(assembled)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(n)]
    out = model.transform(assembled).withColumn("__pc", vector_to_array("components"))
    axes = [f"__pc[{j}] * {s.number(signs[j])} AS pc{j + 1}" for j in range(n)] + (["0D AS pc2"] if n == 1 else [])
    return out.selectExpr(*[s.name(c) for c in data.columns], *axes), [float(x) for x in model.explainedVariance.toArray()]


def run_segmentation(df: DataFrame, config: Config = Config(), k: int | None = None, compare: bool = True,
                     target: str | None = v.TARGET, key: str = v.ID) -> dict[str, DataFrame]:
    """Scaler comparison, K sweep, fit, profiles and projection; or a ``status`` table with the refusal."""
    spark, n = df.sparkSession, df.count()
    if n < MIN_ROWS:
        return {"status": eda.status(spark, "segmentation", n, MIN_ROWS, "Too few clients for stable segments.")}
    if not any(c in df.columns for c in config.features):
        return {"status": eda.status(spark, "segmentation", n, MIN_ROWS, "No clustering feature is present.")}
    kept = [target] if target and target in df.columns else []
    try:
        if compare:
            chosen, runs = compare_scalers(df, config, key, kept)
            config = replace(config, scaler=chosen)
            prepared, data, sweep = runs[chosen]
            scores = scaler_table(runs) if any(r[2].scores for r in runs.values()) else None
        else:
            prepared = prepare(df, config, key, kept)
            data = matrix_of(prepared)
            sweep = evaluate(prepared, config, data)
            scores = sweep.frame(spark) if sweep.scores else None
    except ValueError as problem:
        return {"status": eda.status(spark, "segmentation", n, MIN_ROWS, str(problem))}
    if not sweep.scores:
        return {"status": eda.status(spark, "segmentation", n, MIN_ROWS, sweep.rationale)}
    k = max(2, min(k or sweep.recommended_k, prepared.n_rows - 1))
    model = sweep.models.get(k) or fit_many(data, prepared.features, [k], config, key)[k]
    clustered = assign(model, data)
    raw = clustered.selectExpr(s.name(key), "cluster", *[f"{s.name('raw_' + c)} AS {s.name(c)}" for c in prepared.features], *map(s.name, kept))
    profile = profile_segments(raw, prepared.features, target)
    named = name_segments(profile)
    projected, explained = project_2d(clustered, prepared.features)
    labels = raw.select(key, "cluster").join(F.broadcast(named.selectExpr("cluster", "display_name AS segment")), "cluster")
    facts = [Row("recommended_k", str(sweep.recommended_k)), Row("fitted_k", str(k)), Row("scaler", config.scaler),
             Row("elbow_k", str(sweep.elbow_k)), Row("rationale", sweep.rationale),
             Row("explained_variance", ", ".join(f"{x:.6f}" for x in explained))]
    facts += [Row(f"imputed:{c}", f"{prepared.missing[c]} with {x}") for c, x in prepared.imputed.items()]
    facts += [Row(f"excluded:{c}", why) for c, why in prepared.excluded.items()]
    overall = df.agg(F.expr(f"avg({s.value(df, target)}) * 100")).first()[0] if kept else None
    return {
        "scores": scores, "labels": labels, "profile": profile, "segments": named,
        "interpretation": interpret(named, overall), "normalised": normalised_profiles(profile),
        "projection": projected.select(key, "cluster", "pc1", "pc2"),
        "facts": spark.createDataFrame(facts, "name string, value string"),
    }
