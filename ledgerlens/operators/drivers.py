"""Associations between features and a binary outcome.

The rank methods work on one table of distinct values per feature with their
class counts, so ranks never have to be joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import session
from ledgerlens import vocabulary as v
from ledgerlens.functions import pvalues
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, unpivot
from ledgerlens.operators import eda
from ledgerlens.operators.quantiles import melt
from ledgerlens.operators.ranking import value_ranks
from ledgerlens.roles import Roles
from ledgerlens.settings import DEFAULTS, Settings

MIN_PAIRS = 10
MIN_ROWS = 50
MAX_LEVELS = 30
# key, protected attributes and bookkeeping flags are never offered as drivers
EXCLUDED = {
    "client_id", "sex", "sex_code", "marriage", "marriage_code", "is_duplicate_excluding_id", "has_extreme_value",
}
EVIDENCE = ["feature", "method", "statistic", "effect_size", "effect_name", "strength", "direction", "p_value", "n_used"]


def candidate_features(df: DataFrame, target: str = v.TARGET, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns worth testing: not constant, categorical ones with at most 30 levels."""
    left_out = EXCLUDED | set(exclude) | {target}
    left_out |= {code for code, (label, _, _) in v.CODED_COLUMNS.items() if label in df.columns}
    numeric, textual = [], []
    for f in df.schema.fields:
        if f.name in left_out or f.name.endswith("_ord"):
            continue
        if s.is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            textual.append(f.name)
    checks = {c: f"min({s.value(df, c)}) < max({s.value(df, c)})" for c in numeric}
    if not numeric and not textual:
        return [], []
    varies = agg(df, {**checks, **{c: f"min({s.name(c)}) < max({s.name(c)})" for c in textual}}).first()
    categorical = []
    for c in textual:
        if varies[c] and df.select(c).dropna().distinct().limit(MAX_LEVELS + 1).count() <= MAX_LEVELS:
            categorical.append(c)
    return [c for c in numeric if varies[c]], categorical


def class_counts(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, value, rows, ones) over rows where both sides are present."""
    with_y = s.project(df, {"__y": s.value(df, target)}).filter("__y IS NOT NULL")
    long = melt(with_y, features, by=["__y"])
    return agg(long, {"rows": "count(*)", "ones": "count_if(__y = 1)"}, ["feature", "value"])


def ranked_values(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    return value_ranks(class_counts(df, target, features), ["feature"])


def _evidence(df: DataFrame, method: str, effect_name: str, signed: bool = True) -> DataFrame:
    direction = "IF(effect_size > 0, 'positive', 'negative')" if signed else "'n/a'"
    return df.selectExpr(
        "feature", f"'{method}' AS method", "double(statistic) AS statistic", "double(effect_size) AS effect_size",
        f"{s.text(effect_name)} AS effect_name", f"{s.strength('effect_size')} AS strength", f"{direction} AS direction",
        "p_value", "n_used",
    )


def spearman_with_outcome(ranks: DataFrame) -> DataFrame:
    """Rank correlation with the outcome from the value table.

    The outcome has two values, so its average ranks are two constants per feature.
    """
    sums = agg(ranks, {
        "n": "double(sum(rows))", "n1": "double(sum(ones))", "values": "count(*)",
        "sxx": "sum(rows * rank * rank)", "r1": "sum(ones * rank)", "rall": "sum(rows * rank)",
    }, ["feature"]).selectExpr("*", "n - n1 AS n0", "(n + 1) / 2 AS mid").selectExpr(
        "*", "(n0 + 1) / 2 AS rank0", "n0 + (n1 + 1) / 2 AS rank1"
    )
    sxy = "(r1 * rank1 + (rall - r1) * rank0 - n * mid * mid)"
    syy = "(n1 * rank1 * rank1 + n0 * rank0 * rank0 - n * mid * mid)"
    r = s.divide(sxy, f"sqrt((sxx - n * mid * mid) * {syy})")
    found = sums.filter(f"n >= {MIN_PAIRS} AND values >= 2 AND n1 > 0 AND n0 > 0").selectExpr(
        "feature", f"{r} AS effect_size", "bigint(n) AS n_used").filter("effect_size IS NOT NULL")
    tested = found.withColumns({
        "statistic": F.col("effect_size"), "p_value": pvalues.correlation_p_column(F.col("effect_size"), F.col("n_used"))
    })
    return _evidence(tested, "spearman_correlation", "r_s")


def pearson_with_outcome(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    with_y = s.project(df, {"__y": s.value(df, target)}).filter("__y IS NOT NULL")
    found = agg(melt(with_y, features, by=["__y"]), {"effect_size": "corr(value, __y)", "n_used": "count(*)"}, ["feature"])
    found = found.filter(f"n_used >= {MIN_PAIRS} AND effect_size IS NOT NULL AND NOT isnan(effect_size)")
    tested = found.withColumns({
        "statistic": F.col("effect_size"), "p_value": pvalues.correlation_p_column(F.col("effect_size"), F.col("n_used"))
    })
    return _evidence(tested, "pearson_correlation", "r")


def mann_whitney(ranks: DataFrame) -> DataFrame:
    """U of the positive class, rank-biserial effect, and the normal p with tie and continuity correction."""
    sums = agg(ranks, {
        "n": "double(sum(rows))", "n1": "double(sum(ones))", "values": "count(*)", "r1": "sum(ones * rank)",
        "ties": "sum(double(rows) * rows * rows - rows)",
    }, ["feature"]).selectExpr("*", "n - n1 AS n0").filter(f"n1 >= {MIN_PAIRS} AND n0 >= {MIN_PAIRS} AND values >= 2")
    scored = sums.selectExpr("*", "r1 - n1 * (n1 + 1) / 2 AS statistic").selectExpr(
        "*", "2 * statistic / (n1 * n0) - 1 AS effect_size", "n1 * n0 / 2 AS mean_u",
        "sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sd_u",
    ).selectExpr(
        "*", "bigint(n) AS n_used", f"{s.divide('greatest(abs(statistic - mean_u) - 0.5D, -0.5D)', 'sd_u')} AS z"
    )
    p = F.least(F.lit(1.0), F.when(F.col("z") < 0, F.lit(1.0)).otherwise(pvalues.normal_p_column(F.col("z"))))
    return _evidence(scored.withColumn("p_value", p), "mann_whitney_u", "rank-biserial r")


def class_profiles(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Mean and median of every feature in each outcome class."""
    return eda.numeric_by_outcome(df, features, target, min_rows=0).select(
        "feature", "n_positive", "n_negative", "mean_positive", "mean_negative", "median_positive", "median_negative"
    )


def level_counts(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, level, n, events) per categorical level."""
    entries = [{"feature": s.text(c), "level": f"CAST({s.name(c)} AS STRING)"} for c in features]
    long = unpivot(s.project(df, {"__y": s.value(df, target)}).filter("__y IS NOT NULL"), entries, keep=["__y"])
    return agg(long.filter("level IS NOT NULL"), {"n": "count(*)", "events": "count_if(__y = 1)"}, ["feature", "level"])


def chi_square(df: DataFrame, target: str, features: Sequence[str], min_expected: int = 5) -> DataFrame:
    """Chi-square test and Cramér's V per feature; a 2 x 2 table gets the Yates correction."""
    levels = level_counts(df, target, features)
    whole = agg(levels, {"total": "sum(n)", "all_events": "sum(events)", "k": "count(*)"}, ["feature"])
    cells = levels.join(F.broadcast(whole), "feature").filter("k >= 2 AND all_events > 0 AND all_events < total")
    both = cells.selectExpr(
        "feature", "level", "k", "total", "n", "events",
        "inline(array(struct(double(events) AS seen, double(n) * all_events / total AS expected), "
        "struct(double(n - events) AS seen, double(n) * (total - all_events) / total AS expected)))",
    )
    gap = "IF(k = 2, greatest(abs(seen - expected) - 0.5D, 0D), abs(seen - expected))"
    tests = agg(both, {
        "statistic": f"sum({gap} * {gap} / expected)", "n_used": "first(total)", "k": "first(k)",
        "min_expected": "min(expected)",
        "rates": "map_from_entries(array_sort(collect_set(struct(level, round(events / n * 100, 4)))))",
    }, ["feature"]).selectExpr("*", "sqrt(statistic / n_used) AS effect_size", "k - 1 AS dof")
    tested = tests.withColumn("p_value", pvalues.chi2_p_column(F.col("statistic"), F.col("dof")))
    return _evidence(tested, "chi_square", "Cramer's V", signed=False).join(
        tested.selectExpr("feature", "k AS n_categories", "min_expected", f"min_expected >= {min_expected} AS assumption_met", "rates"),
        "feature",
    )


def tree_importance(df: DataFrame, target: str, features: Sequence[str], settings: Settings = DEFAULTS) -> DataFrame | None:
    """Impurity importance of a depth-5 tree with balanced classes; None when it cannot be fitted.

    Complete cases only, at least 50 of them, at least 50 rows in a leaf.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    used = [c for c in features if c in df.columns]
    picked = df.selectExpr(f"{s.value(df, target)} AS __y", *[f"{s.value(df, c)} AS {s.name(c)}" for c in used]).dropna()
    picked = session.reuse(picked)  # counting, binning and growing the tree each read the complete cases
    counts = {r["__y"]: r["count"] for r in picked.groupBy("__y").count().collect()}
    n = sum(counts.values())
    if not used or n < MIN_ROWS or len(counts) < 2:
        picked.unpersist()
        return None
    weight = "CASE " + " ".join(f"WHEN __y = {s.number(y)} THEN {n / (len(counts) * c)!r}D" for y, c in counts.items()) + " END"
    vectors = VectorAssembler(inputCols=used, outputCol="__x").transform(s.project(picked, {"__w": weight}))
    model = DecisionTreeClassifier(
        featuresCol="__x", labelCol="__y", weightCol="__w", maxDepth=5, minInstancesPerNode=50, maxBins=256,
        seed=settings.seed,
    ).fit(vectors)
    picked.unpersist()
    rows = [(c, float(x), n) for c, x in zip(used, model.featureImportances.toArray()) if x > 0]
    found = df.sparkSession.createDataFrame(rows, "feature string, statistic double, n_used long").selectExpr(
        "feature", "statistic", "statistic AS effect_size", "CAST(NULL AS DOUBLE) AS p_value", "n_used"
    )
    return _evidence(found, "tree_importance", "relative importance", signed=False)


def consensus(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Features ranked by how many methods found something, then by mean effect; all of them unless ``limit`` is given."""
    size = "round(abs(effect_size), 6)"
    ranked = agg(evidence, {
        "n_methods": "count(*)", "n_methods_non_negligible": "count_if(strength <> 'negligible')",
        "mean_effect_size": f"round(avg({size}), 6)", "max_effect_size": f"round(max({size}), 6)",
        "methods": "array_sort(collect_list(method))",
        "signs": "array_sort(collect_set(IF(direction IN ('positive', 'negative'), direction, NULL)))",
    }, ["feature"])
    ordered = ranked.selectExpr(
        "feature", "n_methods", "n_methods_non_negligible", "mean_effect_size", "max_effect_size",
        "CASE size(signs) WHEN 0 THEN 'n/a' WHEN 1 THEN signs[0] ELSE 'mixed' END AS direction",
        "concat_ws(', ', methods) AS methods",
    ).orderBy(F.desc("n_methods_non_negligible"), F.desc("mean_effect_size"), "feature")
    return ordered if limit is None else ordered.limit(limit)


def sentences(evidence: DataFrame, outcome: str = "the outcome") -> DataFrame:
    """One association sentence per evidence row; no causal or predictive wording."""
    label = s.text(outcome)
    return evidence.selectExpr(
        "feature", "method",
        f"CASE WHEN strength = 'negligible' THEN concat(\"'\", feature, \"' has no meaningful association with \", {label}, "
        "format_string(' (%s = %.3f)', effect_name, effect_size)) "
        "WHEN method = 'tree_importance' THEN "
        f"concat(\"'\", feature, \"' accounts for \", format_string('%.1f%%', effect_size * 100), "
        f"' of the splits of a shallow exploratory tree on ', {label}) "
        "WHEN method = 'chi_square' THEN "
        f"concat(\"'\", feature, \"' shows a \", strength, ' association with ', {label}, "
        "format_string(' across its categories (V = %.3f)', effect_size)) "
        f"ELSE concat(\"'\", feature, \"' shows a \", strength, ' ', direction, ' association with ', {label}, "
        "format_string(' (%s = %.3f)', effect_name, effect_size)) END AS sentence",
    )


def run_drivers(df: DataFrame, target: str | None = None, settings: Settings = DEFAULTS,
                include_tree: bool = True) -> dict[str, DataFrame]:
    """All methods and their consensus, or a single ``status`` table with the refusal."""
    spark, target = df.sparkSession, target or Roles.of(df).one("target")
    required = max(settings.min_rows, MIN_ROWS)
    if target is None or target not in df.columns:
        return {"status": eda.status(spark, "driver analysis", df.count(), required, "There is no outcome column.")}
    y = s.value(df, target)
    size = agg(df, {"n": "count(*)", "low": f"min({y})", "high": f"max({y})"}).first()
    if size["n"] < required:
        return {"status": eda.status(spark, "driver analysis", size["n"], required, "Too few rows.")}
    if size["low"] is None or size["low"] == size["high"]:
        return {"status": eda.status(spark, "driver analysis", size["n"], required, "The outcome has one class only.")}
    numeric, categorical = candidate_features(df, target)
    ranks = ranked_values(df, target, numeric)
    out = {
        "correlations": spearman_with_outcome(ranks),
        "numeric_comparisons": mann_whitney(ranks),
        "categorical_tests": chi_square(df, target, categorical),
    }
    tree = tree_importance(df, target, numeric, settings) if include_tree else None
    if tree is not None:
        out["tree_importances"] = tree
    evidence = [part.select(*EVIDENCE) for part in out.values()]
    union = evidence[0]
    for part in evidence[1:]:
        union = union.unionByName(part)
    out["evidence"], out["consensus"], out["sentences"] = union, consensus(union), sentences(union)
    return out
