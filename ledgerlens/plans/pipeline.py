"""The batch pipeline and the interactive selection, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.operators import cleaning, features, findings, kpis, panel, profile, quality, selection
from ledgerlens.roles import Roles
from ledgerlens.settings import DEFAULTS, Settings
from ledgerlens.sources import files


@dataclass
class PipelineResult:
    data: DataFrame
    panel: DataFrame
    validation: DataFrame
    quality: DataFrame
    issues: DataFrame
    cleaning: DataFrame
    features: DataFrame
    unrecognised: list[str] = field(default_factory=list)
    saved: dict[str, str] = field(default_factory=dict)
    save_problem: str | None = None


def run_table(raw: DataFrame, out: str | None = None, settings: Settings = DEFAULTS, **cleaning_options) -> PipelineResult:
    """Quality on the raw table, then clean, features and panel; written when ``out`` is given.

    With a target folder the written tables are what later steps read, so long
    lineage ends there; without one the feature table is kept in executors.
    """
    raw = session.reuse(raw)
    validation = profile.validate(raw)
    score, found = quality.quality_score(raw), quality.issues(raw)
    cleaned, audit = cleaning.clean(raw, **cleaning_options)
    made, skipped = features.add_features(cleaned, settings)
    report = features.feature_report(made, skipped)
    saved, problem = {}, None
    data = session.reuse(made)
    long = panel.build_panel(data)
    if out is not None:
        try:
            saved["clients"] = files.save(data, f"{out}/clients_wide.parquet")
            data = files.load(raw.sparkSession, saved["clients"])
            long = panel.build_panel(data)
            saved["panel"] = files.save(long, f"{out}/panel_long.parquet")
            long = files.load(raw.sparkSession, saved["panel"])
        except Exception as error:  # the results stay usable when they cannot be written
            problem = f"{type(error).__name__}: {error}"
    return PipelineResult(data, long, validation, score, found, audit, report, saved=saved, save_problem=problem)


def run_file(spark: SparkSession, path: str, out: str | None = None, settings: Settings = DEFAULTS) -> PipelineResult:
    raw, _ = files.load_raw(spark, path)
    named, unknown = files.normalise_columns(raw)
    result = run_table(named, out, settings)
    result.unrecognised = unknown
    return result


def selection_context(data: DataFrame, spec: selection.Spec, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Filter once, then KPIs for selection and portfolio, their differences, findings and signals."""
    chosen = selection.apply(data, spec)
    portfolio = kpis.calculate_kpis(data, settings=settings)
    if chosen.is_filtered:
        subset = session.reuse(chosen.data)
        own = kpis.calculate_kpis(subset, settings=settings)
    else:
        subset, own = chosen.data, portfolio
    return {
        "data": subset, "counts": selection.selection_counts(data, chosen), "kpis": own, "portfolio_kpis": portfolio,
        "deltas": kpis.kpi_deltas(own, portfolio), "findings": findings.by_priority(findings.key_findings(subset, settings=settings)),
        "signals": findings.signals(subset, settings=settings),
    }


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document (the serialisable form of any result)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def roles_table(df: DataFrame) -> DataFrame:
    """Roles found and roles missing with the reason."""
    roles = Roles.of(df)
    rows = [(r, True, ", ".join(c), None) for r, c in sorted(roles.found.items())]
    rows += [(r, False, None, why) for r, why in sorted(roles.absent().items())]
    return df.sparkSession.createDataFrame(rows, "role string, present boolean, columns string, reason string")
