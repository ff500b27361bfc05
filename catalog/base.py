"""Shared inputs of the registered queries, and the rounding both sides apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions import scalars as s
from ledgerlens.operators import cleaning, features, panel
from ledgerlens.plans import star


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return star.kept(spark, folder, "raw", lambda: star.clients(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return star.kept(spark, folder, "clean", lambda: cleaning.clean(raw(spark, folder))[0])


def feats(spark: SparkSession, folder: str) -> DataFrame:
    return star.kept(spark, folder, "features", lambda: features.add_features(clean(spark, folder))[0])


def long(spark: SparkSession, folder: str) -> DataFrame:
    return panel.build_panel(feats(spark, folder))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return star.table(spark, folder, name)


def rounded(df: DataFrame, places: int = 6, **by_column: int) -> DataFrame:
    """Doubles rounded for comparison (adding 0.0 removes a negative zero)."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return s.project(df, {c: f"round(double({s.name(c)}), {by_column.get(c, places)}) + 0D" for c in doubles}) if doubles else df
