"""Filtering a portfolio by a specification, and looking through the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg
from ledgerlens.operators.quantiles import quantile_values
from ledgerlens.roles import Roles

CATEGORIES = ("education", "marriage", "sex")
RANGES = {"age": "age", "limit": "credit_limit", "utilisation": "utilisation_latest"}
DELINQUENCY = {
    "current": ("is_currently_delinquent", "coalesce(is_currently_delinquent, false)"),
    "ever": ("ever_delinquent", "coalesce(ever_delinquent, false)"),
    "never": ("ever_delinquent", "NOT coalesce(ever_delinquent, false)"),
}


@dataclass(frozen=True)
class Spec:
    """What to keep.  ``None`` leaves a dimension open; an empty tuple selects nothing."""

    age: tuple[float, float] | None = None
    limit: tuple[float, float] | None = None
    utilisation: tuple[float, float] | None = None
    education: tuple[str, ...] | None = None
    marriage: tuple[str, ...] | None = None
    sex: tuple[str, ...] | None = None
    delinquency: str = "all"


@dataclass(frozen=True)
class Bounds:
    age: tuple[float, float] = (0, 100)
    limit: tuple[float, float] = (0.0, 1_000_000.0)
    utilisation: tuple[float, float] = (0.0, 1.0)
    options: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Selection:
    data: DataFrame
    spec: Spec
    applied: tuple[str, ...]
    skipped: tuple[str, ...]
    condition: str

    @property
    def is_filtered(self) -> bool:
        return bool(self.applied)


def bounds_table(df: DataFrame) -> DataFrame:
    """Selectable ranges and options as one row (utilisation ends at its 99.5th percentile)."""
    roles = Roles.of(df)
    stats = {}
    for name, column in (("age", roles.one("age")), ("limit", roles.one("credit_limit"))):
        if column:
            stats[f"{name}_min"] = f"double(min({s.value(df, column)}))"
            stats[f"{name}_max"] = f"double(max({s.value(df, column)}))"
    if "utilisation_latest" in df.columns:
        stats["utilisation_min"] = f"floor(min({s.value(df, 'utilisation_latest')}) * 100) / 100"
    for c in CATEGORIES:
        if c in df.columns:  # label columns: as many values as their code list
            stats[f"{c}_options"] = f"array_sort(collect_set({s.name(c)}))"
    row = agg(df, {"n_rows": "count(*)", **stats})
    if "utilisation_latest" in df.columns:
        top = quantile_values(df, ["utilisation_latest"], (0.995,))["utilisation_latest"].get(0.995)
        upper = "CAST(NULL AS DOUBLE)" if top is None else s.number(ceil(top * 100) / 100)
        row = row.selectExpr("*", f"{upper} AS raw_max").selectExpr(
            "*", "IF(raw_max <= utilisation_min, utilisation_min + 1, raw_max) AS utilisation_max").drop("raw_max")
    return row


def derive_bounds(df: DataFrame) -> Bounds:
    row = bounds_table(df).first().asDict()
    if not row["n_rows"]:
        return Bounds()
    def pair(name: str, absent: tuple[float, float], empty: tuple[float, float]) -> tuple[float, float]:
        if f"{name}_min" not in row:
            return absent
        low, high = row[f"{name}_min"], row[f"{name}_max"]
        return empty if low is None or high is None else (low, high)

    return Bounds(
        pair("age", (0, 0), (0, 100)), pair("limit", (0.0, 0.0), (0.0, 0.0)), pair("utilisation", (0.0, 0.0), (0.0, 1.0)),
        {c: tuple(row[f"{c}_options"]) for c in CATEGORIES if f"{c}_options" in row},
    )


def default_spec(bounds: Bounds) -> Spec:
    ranges = {n: getattr(bounds, n) for n in RANGES}
    return Spec(
        **{n: r if r[1] > r[0] else None for n, r in ranges.items()},
        **{c: bounds.options.get(c) or None for c in CATEGORIES},
    )


def is_default(spec: Spec, bounds: Bounds) -> bool:
    return spec in (default_spec(bounds), Spec())


def apply(df: DataFrame, spec: Spec, bounds: Bounds | None = None) -> Selection:
    """AND-ed predicates for the dimensions that really narrow the data.

    A full range or a full option list adds no predicate, so the rest can be
    pushed to the scan; a dimension without its column is reported as skipped.
    """
    bounds = bounds or derive_bounds(df)
    roles = Roles.of(df)
    columns = {"age": roles.one("age"), "limit": roles.one("credit_limit"), "utilisation": "utilisation_latest"}
    parts, applied, skipped = [], [], []
    for name, column in columns.items():
        wanted = getattr(spec, name)
        if wanted is None:
            continue
        if column is None or column not in df.columns:
            skipped.append(name)
            continue
        low, high = getattr(bounds, name)
        if wanted[0] <= low and wanted[1] >= high:
            continue
        # a bare numeric column can be pushed to the scan; a finite range excludes NaN by itself
        x = s.name(column) if s.is_numeric(df.schema[column].dataType) else s.value(df, column)
        parts.append(f"({x} BETWEEN {s.number(wanted[0])} AND {s.number(wanted[1])})")
        applied.append(f"{name} {wanted[0]:g} to {wanted[1]:g}")
    for name in CATEGORIES:
        wanted = getattr(spec, name)
        if wanted is None:
            continue
        if name not in df.columns:
            skipped.append(name)
        elif not wanted:
            parts.append("false")
            applied.append(f"{name}: none selected")
        elif set(wanted) != set(bounds.options.get(name, ())):
            parts.append(f"({s.name(name)} IN ({', '.join(s.text(w) for w in sorted(set(wanted)))}))")
            applied.append(f"{name}: {', '.join(sorted(set(wanted)))}")
    if spec.delinquency and spec.delinquency != "all":
        column, condition = DELINQUENCY.get(spec.delinquency, (None, None))
        if column in df.columns:
            parts.append(f"({condition})")
            applied.append(f"delinquency: {spec.delinquency}")
        else:
            skipped.append("delinquency")
    condition = " AND ".join(parts) or "true"
    data = df.filter(condition) if parts else df
    return Selection(data, spec, tuple(applied), tuple(skipped), condition)


def selection_counts(df: DataFrame, selection: Selection) -> DataFrame:
    """Total, selected and excluded rows and the share, in one aggregation."""
    counts = agg(df, {"n_total": "count(*)", "n_selected": f"count_if({selection.condition})"})
    return counts.selectExpr(
        "n_total", "n_selected", "n_total - n_selected AS n_excluded",
        f"coalesce({s.divide('n_selected', 'n_total')}, 0D) * 100 AS share_pct",
    )


def option_differences(df: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """Per category: options available, chosen ones that do not exist, available ones left out."""
    out = None
    for c, wanted in chosen.items():
        listed = "array(" + ", ".join(s.text(w) for w in wanted) + ")" if wanted else "CAST(array() AS ARRAY<STRING>)"
        part = agg(df, {"available": f"array_sort(collect_set({s.name(c)}))"}).selectExpr(
            f"{s.text(c)} AS category", "concat_ws(', ', available) AS available",
            f"concat_ws(', ', array_sort(array_except({listed}, available))) AS not_available",
            f"concat_ws(', ', array_sort(array_except(available, {listed}))) AS left_out",
        )
        out = part if out is None else out.unionByName(part)
    return out


def search(df: DataFrame, needle: str, columns: Sequence[str] | None = None, literal: bool = False) -> DataFrame:
    """Rows whose text in any of the columns matches, ignoring case; a pattern unless ``literal``."""
    columns = list(columns or df.columns)
    if not needle:
        return df
    cells = [f"CAST({s.name(c)} AS STRING)" for c in columns]
    if literal:
        tests = [f"contains(lower({c}), {s.text(needle.lower())})" for c in cells]
    else:
        tests = [f"({c} RLIKE {s.text('(?i)' + needle)})" for c in cells]
    return df.filter(s.row_any(tests))


def page(df: DataFrame, number: int, size: int = 25, order: str = v.ID) -> DataFrame:
    """One page (1-based) in key order."""
    return df.orderBy(order).offset((number - 1) * size).limit(size)


@dataclass(frozen=True)
class Pages:
    """Pages in key order that read only the key ranges they lie in.

    ``ranges`` has one row (low, high, rows, before) for each range: as many as
    the sort has partitions.  Null keys belong to the first range.
    """

    df: DataFrame
    order: str
    size: int
    ranges: tuple

    @property
    def n_rows(self) -> int:
        return sum(r["rows"] for r in self.ranges)

    def page(self, number: int) -> DataFrame:
        """Page ``number`` (1-based): a filter on the key that reaches the scan, then a sort of those ranges."""
        start = (number - 1) * self.size
        own = [r for r in self.ranges if r["before"] < start + self.size and start < r["before"] + r["rows"]]
        if not own:
            return self.df.limit(0)
        key, low, high = F.col(self.order), own[0]["low"], own[-1]["high"]
        within = F.lit(False) if high is None else key <= F.lit(high)
        if low is not None:
            within = within & (key >= F.lit(low))
        if own[0]["before"] == 0:
            within = within | key.isNull()
        return self.df.filter(within).orderBy(self.order).offset(start - own[0]["before"]).limit(self.size)


def pages(df: DataFrame, size: int = 25, order: str = v.ID, ranges: int | None = None) -> Pages:
    """Counts the keys by ranges, once; only keys are shuffled, and equal keys share a range.

    ``ranges``: how many; left out, the session's shuffle settings decide.
    """
    keys = df.select(F.col(order).alias("key"))
    keys = keys.repartitionByRange("key") if ranges is None else keys.repartitionByRange(ranges, "key")
    found = keys.groupBy(F.spark_partition_id().alias("slice")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"))
    before, counted = 0, []
    for r in found.orderBy("slice").collect():
        counted.append({"low": r["low"], "high": r["high"], "rows": r["rows"], "before": before})
        before += r["rows"]
    return Pages(df, order, size, tuple(counted))


def page_count(df: DataFrame, size: int = 25) -> DataFrame:
    return agg(df, {"n_rows": "count(*)", "pages": f"greatest(1L, bigint(ceil(count(*) / {size})))"})


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns that exist, in the order given."""
    return df.select(*[c for c in columns if c in df.columns])


def narrowed(spec: Spec, **changes) -> Spec:
    return replace(spec, **changes)
