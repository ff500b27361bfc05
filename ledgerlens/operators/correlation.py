"""Pairwise-complete correlations of many columns in two scans.

The first scan centres the columns; in the second each task multiplies its rows
into square matrices of sums, and one row per pair and task is added up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg, unpivot
from ledgerlens.operators.eda import numeric_columns, status
from ledgerlens.operators.ranking import SMALL_BYTES, attach_ranks, running_before
from ledgerlens.settings import DEFAULTS

def restating_pairs(columns: Sequence[str]) -> set[frozenset[str]]:
    """Pairs of columns whose correlation only shows how they were computed.

    The columns of each measure are linked among themselves and with the columns
    of the measures it is computed from.
    """
    members = {measure: [c for c in columns if c.startswith(stems)] for measure, stems in v.DERIVATION_FAMILIES.items()}
    links = [(m, m) for m in members] + [(m, source) for m, sources in v.FAMILY_DEPENDENCIES.items() for source in sources]
    return {frozenset(pair) for one, other in links for pair in product(members[one], members[other])}


NO_VARIANCE = 1e-12  # share of a mean square below which its centred part is rounding

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _cross_sums(shift: np.ndarray, lefts: np.ndarray, rights: np.ndarray):
    """Batches of columns to the sums of every wanted pair over the rows where both have a value.

    Products with the 0/1 matrix of present values give all pairs at once, by
    matrix multiplication; a task holds six square matrices of the columns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(shift), len(shift)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift[:, None]
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([there @ there.T, x @ there.T, (x * x) @ there.T, x @ x.T])
        n, s1, s2, sxy = total
        columns = [n[lefts, rights], s1[lefts, rights], s1[rights, lefts], s2[lefts, rights], s2[rights, lefts], sxy[lefts, rights]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lefts))), *map(pa.array, columns)], names=["pair", *_SUMS])

    return run


def _correlate(df: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """corr per (left, right, x expression, y expression) over the rows where neither is null: one scan for all pairs."""
    place: dict[str, int] = {}
    for _, _, x, y in pairs:
        place.setdefault(x, len(place))
        place.setdefault(y, len(place))
    columns = df.selectExpr(*[f"double({x}) AS x{i}" for x, i in place.items()])
    means = agg(columns, {c: f"avg({c})" for c in columns.columns}).first()
    lefts, rights = (np.array([place[p[side]] for p in pairs]) for side in (2, 3))
    sums = columns.mapInArrow(_cross_sums(np.array([m or 0.0 for m in means]), lefts, rights), "pair long, " + ", ".join(f"{c} double" for c in _SUMS))
    total = agg(sums, {c: f"sum({c})" for c in _SUMS}, ["pair"]).selectExpr(
        "pair", "n", "sxy - sx * sy / n AS xy", f"IF(sxx - sx * sx / n > {NO_VARIANCE} * sxx, sxx - sx * sx / n, NULL) AS xx",
        f"IF(syy - sy * sy / n > {NO_VARIANCE} * syy, syy - sy * sy / n, NULL) AS yy").filter("n > 0")
    lefts_, rights_ = ("array(" + ", ".join(s.text(p[side]) for p in pairs) + ")" for side in (0, 1))
    return total.selectExpr(f"get({lefts_}, int(pair)) AS left", f"get({rights_}, int(pair)) AS right",
                            "IF(xx IS NULL OR yy IS NULL OR xy IS NULL, NULL, greatest(-1D, least(1D, xy / (sqrt(xx) * sqrt(yy))))) AS correlation", "bigint(n) AS n")


def _null_masks(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> dict[str, str]:
    """Column with nulls -> the column that stands for its null pattern.

    Columns with equal signatures are compared exactly before they share a mask.
    """
    row = "xxhash64(" + ", ".join(s.name(k) for k in key) + ")"
    gone = {c: f"({s.value(df, c)} IS NULL)" for c in columns}
    sign = agg(df, {c: f"struct(count_if({g}) AS n, bit_xor(IF({g}, {row}, 0L)) AS h)" for c, g in gone.items()}).first()
    leaders: dict[tuple, str] = {}
    mask = {}
    for c in columns:
        if sign[c]["n"]:
            mask[c] = leaders.setdefault((sign[c]["n"], sign[c]["h"]), c)
    shared = [c for c in mask if mask[c] != c]
    if shared:
        differ = agg(df, {c: f"count_if({gone[c]} <> {gone[mask[c]]})" for c in shared}).first()
        mask.update({c: c for c in shared if differ[c]})
    return mask


def spearman_pairs(df: DataFrame, columns: Sequence[str], key: Sequence[str] = (v.ID,)) -> DataFrame:
    """Spearman for every pair, each over the rows where both columns have a value.

    Ranks depend on which rows take part, so a column is ranked once per distinct
    null pattern it is paired with.  ``key`` must identify a row.
    """
    columns = list(columns)
    mask = _null_masks(df, columns, key)
    index: dict[tuple[str, str | None], int] = {}
    variant = lambda c, m: index.setdefault((c, None if m == mask.get(c) else m), len(index))
    wanted = [(a, b, variant(a, mask.get(b)), variant(b, mask.get(a))) for a, b in combinations(columns, 2)]

    entries = []
    for (c, m), i in index.items():
        x = s.value(df, c)
        entries.append({"variant": str(i), "value": x if m is None else f"IF({s.value(df, m)} IS NOT NULL, {x}, NULL)"})
    long = unpivot(df, entries, keep=key)
    ranked = attach_ranks(long.filter("value IS NOT NULL"), ["variant"]).select(*key, "variant", F.col("rank").cast("double"))
    unranked = long.filter("value IS NULL").selectExpr(*[s.name(k) for k in key], "variant", "CAST(NULL AS DOUBLE) AS rank")
    # one entry per variant and row, so the sorted list is addressed by variant number
    wide = agg(ranked.unionByName(unranked), {
        "ranks": "transform(array_sort(collect_list(struct(variant, rank))), e -> e.rank)"
    }, list(key))
    checked = wide.selectExpr(
        f"IF(size(ranks) = {len(index)}, ranks, "
        "CAST(raise_error('the key does not identify a row') AS ARRAY<DOUBLE>)) AS ranks"
    )
    checked = session.reuse(checked)  # both scans of _correlate read the ranks, which cost more than the scans
    return _correlate(checked, [(a, b, f"ranks[{i}]", f"ranks[{j}]") for a, b, i, j in wanted])


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _correlate(df, [(a, b, s.value(df, a), s.value(df, b)) for a, b in combinations(columns, 2)])


def kendall_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kendall's tau-b, exact, without comparing rows with each other.

    The y values get dense codes.  Two different codes first differ in one binary
    digit, so every pair of cells is met at exactly one digit: for each digit and
    shared prefix, a running count over x gives how many smaller-x cells carry
    the other digit.  That is n log n rows of work in place of n squared pairs.
    """
    pairs = list(combinations(columns, 2))
    entries = [{"pair": str(i), "x": s.value(df, a), "y": s.value(df, b)} for i, (a, b) in enumerate(pairs)]
    cells = session.reuse(agg(unpivot(df, entries).filter("x IS NOT NULL AND y IS NOT NULL"), {"n": "double(count(*))"}, ["pair", "x", "y"]))
    cells.count()  # the rows are read once, and the plans below know how large the cells are
    ties = lambda side: agg(agg(cells, {"t": "sum(n)"}, ["pair", side]),
                            {f"ties_{side}": "sum(t * (t - 1) / 2)"}, ["pair"])
    codes = running_before(agg(cells, {"one": "1L"}, ["pair", "y"]), ["pair"], "y", ["one"]).selectExpr(
        "pair", "y", "one_before AS code"
    )
    largest = agg(codes, {"m": "max(code)"}).first()["m"]
    levels = max(1, int(largest or 0).bit_length())
    coded = cells.join(codes, ["pair", "y"])
    digits = coded.selectExpr("pair", "x", "n", "code", f"explode(sequence(0, {levels - 1})) AS level").selectExpr(
        "pair", "level", "shiftright(code, level + 1) AS prefix", "x",
        "IF(shiftright(code, level) & 1 = 0, n, 0D) AS zeros", "IF(shiftright(code, level) & 1 = 1, n, 0D) AS ones",
    )
    per_x = agg(digits, {"zeros": "sum(zeros)", "ones": "sum(ones)"}, ["pair", "level", "prefix", "x"])
    small = session.planned_bytes(cells) * levels <= SMALL_BYTES  # a cell is one row a level; the plan's own guess multiplies the sides of the join
    running = running_before(per_x, ["pair", "level", "prefix"], "x", ["zeros", "ones"], small)
    score = agg(running, {"s": "sum(ones * zeros_before - zeros * ones_before)"}, ["pair"])
    size = agg(cells, {"n": "sum(n)"}, ["pair"])
    joined = size.join(score, "pair").join(ties("x"), "pair").join(ties("y"), "pair")
    names = lambda i: "array(" + ", ".join(s.text(p[i]) for p in pairs) + ")"
    total = "n * (n - 1) / 2"
    return joined.selectExpr(
        f"get({names(0)}, pair) AS left", f"get({names(1)}, pair) AS right",
        f"{s.divide('s', f'sqrt(({total} - ties_x) * ({total} - ties_y))')} AS correlation", "bigint(n) AS n",
    )


METHODS = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "spearman",
                      key: Sequence[str] = (v.ID,), min_rows: int = DEFAULTS.min_rows) -> DataFrame:
    """One row per pair with a defined correlation: value, n, strength, direction, restates.

    Refuses (status row) with fewer than ``min_rows`` rows or fewer than two columns.
    """
    analysis = f"{method.capitalize()} correlation analysis"
    n = df.limit(min_rows).count()
    if n < min_rows:
        return status(df.sparkSession, analysis, n, min_rows, "Correlations of very few rows are unstable.")
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if len(columns) < 2:
        return status(df.sparkSession, analysis, df.count(), min_rows, "At least two numeric columns are needed.")
    found = spearman_pairs(df, columns, key) if method == "spearman" else METHODS[method](df, columns)
    restating = restating_pairs(columns)
    redundant = [f"{a}|{b}" for a, b in combinations(columns, 2) if {a, b} in restating]
    listed = "array(" + ", ".join(s.text(r) for r in redundant) + ")" if redundant else "CAST(array() AS ARRAY<STRING>)"
    return found.filter("NOT isnan(correlation)").selectExpr(
        "left", "right", "correlation", "n", f"{s.strength('correlation')} AS strength",
        "IF(correlation > 0, 'positive', 'negative') AS direction",
        f"array_contains({listed}, concat(left, '|', right)) AS restates",
        "concat(\"'\", left, \"' and '\", right, \"' move together: \", "
        f"{s.strength('correlation')}, IF(correlation > 0, ' positive', ' negative'), "
        "format_string(' association (r = %.3f)', correlation)) AS sentence",
    )


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every column has a finite value."""
    return df.filter(" AND ".join(f"{s.value(df, c)} IS NOT NULL" for c in columns))


def matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles and the diagonal, as (row, column, correlation); the pairs are computed once."""
    cells = unpivot(pairs, [
        {"row": "left", "column": "right", "correlation": "correlation"}, {"row": "right", "column": "left", "correlation": "correlation"},
        {"row": "left", "column": "left", "correlation": "1D"}, {"row": "right", "column": "right", "correlation": "1D"},
    ])
    return agg(cells, {"correlation": "first(correlation)"}, ["row", "column"])


def top_pairs(pairs: DataFrame, limit: int | None = None, keep_restatements: bool = False) -> DataFrame:
    """Pairs by falling strength; all of them unless ``limit`` is given."""
    kept = pairs if keep_restatements else pairs.filter("NOT restates")
    ordered = kept.orderBy(F.desc(F.abs("correlation")), "left", "right")
    return ordered if limit is None else ordered.limit(limit)


def busiest_columns(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with the largest mean absolute correlation (the heat-map pick)."""
    sides = matrix(pairs).filter("row <> column")
    ordered = agg(sides, {"mean_abs": "avg(abs(correlation))"}, ["row"]).withColumnRenamed("row", "column").orderBy(F.desc("mean_abs"), "column")
    return ordered if limit is None else ordered.limit(limit)
