"""Exact linear-interpolated quantiles by selection on digits, without a sorted column.

Spark's ``percentile`` keeps a value -> count map of the whole group in a single
aggregation buffer, and sorting puts a column into one task.  Here every wanted
order statistic is closed in on by counting:

1. The first digit of a value is its sign and its binary logarithm in steps of
   1/512.  Counts of the digits (combined before the shuffle) say in which digit
   each wanted position lies, and with which least and greatest value.
2. Values between that least and greatest value are dealt to 65,536 equal steps
   and counted again, until least and greatest are one value.  A range that holds
   at most 65,536 rows needs no steps: its values are counted as they are.

Digits never fall as the value rises, so counting them finds exact order
statistics.  A round narrows a range 65,536-fold: money amounts need one round of
step 2, no column of doubles more than four.  Only rows inside a wanted range are counted
again; a running count sees the digits that occur, at most about a million of one
column in step 1 and 65,536 of one range in step 2, however many rows there are.

The ranges still open decide whether another round runs.  Up to ``HELD`` ranges
pass through the driver between the rounds; more, of many groups, are written to the
shared folder.  Either way the rounds are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.functions.scalars import name, number, text, value
from ledgerlens.functions.tables import agg, unpivot

OCTAVE = 512   # first digits in a factor of two
STEPS = 65_536  # second and later digits in a range, and rows of a range whose values are counted as they are
HELD = 10_000   # ranges that may pass through the driver


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, value) with finite values only; one scan, no shuffle."""
    pairs = [{"feature": text(c), "value": value(df, c)} for c in columns]
    return unpivot(df, pairs, keep=by).filter("value IS NOT NULL")


def _counted(rows: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """Per (keys, digit): how many values, least and greatest, and the running count up to the digit."""
    counts = agg(rows.selectExpr(*map(name, keys), "value", f"{digit} AS digit"),
                 {"many": "count(*)", "least": "min(value)", "most": "max(value)"}, [*keys, "digit"])
    apart = ", ".join(map(name, keys))
    return counts.selectExpr("*", f"sum(many) OVER (PARTITION BY {apart} ORDER BY digit ROWS UNBOUNDED PRECEDING) AS upto",
                             f"sum(many) OVER (PARTITION BY {apart}) AS n")


def _first_ranges(long: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """For each wanted position: the range (low, high) it lies in, and its place among the values of the range."""
    digit = f"IF(value = 0, 0, CAST(signum(value) * (floor(log2(abs(value)) * {OCTAVE}) + {1200 * OCTAVE}) AS BIGINT))"
    spots = [{"prob": number(p), "upper": str(bool(end)), "spot": f"CAST({('floor', 'ceil')[end]}({number(p)} * (n - 1)) AS BIGINT)", "n": "n", "many": "many",
              "before": "upto - many", "low": "least", "high": "most"} for p in probs for end in (0, 1)]
    found = unpivot(_counted(long, keys, digit), spots, keep=keys).filter("spot >= before AND spot < before + many")
    return found.selectExpr(*map(name, keys), "prob", "upper", "n", "spot - before AS spot", "many", "low", "high")


def _narrowed(long: DataFrame, ranges: DataFrame, keys: list[str], held: bool) -> DataFrame:
    """The ranges after one more digit; ranges of one value stay.  ``held`` ranges are few: they travel to the rows."""
    open_, closed = ranges.filter("low < high"), ranges.filter("low = high")
    wanted = open_.select(*keys, "low", "high", "many").distinct()
    same = " AND ".join(f"l.{name(k)} <=> r.{name(k)}" for k in keys)
    if held:
        wanted = F.broadcast(wanted)
    rows = long.alias("l").join(wanted.alias("r"), F.expr(f"{same} AND value >= low AND value <= high")).selectExpr(*[f"l.{name(k)}" for k in keys], "low", "high", "many AS held", "value")
    digit = f"IF(held <= {STEPS}, value, floor((value - low) / (high - low) * {STEPS - 1}))"
    counts = _counted(rows, [*keys, "low", "high"], digit).drop("n")
    met = open_.alias("l").join(counts.alias("r"), F.expr(f"{same} AND l.low = r.low AND l.high = r.high AND spot >= upto - r.many AND spot < upto"))
    return closed.union(met.selectExpr(*[f"l.{name(k)}" for k in keys], "prob", "upper", "l.n", "spot - (upto - r.many) AS spot", "r.many", "least AS low", "most AS high"))


def _settled(ranges: DataFrame) -> tuple[DataFrame, bool, bool]:
    """The ranges as a table that is not computed again, whether any is still open, and whether the driver held them."""
    rows = ranges.limit(HELD + 1).collect()
    if len(rows) <= HELD:
        return ranges.sparkSession.createDataFrame(rows, ranges.schema), any(r["low"] < r["high"] for r in rows), True
    kept = session.stored(ranges)
    return kept, not kept.filter("low < high").isEmpty(), False


def quantiles_long(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys..., prob, n, quantile) for a long table with a finite, non-null ``value``."""
    keys = list(keys)

    ranges, open_, held = _settled(_first_ranges(long, keys, probs))
    while open_:
        ranges, open_, held = _settled(_narrowed(long, ranges, keys, held))
    ends = agg(ranges, {"n": "first(n)", "below": "max(IF(upper, NULL, low))", "above": "max(IF(upper, low, NULL))"}, [*keys, "prob"])
    part = "(prob * (n - 1) - floor(prob * (n - 1)))"
    return ends.selectExpr(*map(name, keys), "prob", "n", f"below + (above - below) * {part} AS quantile")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, prob, n, quantile) for every column; columns without values give no row."""
    return quantiles_long(melt(df, columns, by), [*by, "feature"], probs)


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """The same on the driver: columns x probs numbers, a size fixed by the call."""
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    if columns:
        for row in quantiles(df, columns, probs).collect():
            out[row["feature"]][row["prob"]] = row["quantile"]
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., feature) with one column per named quantile."""
    long = quantiles(df, columns, list(named.values()), by)
    return agg(long, {n: f"max(IF(prob = {number(p)}, quantile, NULL))" for n, p in named.items()}, [*by, "feature"])
