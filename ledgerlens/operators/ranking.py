"""Running totals and average ranks over data too large for one sorted task.

A window without a selective partition key sorts everything in one task.  Here
the rows are range-partitioned by Spark's own range partitioner, each slice
keeps its own running total, and the totals of the earlier slices are added as
an offset.  The slices are pinned (checkpointed) so both steps see the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import session

SMALL_BYTES = 32 << 20
BROADCAST_ROWS = 200_000


def running_before(df: DataFrame, keys: Sequence[str], order: str, totals: Sequence[str],
                   small: bool | None = None) -> DataFrame:
    """Adds ``<total>_before``: the sum over rows of the same keys with a smaller ``order``.

    ``(keys, order)`` must be unique; aggregate first, which also folds hot values.
    """
    keys = list(keys)
    if small is None:
        small = session.planned_bytes(df) <= SMALL_BYTES
    if small:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(t).over(window), F.lit(0)).alias(f"{t}_before") for t in totals])

    cut = session.pin(df.repartitionByRange(*keys, order).withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = cut.groupBy(*keys, "slice").agg(*[F.sum(t).alias(t) for t in totals])
    offsets = per_slice.select(
        *keys, "slice", *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{t}_offset") for t in totals]
    )
    local = cut.select("*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"{t}_local") for t in totals])
    both = local.join(offsets, [*keys, "slice"])
    return both.select(
        *df.columns, *[(F.col(f"{t}_local") + F.col(f"{t}_offset")).alias(f"{t}_before") for t in totals]
    )


def value_ranks(counts: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """Average rank of every distinct ``value`` within ``keys``.

    ``counts`` holds one row per (keys, value) with its frequency in ``rows``.
    Tied rows share the mean of the positions they occupy.
    """
    before = running_before(counts, keys, "value", ["rows"], small)
    return before.withColumn("rank", F.col("rows_before") + (F.col("rows") + 1) / 2.0).drop("rows_before")


def attach_ranks(long: DataFrame, keys: Sequence[str], hot_share: float = 0.001) -> DataFrame:
    """``long`` (…, keys, value) with the average ``rank`` of each row's value.

    Values that hold more than ``hot_share`` of their key's rows (at most
    ``1 / hot_share`` per key, so a bounded table) are looked up in a broadcast;
    the remaining values, none of which is frequent, meet in a shuffle join.
    """
    keys = list(keys)
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("rows"))
    ranks = session.reuse(value_ranks(counts, keys))
    if ranks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return long.join(F.broadcast(ranks.drop("rows")), [*keys, "value"])
    totals = counts.groupBy(*keys).agg(F.sum("rows").alias("total"))
    hot = (
        ranks.join(F.broadcast(totals), keys)
        .filter(F.col("rows") > hot_share * F.col("total"))
        .select(*keys, "value", F.col("rank").alias("hot_rank"))
    )
    marked = long.join(F.broadcast(hot), [*keys, "value"], "left")
    fast = marked.filter(F.col("hot_rank").isNotNull()).withColumnRenamed("hot_rank", "rank")
    slow = marked.filter(F.col("hot_rank").isNull()).drop("hot_rank").join(ranks.drop("rows"), [*keys, "value"])
    return fast.unionByName(slow)
