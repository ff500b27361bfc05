"""Helpers that several of the operators share: written tables, let-bindings, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import use_checkpoint_dir

# Fixed value: the white space of every word contract (space and U+0009 to U+000D).
SPACE = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran and not the steps
    before, and two readers see the same rows.  Empty tables keep their schema.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table_written(df: DataFrame, *by: str) -> DataFrame:
    """As :func:`written`, in compact files with a folder for each value of ``by``; reads of one value leave out the rest."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def steady(df: DataFrame) -> DataFrame:
    """``df`` itself if every run reads its rows in one order, else a written copy.

    Operators that read their input twice know a row by its place in the
    partitions.  Scans and row-wise steps keep that place; what comes out of a
    shuffle, a limit or a Python step may come in another order the next time.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    steps = re.findall(r"^[\s:+*()\d-]*([A-Za-z]+)", plan, re.M)
    row_wise = {"Scan", "FileScan", "BatchScan", "LocalTableScan", "Range", "Project", "Filter", "ColumnarToRow", "WholeStageCodegen", "InputAdapter", "Union", "Generate", "Coalesce"}
    return df if row_wise.issuperset(steps) else written(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the smallest node.

    Large-star and small-star steps by turns.  Every step is a grouped minimum
    (combined before the shuffle) and a join on the node, so a node with a
    third of all edges is one group to aggregate and a join that adaptive
    execution may split.  Nothing is collected but two numbers a turn.
    Loops and repeated edges do no harm; nodes without an edge are not listed;
    an edge with a null end is dropped.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
