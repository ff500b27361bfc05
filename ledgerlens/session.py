"""Session helpers: where to checkpoint, and how a result is pinned or reused."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point the session at the shared folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, because there every task sees it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a later step must see exactly the partitions computed now.
    """
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Unlike :func:`pin` the optimizer then knows its size, and broadcasts it if small.
    """
    use_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def compiled(spark: SparkSession) -> None:
    """Let Spark split generated code that the JVM would only interpret (unless the session sets its own limit).

    HotSpot never compiles a method of more than 8,000 bytes, and one stage over the 80
    columns of the feature table is such a method.  Beyond the limit Spark takes the
    projections one by one, in short methods.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit, "65535")) == 65_535:
        spark.conf.set(limit, "8000")


def fitted(spark: SparkSession) -> None:
    """Let a kept table have as many partitions as its size asks for (unless the session says otherwise).

    Left alone, Spark keeps it in all shuffle partitions, however small, and every
    grouping of it then writes partitions x partitions files.
    """
    change = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    if change not in spark.conf.getAll:
        spark.conf.set(change, "true")


def reuse(df: DataFrame) -> DataFrame:
    """Keep a DataFrame that several actions read; lost blocks are recomputed."""
    compiled(df.sparkSession)
    fitted(df.sparkSession)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects for ``df`` (no job runs); joins are over-estimated."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
