"""A client table in the canonical 25-column layout, derived from a star schema.

Years of ``o_orderdate`` act as the panel months (2000 is month 1, 1995 is
month 6) and 2001 gives the outcome.  Line items are reduced to one row per
order before the join, so the join and everything after it moves order-sized
data, and a client with a very large share of the orders is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import session

OUTCOME_YEAR = 2001
MONTHS = (1, 2, 3, 4, 5, 6)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    session.compiled(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clients(spark: SparkSession, folder: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    # lines that are neither paid for nor returned add nothing to an order
    lines = table(spark, folder, "lineitem").filter("l_returnflag IN ('N', 'R')").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(F.col("l_returnflag") == "N", net)).alias("paid"),
        F.count_if(returned).alias("returned"),
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("period")
    )
    months = []
    for k in MONTHS:
        in_month = F.col("period") == OUTCOME_YEAR - k
        months += [
            F.sum(F.when(in_month, F.col("o_totalprice"))).alias(f"bill_amt_m{k}"),
            F.coalesce(F.sum(F.when(in_month, F.col("paid"))), F.lit(0.0)).alias(f"pay_amt_m{k}"),
            F.sum(F.when(in_month, F.coalesce("returned", F.lit(0)))).alias(f"returned_m{k}"),
        ]
    due = (F.col("period") == OUTCOME_YEAR) & (F.col("o_orderstatus") == "P")
    activity = (
        orders.join(lines, "o_orderkey", "left")
        .groupBy("o_custkey")
        .agg(*months, F.max(F.coalesce(due, F.lit(False)).cast("int")).alias("due"))
    )
    customers = table(spark, folder, "customer")
    key = F.col("c_custkey")
    return customers.join(activity, key == F.col("o_custkey"), "left").select(
        key.cast("long").alias("client_id"),
        F.round(F.col("c_acctbal") * 100, 0).alias("credit_limit"),
        (1 + key % 2).cast("int").alias("sex_code"),
        (F.col("c_nationkey") % 7).cast("int").alias("education_code"),
        (F.col("c_nationkey") % 4).cast("int").alias("marriage_code"),
        (21 + (key * 7) % 59).cast("int").alias("age"),
        *[
            F.least(F.lit(9), F.coalesce(F.col(f"returned_m{k}"), F.lit(0)) - 2).cast("int").alias(f"pay_status_m{k}")
            for k in MONTHS
        ],
        *[F.col(f"bill_amt_m{k}") for k in MONTHS],
        *[F.coalesce(F.col(f"pay_amt_m{k}"), F.lit(0.0)).alias(f"pay_amt_m{k}") for k in MONTHS],
        F.coalesce("due", F.lit(0)).cast("int").alias("default_next_month"),
    )


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, folder: str, stage: str, build) -> DataFrame:
    """One shared copy per session of a stage that many queries start from."""
    key = (spark.sparkContext.applicationId, folder, stage)
    if key not in _KEPT:
        _KEPT[key] = session.reuse(build())
    return _KEPT[key]


def forget(spark: SparkSession) -> None:
    """Release the shared copies and everything else this session keeps in executor storage."""
    _KEPT.clear()
    spark.catalog.clearCache()
