"""Small-table shaping shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import name


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Joins one-row aggregates into one row (each side is a single row by construction)."""
    keyed = [r.withColumn("__one", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__one"), keyed).drop("__one")


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate on every row."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def agg(df: DataFrame, exprs: dict[str, str], by=()) -> DataFrame:
    """Aggregation from SQL text."""
    columns = [F.expr(e).alias(n) for n, e in exprs.items()]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def unpivot(row: DataFrame, entries: list[dict[str, str]], keep=()) -> DataFrame:
    """One output row per entry (name -> SQL text) for every input row."""
    structs = ", ".join("struct(" + ", ".join(f"{e} AS {name(n)}" for n, e in entry.items()) + ")" for entry in entries)
    return row.selectExpr(*[name(k) for k in keep], f"inline(array({structs}))")
