"""Exact duplicates, and duplicates once the surrogate key is ignored.

Rows are grouped by a 128-bit hash of their payload (two 64-bit hashes with
different seeds; of 10^12 rows two different ones meet with probability 10^-15),
so that only hashes and keys are shuffled, and a payload repeated by a third of all
rows is one row a task.  The few groups with copies are written and joined back
to the rows: as a broadcast if they are small, which leaves the rows where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens import vocabulary as v
from ledgerlens.functions.scalars import name
from ledgerlens.functions.tables import side_by_side

ONE, TWO = "__hash_1", "__hash_2"


def payload(df: DataFrame, key: str = v.ID) -> list[str]:
    return [c for c in df.columns if c != key]


def hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the two hashes of ``columns``; nulls, zeros of both signs and NaN count as in a grouping."""
    parts = ", ".join(f"{name(c)}, isnull({name(c)})" for c in columns) or "0"
    return df.selectExpr("*", f"xxhash64({parts}) AS {ONE}", f"xxhash64('second', {parts}) AS {TWO}")


def repeated_groups(df: DataFrame, columns: list[str], key: str = v.ID) -> DataFrame:
    """One row per payload that occurs more than once: its hashes, ``copies`` and the first key; written once."""
    first = F.min(key) if key in df.columns else F.lit(None)
    groups = hashed(df, columns).groupBy(ONE, TWO).agg(F.count("*").alias("__copies"), first.alias("__first_key"))
    return session.stored(groups.filter("__copies > 1"))


def _with_groups(df: DataFrame, columns: list[str], key: str = v.ID) -> DataFrame:
    return hashed(df, columns).join(repeated_groups(df, columns, key), [ONE, TWO], "left")


def drop_exact(df: DataFrame) -> DataFrame:
    """Only rows that have copies are shuffled."""
    rows = _with_groups(df, df.columns)
    kept = rows.filter("__copies IS NULL").unionByName(rows.filter("__copies IS NOT NULL").dropDuplicates([ONE, TWO]))
    return kept.select(*df.columns)


def drop_ignoring_key(df: DataFrame, key: str = v.ID) -> DataFrame:
    """Keeps the smallest key of every payload."""
    rows = _with_groups(df, payload(df, key), key)
    first = rows.filter(f"__copies IS NOT NULL AND {name(key)} <=> __first_key").dropDuplicates([ONE, TWO])
    return rows.filter("__copies IS NULL").unionByName(first).select(*df.columns)


def flag_ignoring_key(df: DataFrame, key: str = v.ID, flag: str = "is_duplicate_excluding_id") -> DataFrame:
    """Marks every member of a repeated payload, the first one included.

    The flag is a subquery and no join, so that a scan that does not read it neither
    hashes the payloads nor looks them up.
    """
    groups = repeated_groups(df, payload(df, key), key)
    same = (F.col(ONE) == F.col(f"rows.{ONE}").outer()) & (F.col(TWO) == F.col(f"rows.{TWO}").outer())
    return hashed(df, payload(df, key)).alias("rows").select(*[F.col(name(c)) for c in df.columns], groups.filter(same).exists().alias(flag))


def duplicate_counts(df: DataFrame, key: str = v.ID) -> DataFrame:
    """One row: exact repeats, repeats without the key, repeated keys (extra rows in each case).

    One scan hashes the payloads and groups by (payload hash, key), then by payload hash; another counts the bare keys.
    """
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    rows = F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    if key not in df.columns or len(df.columns) < 2:
        exact = hashed(df, df.columns).groupBy(ONE, TWO).agg(F.count("*").alias("n")).agg(rows, extra.alias("exact_duplicates"))
        return exact.select(
            "rows", "exact_duplicates", F.col("exact_duplicates").alias("duplicates_without_id"),
            F.lit(0).cast("long").alias("repeated_ids"), F.lit(0).cast("long").alias("rows_in_duplicate_groups"),
        )
    base = hashed(df, payload(df, key)).groupBy(ONE, TWO, F.col(key).alias("key")).agg(F.count("*").alias("n"))
    same = base.groupBy(ONE, TWO).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("exact"))
    payloads = same.agg(rows, F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_duplicates"), extra.alias("duplicates_without_id"),
                        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"))
    ids = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).agg(extra.alias("repeated_ids"))
    return side_by_side(payloads, ids).select(
        "rows", "exact_duplicates", "duplicates_without_id", "repeated_ids", "rows_in_duplicate_groups"
    )


def duplicate_examples(df: DataFrame, limit: int = 5, key: str = v.ID) -> DataFrame:
    """The first rows (by key) that repeat an earlier payload."""
    later = _with_groups(df, payload(df, key), key).filter(f"{name(key)} > __first_key")
    return later.selectExpr(name(key), "__first_key AS first_key").orderBy(key).limit(limit)
