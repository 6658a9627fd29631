"""Ordered operations within a group whose size is not bounded.

A window partitioned by the group key alone puts a whole group into one task. These
helpers cut each group into ranges of its order column, work inside every (key, range)
and stitch the ranges together through one small row per range. The rows are shuffled
once, by (key, range), so a group with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = "_range"
RANGE_WIDTH = 4096


def _ranged(seq: str, width: int) -> Column:
    return F.floor(F.col(seq) / F.lit(width))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join in which NULL keys meet each other; the keys come from the left side."""
    right = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_right"))
    return left.join(right, same, how).drop(*(f"_{k}_right" for k in keys))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, width: int = RANGE_WIDTH) -> DataFrame:
    """1-based position of each row in its group. `order[0]` must be numeric; it sets the range."""
    df = df.withColumn(RANGE, _ranged(order[0], width))
    local = Window.partitionBy(*keys, RANGE).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, RANGE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        null_safe_join(df.withColumn("_local", F.row_number().over(local)), starts, [*keys, RANGE])
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("bigint"))
        .drop(RANGE, "_local", "_start")
    )


def with_previous(df: DataFrame, keys: list[str], seq: str, name: str, width: int = RANGE_WIDTH) -> DataFrame:
    """(keys, seq, previous seq of the same group). Only keys and sequence numbers are shuffled."""
    ids = df.select(*keys, seq).withColumn(RANGE, _ranged(seq, width))
    inside = Window.partitionBy(*keys, RANGE).orderBy(seq)
    across = Window.partitionBy(*keys).orderBy(RANGE)
    ends = (
        ids.groupBy(*keys, RANGE)
        .agg(F.max(seq).alias("_last"))
        .withColumn("_before", F.lag("_last").over(across))
        .drop("_last")
    )
    return (
        null_safe_join(ids.withColumn("_lag", F.lag(seq).over(inside)), ends, [*keys, RANGE])
        .select(*keys, seq, F.coalesce("_lag", "_before").alias(name))
    )


def with_latest_set(
    df: DataFrame, keys: list[str], seq: str, is_set: Column, name: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """(keys, seq, latest seq up to and including this one where `is_set` holds)."""
    ids = df.select(*keys, seq, F.when(is_set, F.col(seq)).alias("_set")).withColumn(RANGE, _ranged(seq, width))
    inside = Window.partitionBy(*keys, RANGE).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ids.groupBy(*keys, RANGE)
        .agg(F.max("_set").alias("_last"))
        .withColumn("_before", F.max("_last").over(before))
        .drop("_last")
    )
    return (
        null_safe_join(ids.withColumn("_here", F.max("_set").over(inside)), ends, [*keys, RANGE])
        .select(*keys, seq, F.coalesce("_here", "_before").alias(name))
    )


def smallest_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps at most n rows per key in each map task
    before the shuffle (window group limit), so the size of a group does not matter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
