"""Tables of rows that belong to a key, such as a run: written again, they replace themselves.

The table is partitioned by a hash of the key (below another column, if wished). A write reads the
partitions that its keys fall into, leaves out what the table has of these keys, and overwrites these
partitions only. So a repeated append changes nothing, and there are no more files than partitions,
but for those that are cut by size. A partition is exchanged by a delete and a rename; if a job dies just then,
repeat it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.spread import null_safe_join, smallest_n
from ..session import shared_dir

BUCKET = "key_bucket"
BUCKETS = 16


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its partition column; None if it is not there yet."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).drop(BUCKET)


def rows_of(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of the wanted keys. Only the partitions they fall into are read: their numbers, at most `buckets`, are a filter of the scan."""
    wanted = wanted.select(*keys).distinct()
    numbers = numbers_of(wanted.select(bucket_of(keys, buckets).alias(BUCKET)))
    rows = spark.read.option("mergeSchema", "true").parquet(path).filter(F.col(BUCKET).isin(numbers))
    return null_safe_join(rows, wanted, keys, "left_semi").drop(BUCKET)


def numbers_of(rows: DataFrame) -> list[int]:
    """The bucket numbers that occur."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def put_rows(
    rows: DataFrame, path: str, keys: list[str], partition_by: str | None = None, newest: list[Column | str] | None = None, buckets: int = BUCKETS,
    gone: DataFrame | None = None,
) -> None:
    """All rows of each key take the place of those in the table. With `newest`, an order, only the first row of each key stays,
    be it a new or a stored one. A null key is a key like others; columns that one side lacks are null there.

    The rows of the keys in `gone` leave the table, too. The number of buckets belongs to the table: use the same for each write.
    """
    if gone is not None and (partition_by or newest):
        raise ValueError("keys can go from tables without a further partition column or order only")
    spark = rows.sparkSession
    parts = [*([partition_by] if partition_by else []), BUCKET]
    same = [*([partition_by] if partition_by else []), *keys]
    new, before = rows.withColumn(BUCKET, bucket_of(keys, buckets)), stored(spark, path)
    if before is not None:
        folder = shared_dir(spark, "put")
        new.write.parquet(f"{folder}/new")  # read more than once below
        new = spark.read.parquet(f"{folder}/new")
        replaced = new.select(*same, BUCKET)
        if gone is not None:
            replaced = replaced.union(gone.select(*same, bucket_of(keys, buckets).alias(BUCKET)))
        numbers = numbers_of(replaced)
        before = before.filter(F.col(BUCKET).isin(numbers))
        if newest is None:
            before = null_safe_join(before, replaced.select(*same).distinct(), same, "left_anti")
        new = new.unionByName(before, allowMissingColumns=True)
    if newest is not None:
        new = smallest_n(new, same, newest, 1).drop("rank")
    # An empty partition is not overwritten.
    empty = set(numbers) - set(numbers_of(new)) if before is not None and gone is not None else ()
    # Spark writes beside the table and exchanges the partitions at the end, so they may be read until then.
    new.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for number in empty:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={number}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
