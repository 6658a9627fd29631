"""Tables that a stream writes batch by batch, a folder each, merged from time to time.

A batch overwrites its own folder, so a batch that Spark repeats after a failure changes nothing. Every
`merge_every` batches the folders before the current one, which Spark never repeats, become one
with a row for each key. It appears under a name of its own (the batch number with leading zeros)
before the others go: readers see every row at least once, and take the newest of each key.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MERGE_EVERY = 16
COLUMN = "batch_id"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, table: str) -> dict[str, int]:
    """Folder name -> batch number."""
    store, where = _store(spark, table)
    if not store.exists(where):
        return {}
    names = [f.getPath().getName() for f in store.listStatus(where) if f.isDirectory()]
    return {n: int(n.split("=")[1]) for n in names if re.fullmatch(COLUMN + r"=\d+", n)}


def read_batches(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """All rows with their batch number (of merged ones, the last that went into them)."""
    found = [f"{table}/{n}" for n, k in folders(spark, table).items() if upto is None or k <= upto]
    if not found:
        raise FileNotFoundError(f"no batches in {table}")
    return spark.read.option("basePath", table).parquet(*found)


def merge(spark: SparkSession, table: str, upto: int, newest: Callable[[DataFrame], DataFrame]) -> None:
    """The folders of all batches up to `upto` become one. `newest` leaves a row for each key."""
    old = {n: k for n, k in folders(spark, table).items() if k <= upto}
    if len(old) < 2:
        return
    made = f"{table}/_{uuid.uuid4().hex}"
    newest(read_batches(spark, table, upto)).drop(COLUMN).write.parquet(made)
    last, zeros = max(old.values()), "0"
    while f"{COLUMN}={zeros}{last}" in old:  # a merge that broke off before the others went
        zeros += "0"
    merged = f"{COLUMN}={zeros}{last}"
    store, _ = _store(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not store.rename(path(made), path(f"{table}/{merged}")):
        raise OSError(f"could not rename {made}")
    for name in old:
        store.delete(path(f"{table}/{name}"), True)


def write_batch(batch: DataFrame, batch_id: int, table: str, newest: Callable[[DataFrame], DataFrame], merge_every: int = MERGE_EVERY) -> None:
    """Body of a `foreachBatch`."""
    batch.write.mode("overwrite").parquet(f"{table}/{COLUMN}={batch_id}")
    if batch_id and batch_id % merge_every == 0:
        merge(batch.sparkSession, table, batch_id - 1, newest)
