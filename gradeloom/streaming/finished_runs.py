"""Finished runs appended to the history as they arrive."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from ..operators.spread import smallest_n
from . import batches


def _newest(rows: DataFrame, key: str, finished: str) -> DataFrame:
    """One row per run: the one that finished last; where rows tell no time, that of the first batch."""
    values = [c for c in rows.columns if c not in (key, batches.COLUMN)]
    if finished in values:
        chosen = F.max(F.struct(F.col(finished).alias("_t"), batches.COLUMN, *values))
    else:
        chosen = F.min(F.struct(batches.COLUMN, *values))
    return rows.groupBy(key).agg(chosen.alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in values])


def append_history_stream(runs: DataFrame, table: str, checkpoint: str, key: str = "run_id", available_now: bool = False,
                          finished: str = "timestamp", merge_every: int = batches.MERGE_EVERY):
    """Each micro-batch is written to its own folder in overwrite mode, so a batch that
    Spark repeats after a failure replaces its rows instead of adding them again. Of several
    rows of one run in a batch the one that finished last is kept; where they tell no time, the
    same one each time. Every `merge_every` batches the older folders become one."""

    def save(batch: DataFrame, batch_id: int) -> None:
        newest = [F.desc_nulls_last(finished)] if finished in batch.columns else []
        kept = smallest_n(batch, [key], [*newest, F.xxhash64(*batch.columns)], 1).drop("rank")
        batches.write_batch(kept, batch_id, table, partial(_newest, key=key, finished=finished), merge_every)

    writer = runs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_history_stream(spark, table: str, key: str = "run_id", finished: str = "timestamp") -> DataFrame:
    return _newest(batches.read_batches(spark, table), key, finished)
