"""Live progress of runs from the stream of finished calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import batches


def run_progress(calls: DataFrame, delay: str = "1 hour", keys=("run_id", "test_id"), at: str = "started_at") -> DataFrame:
    """Distinct tests done per run and the latest one. A repeated call within the delay counts
    once; state is kept for the keys seen within the delay and one row per run."""
    return (
        calls.withColumn("_at", F.col(at).cast("timestamp"))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(list(keys))
        .groupBy(keys[0])
        .agg(
            F.count(F.lit(1)).alias("done"),
            F.max(F.struct("_at", F.col(keys[1])))[keys[1]].alias("last_test"),
            F.max("_at").alias("last_at"),
        )
    )


def write_progress(progress: DataFrame, table: str, checkpoint: str, available_now: bool = False, by: str = "run_id",
                   merge_every: int = batches.MERGE_EVERY):
    """Write every update to the folder of its batch; `latest_progress` reads the current state. A
    batch that is written twice after a failure leaves the same state; older folders are merged."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batches.write_batch(batch, batch_id, table, lambda rows: latest_progress(rows, by=by), merge_every)

    writer = progress.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_progress(updates: DataFrame, totals: DataFrame | None = None, by: str = "run_id") -> DataFrame:
    """Newest state of each run; with totals (run, total) also its status. Updates of `tracked_runs` bring theirs with them."""
    columns = [c for c in updates.columns if c not in (by, batches.COLUMN)]
    newest = updates.groupBy(by).agg(F.max_by(F.struct(*columns), batches.COLUMN).alias("_n"))
    state = newest.select(by, *[F.col(f"_n.{c}").alias(c) for c in columns])
    if totals is None:
        return state
    return (
        totals.join(state, by, "left")
        .withColumn("done", F.coalesce("done", F.lit(0)))
        .withColumn("status", F.when(F.col("done") >= F.col("total"), "done").otherwise("running"))
    )


def batch_progress(calls: DataFrame, keys=("run_id", "test_id"), at: str = "started_at") -> DataFrame:
    """The same counts from the stored calls; picks up calls that came after the watermark."""
    first = calls.groupBy(*keys).agg(F.min(at).alias("_at"))
    return first.groupBy(keys[0]).agg(
        F.count(F.lit(1)).alias("done"),
        F.max(F.struct("_at", F.col(keys[1])))[keys[1]].alias("last_test"),
    )
