"""Safety verdict summaries. Rows that failed to run are excluded, never counted as safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import exact_avg, half_up, percent


def is_measured() -> Column:
    """A verdict counts when it has a score that is not the -1 sentinel."""
    return F.col("score").isNotNull() & (F.col("score") >= 0)


def _per_metric(safety: DataFrame, by) -> DataFrame:
    ok = is_measured()
    return safety.groupBy(*by, "metric").agg(
        exact_avg(F.when(ok, F.col("score"))).alias("_avg"),
        F.max(F.when(ok, F.col("score"))).alias("_max"),
        F.count(F.when(ok, F.lit(1))).alias("total_tested"),
        F.count(F.when(ok & F.col("passed"), F.lit(1))).alias("passed_count"),
    )


def safety_summary(safety: DataFrame, by=("run_id",)) -> DataFrame:
    """Per run and metric: average, maximum, pass rate and counts. `passed` is the stored
    flag: it was decided on the unrounded score."""
    return (
        _per_metric(safety, by)
        .filter(F.col("total_tested") > 0)
        .select(
            *by, "metric",
            half_up("_avg", 3).alias("avg_score"),
            half_up("_max", 3).alias("max_score"),
            percent(F.col("passed_count"), F.col("total_tested")).alias("pass_rate"),
            "total_tested", "passed_count",
            (F.col("total_tested") - F.col("passed_count")).alias("failed_count"),
        )
    )


def safety_overall(safety: DataFrame, runs: DataFrame | None = None, by=("run_id",)) -> DataFrame:
    """Mean of the rounded pass rates of the metrics, 0 when every verdict failed to run.

    With `runs`, a run without any verdict is listed as not available.
    """
    rate = percent(F.col("passed_count"), F.col("total_tested"))
    out = (
        _per_metric(safety, by)
        .groupBy(*by)
        .agg(half_up(exact_avg(rate), 1).alias("_rate"), F.lit(True).alias("available"))
        .select(*by, "available", F.coalesce("_rate", F.lit(0.0)).alias("overall_pass_rate"))
    )
    if runs is not None:
        out = runs.select(*by).join(out, list(by), "left").withColumn("available", F.coalesce("available", F.lit(False)))
    return out


def safety_all_passed(safety: DataFrame, by=("run_id",)) -> DataFrame:
    """Share of responses that passed every check that ran for them."""
    per_test = (
        safety.filter(is_measured())
        .groupBy(*by, "test_id")
        .agg(F.min(F.col("passed").cast("int")).alias("_all"))
    )
    return per_test.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses_tested"),
        F.sum("_all").cast("bigint").alias("responses_passed"),
        percent(F.sum("_all"), F.count(F.lit(1))).alias("safety_all_passed"),
    )


def safety_flagged(safety: DataFrame, responses: DataFrame, keys=("run_id", "test_id")) -> DataFrame:
    """The failed verdicts with question and response, one row each (a list per run could
    grow without bound)."""
    failed = safety.filter(is_measured() & ~F.col("passed")).select(*keys, "metric", "score", "reason")
    return failed.join(responses.select(*keys, "question", "response"), list(keys), "left")
