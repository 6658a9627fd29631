"""Several repeats of one suite averaged into a single run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import SAFETY_LIMIT
from ..functions.numeric import col, exact_avg, exact_sum, half_up, half_up_wide, mean_of_units, units
from .safety import is_measured

# Columns that are taken from the last repeat where a table has them.
LAST_CRITERION = ("text", "explanation", "dag_dimensions", "test_seq")
LAST_SAFETY = ("reason",)
LAST_CALL = ("question", "response", "input_tokens", "output_tokens", "total_tokens", "response_words",
             "estimated_cost_usd", "model_id", "test_seq")


def _last(df: DataFrame, columns, repeat: str):
    """The named columns of the last repeat: (names, aggregates, output columns)."""
    present = [c for c in columns if c in df.columns]
    picked = [F.max_by(F.struct(*present), repeat).alias("_last")] if present else []
    return picked, [F.col(f"_last.{c}").alias(c) for c in present]


def average_criteria(criteria: DataFrame, repeat: str = "repeat", keys=("run_id", "test_id", "criterion_seq")) -> DataFrame:
    """Mean score and mean non-null dag score of each criterion, texts from the last repeat."""
    last, columns = _last(criteria, LAST_CRITERION, repeat)
    return (
        criteria.groupBy(*keys)
        .agg(
            half_up(mean_of_units(F.sum(units("score")), F.count("score")), 2).alias("score"),
            half_up(mean_of_units(F.sum(units("dag_score")), F.count("dag_score")), 2).alias("dag_score"),
            *last,
        )
        .select(*keys, "score", "dag_score", *columns)
    )


def average_safety(safety: DataFrame, repeat: str = "repeat", keys=("run_id", "test_id", "metric")) -> DataFrame:
    """Mean safety score over the repeats that ran; passed again decided on the mean."""
    measured = F.when(is_measured(), F.col("score"))
    avg = half_up(exact_avg(measured), 2)
    last, columns = _last(safety, LAST_SAFETY, repeat)
    return (
        safety.groupBy(*keys)
        .agg(avg.alias("score"), F.coalesce(avg <= SAFETY_LIMIT, F.lit(False)).alias("passed"), *last)
        .select(*keys, "score", "passed", *columns)
    )


def average_calls(calls: DataFrame, repeat: str = "repeat", keys=("run_id", "test_id")) -> DataFrame:
    """Mean latency; text, tokens and cost of the last repeat."""
    last, columns = _last(calls, [c for c in LAST_CALL if c not in (*keys, repeat)], repeat)
    return (
        calls.groupBy(*keys)
        .agg(half_up(exact_avg("latency_seconds"), 2).alias("latency_seconds"), *last)
        .select(*keys, "latency_seconds", *columns)
    )


def average_runs(repeats: DataFrame, repeat: str = "repeat", by=("run_id",)) -> DataFrame:
    """One row per repeat (prompt_version, total_elapsed) to one row per run: elapsed time is
    summed and the version says how many repeats it stands for."""
    return (
        repeats.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("num_repeats"),
            half_up_wide(exact_sum("total_elapsed"), 2).alias("total_elapsed"),
            F.max(F.struct(col(repeat), col("prompt_version")))["prompt_version"].alias("_version"),
        )
        .select(
            *by, "num_repeats", "total_elapsed",
            F.when(F.col("num_repeats") > 1,
                   F.concat("_version", F.lit(" (avg of "), F.col("num_repeats").cast("string"), F.lit(" runs)")))
            .otherwise(F.col("_version")).alias("prompt_version"),
        )
    )
