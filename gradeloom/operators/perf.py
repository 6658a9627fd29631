"""Latency, token and cost statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..functions.numeric import half_up, half_up_wide
from .spread import smallest_n


#: Columns of counted calls besides the keys.
COUNTS = ("_bin", "model_id", "_n", "_latency", "_in", "_out", "_words", "_cost", "_first")


def call_counts(calls: DataFrame, by) -> DataFrame:
    """Calls counted per key, latency rounded to hundredths, and model: all that the figures below need.

    Reported latencies have two decimals and rounding keeps their order, so the ranked
    value of the rounded latencies is the rounded ranked value. A run of any size becomes
    at most as many rows as it has distinct hundredths and models, mostly already before
    the shuffle. The model is a key because a text among the aggregates would make Spark
    sort all calls.

    Counts can be stored, by day for instance, and put together for any coarser key by `merged_counts`.
    """
    latency = F.col("latency_seconds")
    words = F.col("response_words") if "response_words" in calls.columns else F.lit(0)
    return (
        calls.withColumn("_bin", F.when(latency > 0, half_up(latency, 2)))
        .withColumn("_words", words)
        .groupBy(*by, "_bin", "model_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(latency.cast("decimal(20,12)")).alias("_latency"),
            F.sum("input_tokens").alias("_in"),
            F.sum("output_tokens").alias("_out"),
            F.sum("_words").alias("_words"),
            F.sum(F.col("estimated_cost_usd").cast("decimal(20,12)")).alias("_cost"),
            F.min("test_seq").alias("_first"),
        )
    )


def merged_counts(counts: DataFrame, by) -> DataFrame:
    """Stored counts put together: as if the calls of all of them had been counted by these keys."""
    sums = [F.sum(c).cast(counts.schema[c].dataType).alias(c) for c in ("_n", "_latency", "_in", "_out", "_words", "_cost")]
    return counts.groupBy(*by, "_bin", "model_id").agg(*sums, F.min("_first").alias("_first"))


def perf_from_counts(counts: DataFrame, by=("run_id",)) -> DataFrame:
    """Latency over successful calls (latency > 0), totals over all calls, from counts with one row per key, hundredth and model.

    p50 is the value at 0-based rank n div 2 and p95 the one at min(n * 95 div 100, n - 1):
    nearest rank, not interpolated. `available` is false without a positive latency. The
    windows and the last aggregation share one shuffle of the counted rows.
    """
    timed = F.col("_bin").isNotNull()
    n_timed = F.when(timed, F.col("_n")).otherwise(F.lit(0))
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(F.col("_bin").asc_nulls_first(), "model_id").rowsBetween(Window.unboundedPreceding, 0)
    p50_rank = F.expr("_timed div 2")
    p95_rank = F.least(F.expr("(_timed * 95) div 100"), F.col("_timed") - 1)

    def at(rank):
        reached = F.col("_reached")
        return F.max(F.when(timed & (reached > rank) & (reached - F.col("_n") <= rank), F.col("_bin")))

    all_calls, all_timed = F.sum("_n"), F.sum(n_timed)
    return (
        counts
        .withColumn("_reached", F.sum(n_timed).over(ordered))
        .withColumn("_timed", F.sum(n_timed).over(whole))
        .groupBy(*by)
        .agg(
            (all_timed > 0).alias("available"),
            half_up(F.sum(F.when(timed, F.col("_latency"))).cast("double") / F.nullif(all_timed, F.lit(0)), 2).alias("avg_latency"),
            F.min("_bin").alias("min_latency"),
            F.max("_bin").alias("max_latency"),
            at(p50_rank).alias("p50_latency"),
            at(p95_rank).alias("p95_latency"),
            F.sum("_in").cast("bigint").alias("total_input_tokens"),
            F.sum("_out").cast("bigint").alias("total_output_tokens"),
            (F.sum("_in") + F.sum("_out")).cast("bigint").alias("total_tokens"),
            half_up(F.sum("_out").cast("double") / all_calls, 0).cast("bigint").alias("avg_output_tokens"),
            half_up(F.sum("_words").cast("double") / all_calls, 0).cast("bigint").alias("avg_response_words"),
            half_up_wide(F.sum("_cost").cast("double"), 4).alias("estimated_cost_usd"),
            F.min(F.struct("_first", "model_id"))["model_id"].alias("model_id"),
        )
    )


def perf_summary(calls: DataFrame, by=("run_id",)) -> DataFrame:
    """The same from the calls."""
    return perf_from_counts(call_counts(calls, by), by)


def latency_percentiles(calls: DataFrame, by=("run_id",)) -> DataFrame:
    """Only the nearest-rank percentiles."""
    blank = calls.select(
        *by, "latency_seconds", "test_seq", F.lit("").alias("model_id"),
        F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("estimated_cost_usd"),
    )
    return perf_summary(blank, by).filter("available").select(*by, "p50_latency", "p95_latency")


def priced(calls: DataFrame, mode: str = "longest", table: list | None = None) -> DataFrame:
    """Calls with the matched price key and their cost."""
    return calls.withColumn("price_key", text.match_price("model_id", mode, table)["model_key"]).withColumn(
        "estimated_cost_usd", text.call_cost("model_id", "input_tokens", "output_tokens", mode, table)
    )


def match_prices(models: DataFrame, prices: DataFrame, mode: str = "longest", model: str = "model_id") -> DataFrame:
    """(model, price_key, input_per_million, output_per_million) of each distinct model id that a price matches.

    As `text.match_price`, for a price table of any size: `prices` has model_key, input_per_million and
    output_per_million, and for mode `first` also seq, its order. A model id is rolled over the lengths that
    keys have, and what it holds is looked up by an equality join; the longest key counts, or the one
    with the smallest seq. Of equal keys the one with the smallest seq (without seq: the lowest prices) counts.
    """
    if mode not in ("longest", "first"):
        raise ValueError(f"unknown mode {mode!r}")
    order = ["seq"] if "seq" in prices.columns else []
    if mode == "first" and not order:
        raise ValueError("the first price needs seq")
    keys = smallest_n(prices.filter("model_key IS NOT NULL"), ["model_key"], [*order, "input_per_million", "output_per_million"], 1).drop("rank")
    lengths = [r[0] for r in keys.select(F.length("model_key")).distinct().collect()]  # no more than a key has characters
    ids = models.select(model).filter(F.col(model).isNotNull()).distinct().withColumn("_id", F.lower(model))
    held = ids.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).filter(F.length("_id") >= F.col("_length"))
    held = held.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_id") - F.col("_length") + 1)))
    held = held.select(model, F.substring("_id", F.col("_at"), F.col("_length")).alias("model_key")).distinct()
    ranks = [F.desc(F.length("model_key")), *order, "model_key"] if mode == "longest" else [*order, "model_key"]
    best = smallest_n(held.join(keys, "model_key"), [model], ranks, 1)
    return best.select(model, F.col("model_key").alias("price_key"), "input_per_million", "output_per_million")


def priced_by(calls: DataFrame, prices: DataFrame, mode: str = "longest") -> DataFrame:
    """Calls with the matched price key and their cost, from a table of prices; without a match the cost is 0."""
    matched = match_prices(calls, prices, mode)
    rate = {c: F.coalesce(c, F.lit(0.0)) for c in ("input_per_million", "output_per_million")}
    cost = (F.col("input_tokens") * rate["input_per_million"] + F.col("output_tokens") * rate["output_per_million"]) / F.lit(1000000.0)
    return calls.join(matched, "model_id", "left").withColumn("estimated_cost_usd", cost).drop(*rate)


def cost_totals(calls: DataFrame, by=("role", "model_id")) -> DataFrame:
    """Cost per role and model with subtotals. `level` tells them from keys that are NULL: 0 for a
    full key, 1 for the total of a role, 3 for all. Calls are summed per full key first, so the
    rollup expands only those few rows."""
    cost = F.col("estimated_cost_usd").cast("decimal(20,12)")
    return (
        calls.groupBy(*by)
        .agg(F.sum(cost).alias("_cost"), F.count(F.lit(1)).alias("_n"))
        .rollup(*by)
        .agg(
            half_up_wide(F.sum("_cost").cast("double"), 4).alias("total_cost"),
            F.sum("_n").cast("bigint").alias("num_calls"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )
