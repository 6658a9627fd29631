"""Counted calls that are stored and merged, and price tables of any size."""

import random

import pytest

from pyspark.sql import functions as F

from gradeloom.functions import fixed_values as fv
from gradeloom.operators import perf

CALLS = "run_id string, day int, test_seq long, latency_seconds double, model_id string, input_tokens long, output_tokens long, response_words long, estimated_cost_usd double"


def calls_of(spark, n=400):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.randrange(5), k, r.choice([0.0, -1.0, None, 0.005, 0.015, r.random() * 3, 2.5]), r.choice(["m", "n", None]), k % 7, k % 5, k % 3, k / 997) for k in range(n)]
    return spark.createDataFrame(rows, CALLS)


@pytest.mark.parametrize("by", [[], ["run_id"], ["day"], ["run_id", "day"]])
def test_merged_counts_equal_the_calls(spark, by, tmp_path):
    calls = calls_of(spark)
    for part in range(3):  # stored in three appends that share runs and days
        perf.call_counts(calls.filter(F.col("test_seq") % 3 == part), ("run_id", "day")).write.mode("append").parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    once = perf.merged_counts(perf.merged_counts(stored, ["run_id", "day"]), by)
    want = sorted(map(tuple, perf.perf_summary(calls, by).collect()), key=repr)
    assert sorted(map(tuple, perf.perf_from_counts(once, by).collect()), key=repr) == want
    assert perf.perf_from_counts(perf.merged_counts(stored.limit(0), ["run_id"]), ["run_id"]).count() == 0


def priced_rows(df):
    return sorted((r.test, r.price_key, r.estimated_cost_usd) for r in df.collect())


@pytest.mark.parametrize("mode", ["longest", "first"])
def test_a_table_of_prices_matches_like_the_constant(spark, mode):
    keys = [row[0] for row in fv.COST_TABLE]
    names = [None, "", "none of them", *keys, *(f"Vendor/{k.upper()}-2024" for k in keys), *(f"{a}|{b}" for a, b in zip(keys, reversed(keys)))]
    calls = spark.createDataFrame([(k, m, k, 2 * k) for k, m in enumerate(names)], "test long, model_id string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([(k, *map(float, row), ) for k, (key, *row) in enumerate(fv.COST_TABLE) for k in [k]], "seq long, input_per_million double, output_per_million double")
    prices = prices.join(spark.createDataFrame(list(enumerate(keys)), "seq long, model_key string"), "seq")
    unused = spark.range(100_000).select((F.col("id") + 1000).alias("seq"), F.lit(1.0).alias("input_per_million"), F.lit(2.0).alias("output_per_million"), F.concat(F.lit("key-"), "id").alias("model_key"))
    got = perf.priced_by(calls, prices.union(unused.select(prices.columns)), mode)
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert priced_rows(got) == priced_rows(perf.priced(calls, mode))


def test_prices_with_ties_and_nulls(spark):
    prices = spark.createDataFrame([("ab", 2.0, 0.0), ("ab", 1.0, 0.0), ("bc", 5.0, 0.0), (None, 9.0, 0.0), ("", 7.0, 0.0)], "model_key string, input_per_million double, output_per_million double")
    models = spark.createDataFrame([("xABCx",), ("q",), (None,)], "model_id string")
    got = {r.model_id: (r.price_key, r.input_per_million) for r in perf.match_prices(models, prices).collect()}
    assert got == {"xABCx": ("ab", 1.0), "q": ("", 7.0)}
    assert perf.match_prices(models, prices.limit(0)).count() == 0
    with pytest.raises(ValueError):
        perf.match_prices(models, prices, "first")
