"""Properties that hold for any data."""

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gradeloom.operators import compare, ingest, perf, redteam, repeats, safety, scoring

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
scores = st.integers(0, 100).map(lambda n: n / 100)
rows_of = st.lists(st.tuples(st.sampled_from("rs"), st.sampled_from("abc"), scores, st.none() | scores), min_size=1, max_size=20)
SCHEMA = "run_id string, test_id string, criterion_seq int, text string, score double, dag_score double"


def _criteria(spark, rows):
    return spark.createDataFrame([(run, test, i, f"c{i}", s, d) for i, (run, test, s, d) in enumerate(rows)], SCHEMA)


def _cases(spark):
    return spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "x", 3)], "test_id string, category string, weight int")


def _all(df):
    return sorted(map(str, df.collect()))


@QUICK
@given(rows_of, st.integers(0, 99))
def test_row_order_changes_nothing(spark, rows, seed):
    shuffled = list(enumerate(rows))
    random.Random(seed).shuffle(shuffled)
    again = spark.createDataFrame([(r, t, i, f"c{i}", s, d) for i, (r, t, s, d) in shuffled], SCHEMA)

    def runs(df):
        return _all(scoring.run_scores(scoring.with_cases(scoring.test_scores(df), _cases(spark))))

    assert runs(_criteria(spark, rows)) == runs(again)


@QUICK
@given(rows_of)
def test_a_run_against_itself_has_no_delta(spark, rows):
    tests = scoring.with_cases(scoring.test_scores(_criteria(spark, rows)), _cases(spark)).withColumn("test_seq", F.lit(1)).withColumnRenamed("run_id", "pair_id")
    deltas = compare.ab_tests(compare.stack_sides(tests, tests))
    assert deltas.filter("delta <> 0 OR direction <> 'equal'").count() == 0


@QUICK
@given(rows_of, st.integers(1, 4))
def test_equal_repeats_average_to_themselves(spark, rows, n):
    one = _criteria(spark, rows)
    many = one.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(n))))
    assert _all(repeats.average_criteria(many).select("run_id", "test_id", "criterion_seq", "score", "dag_score", "text")) == _all(
        one.select("run_id", "test_id", "criterion_seq", "score", "dag_score", "text"))


@QUICK
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None])), min_size=1, max_size=12))
def test_merge_is_idempotent(spark, ids):
    schema = "role_slug string, test_seq long, test_id string, category string, question string, criteria array<string>, weight int, context array<string>"
    existing = spark.createDataFrame([("r", 1, "a", "old", "q", ["c"], 1, None)], schema)
    incoming = spark.createDataFrame([("r", i, t, c, "q", ["c"], 1, None) for i, (t, c) in enumerate(ids, 1)], schema)
    once = ingest.merge_suite(existing, incoming)
    twice = ingest.merge_suite(once.drop("added"), incoming)
    assert _all(once.drop("added")) == _all(twice.drop("added"))
    assert once.filter("test_id = 'a'").collect()[0].category == "old"


@QUICK
@given(st.lists(st.tuples(st.sampled_from(["bias", "toxicity"]), st.none() | scores, st.booleans()), min_size=1, max_size=20))
def test_safety_counts_add_up(spark, rows):
    df = spark.createDataFrame([("r", str(i), m, s, p, "") for i, (m, s, p) in enumerate(rows)],
                               "run_id string, test_id string, metric string, score double, passed boolean, reason string")
    for row in safety.safety_summary(df).collect():
        measured = [r for r in rows if r[0] == row.metric and r[1] is not None]
        assert row.passed_count + row.failed_count == row.total_tested == len(measured)


@QUICK
@given(st.lists(st.floats(0.01, 130).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_percentiles_equal_sorting(spark, latencies):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(latencies)], "run_id string, test_seq long, latency_seconds double")
    row = perf.latency_percentiles(df).collect()[0]
    ordered, n = sorted(latencies), len(latencies)
    for got, index in [(row.p50_latency, n // 2), (row.p95_latency, min(n * 95 // 100, n - 1))]:
        assert abs(got - ordered[index]) <= 0.005001


@QUICK
@given(st.lists(st.text(max_size=90), min_size=1, max_size=8))
def test_attack_encodings(spark, texts):
    import base64
    import codecs
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", redteam.base64_text(F.col("t")).alias("b"), redteam.rot13(F.col("t")).alias("r")).collect()
    for row in got:
        assert row.b == base64.b64encode(row.t.encode()).decode() and row.r == codecs.encode(row.t, "rot13")
