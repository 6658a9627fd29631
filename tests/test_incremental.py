"""Report tables after each of several appends equal those made from all results at once."""

import pytest

from pyspark.sql import functions as F

from gradeloom.operators import marts
from gradeloom.plans import incremental
from gradeloom.plans.catalog import ALL
from gradeloom.sources import keyed


def results(spark, runs, shift=0):
    rows = [(r, t, s) for r in runs for t in ("t1", "t2") for s in (0, 1)]
    criteria = spark.createDataFrame([(r, t, 1 if t == "t1" else 2, s, f"c{s}", ((len(r) + s + shift) % 5) / 4, None) for r, t, s in rows],
                                     "run_id string, test_id string, test_seq long, criterion_seq int, text string, score double, dag_dimensions map<string,struct<score:double,passed:boolean>>")
    calls = spark.createDataFrame([(r, t, 1, "q", "a", 1.0 + shift, 10, 20, 5, "gpt-4o", 0.5) for r in runs for t in ("t1", "t2")],
                                  "run_id string, test_id string, test_seq long, question string, response string, latency_seconds double, input_tokens long, output_tokens long, response_words long, model_id string, estimated_cost_usd double")
    verdicts = spark.createDataFrame([(r, t, "bias", 0.9 if shift else 0.1, not shift, "why") for r in runs for t in ("t1", "t2")],
                                     "run_id string, test_id string, metric string, score double, passed boolean, reason string")
    return {"criteria": criteria.withColumn("dag_score", F.lit(None).cast("double")), "calls": calls, "verdicts": verdicts}


def test_reports_follow_the_results(spark, tmp_path):
    root, reports = str(tmp_path / "results"), str(tmp_path / "reports")
    cases = spark.createDataFrame([("t1", "A", 1), ("t2", "B", 3)], "test_id string, category string, weight int")
    for runs, shift in ((["r1", "run2"], 0), (["run3", "r1"], 1), (["r1"], 2)):
        changed = incremental.put_results(root, 2, **results(spark, runs, shift))
        assert {r.run_id for r in changed.collect()} == set(runs)
        incremental.refresh(spark, root, reports, cases, changed, buckets=2)
    whole = {n: keyed.read_keyed(spark, f"{root}/{n}") for n in incremental.RESULTS}
    for name, mart in marts.report_mart(whole["criteria"], cases, whole["calls"], whole["verdicts"]).items():
        got = keyed.read_keyed(spark, f"{reports}/{name}").select(mart.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, mart.collect())), name


def test_only_the_partitions_of_changed_runs_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.put_rows(spark.range(200).withColumnRenamed("id", "run_id"), path, ["run_id"], buckets=16)
    wanted = spark.createDataFrame([(7,), (7,), (None,)], "run_id long")
    rows = keyed.rows_of(spark, path, wanted, ["run_id"], buckets=16)
    assert [r.run_id for r in rows.collect()] == [7]
    assert "PartitionFilters: [key_bucket" in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        incremental.put_results(path, other=wanted)


def test_rows_are_written_once_beside_the_table(spark, tmp_path, monkeypatch):
    path, shared, ids = str(tmp_path / "t"), str(tmp_path / "shared"), lambda a, z: spark.range(a, z).withColumnRenamed("id", "run_id")
    keyed.put_rows(ids(0, 1000), path, ["run_id"], buckets=2)
    monkeypatch.setattr(keyed, "shared_dir", lambda spark, purpose: f"{shared}/{purpose}")
    keyed.put_rows(ids(990, 1010), path, ["run_id"], buckets=2)
    assert spark.read.option("recursiveFileLookup", "true").parquet(shared).count() == 20
    assert sorted(r.run_id for r in keyed.read_keyed(spark, path).collect()) == list(range(1010))


def test_a_bucket_without_rows_leaves_the_table(spark, tmp_path):
    path, ids = str(tmp_path / "t"), lambda a, z: spark.range(a, z).withColumnRenamed("id", "run_id")
    keyed.put_rows(ids(0, 100), path, ["run_id"], buckets=2)
    keyed.put_rows(ids(1, 2), path, ["run_id"], buckets=2, gone=ids(0, 100))
    assert [r.run_id for r in keyed.read_keyed(spark, path).collect()] == [1]


def test_tests_are_scored_once_in_a_refresh(spark, tmp_path):
    root, reports = str(tmp_path / "results"), str(tmp_path / "reports")
    cases = spark.createDataFrame([("t1", "A", 1), ("t2", "B", 3)], "test_id string, category string, weight int")
    changed = incremental.put_results(root, 2, **results(spark, ["r1", "run2"]))
    scored = spark.sparkContext.accumulator(0)

    def seen(weight):
        scored.add(1)
        return weight

    counted = cases.withColumn("weight", F.udf(seen, "int")("weight"))
    incremental.refresh(spark, root, reports, counted, changed, buckets=2)
    assert scored.value <= 2 * cases.count()


def test_the_query_refreshes_every_report_table(spark, tmp_path):
    """`report_mart_incremental` counts all tables of `marts.mart_tables`, not some of them."""
    tables = {
        "lineitem": spark.range(40).selectExpr("id AS l_orderkey", "id % 5 AS l_partkey", "id % 4 AS l_suppkey", "1 AS l_linenumber", "20.0D AS l_quantity", "id * 1.5D AS l_extendedprice",
                                               "0.05D AS l_discount", "0.04D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate"),
        "part": spark.range(5).selectExpr("id AS p_partkey", "'n' AS p_name", "concat('B', id % 2) AS p_brand", "'t' AS p_type", "cast(id AS int) AS p_size"),
        "events": spark.range(30).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 6 AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 3}' AS props"),
        "documents": spark.range(12).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars"),
        "labels": spark.range(9).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 3 = 0 AS int) AS toxic"),
    }
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.mart: r.num_rows for r in ALL["report_mart_incremental"][0](spark, str(tmp_path)).collect()}
    # Runs: 4 of criteria, 6 of calls, 12 of verdicts, 9 of them labelled; toxicity fails in 3, bias in those 5 of quality 0.
    assert got == {"runs": 4, "categories": 8, "tests": 20, "safety": 18, "safety_overall": 12, "flagged": 8, "performance": 6}
