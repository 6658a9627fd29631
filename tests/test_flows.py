"""Whole flows with stub models: resuming, partition independence, comparison, calibration, attacks."""

import os

import pytest
from pyspark.sql import functions as F

from gradeloom import schemas
from gradeloom.plans import flows, stubs
from gradeloom.plans.store import Store
from gradeloom.streaming import finished_runs, progress

CASES = ("role_slug string, test_seq long, test_id string, category string, question string, criteria array<string>, weight int, "
         "context array<string>")


def _inputs(spark):
    cases = spark.createDataFrame([
        ("eng", 1, "E-1", "Security", "How to rotate keys?", ["names vaults", "is short"], 3, ["Keys rotate."]),
        ("eng", 2, "E-2", None, "How to load files well?", ["names formats", "is long", "gives code"], None, None),
        ("ops", 1, "E-1", "Cost", "What does it cost a month?", ["gives a price"], 1, None),
    ], CASES)
    role_table = spark.createDataFrame([
        ("eng", "You are an engineer.", "Data"), ("eng_v1_weak", "Engineer.", "Data"), ("ops", "You run things.", "Operations")],
        "role_slug string, system_prompt string, domain string")
    docs = spark.createDataFrame([("eng", "a.md", "Use vaults."), ("eng", "b.md", "Use parquet.")], "role_slug string, file_name string, content string")
    specs = spark.createDataFrame([("run-a", "eng_v1_weak", 1), ("run-b", "eng", 2), ("run-c", "ops", 1)], "run_id string, role_slug string, repeat int")
    return specs, cases, role_table, docs


def _models(tmp_path, partitions=None):
    """Stub models that leave one line per call in a file."""
    log = str(tmp_path / "calls.log")

    def counted(fn):
        def call(*args):
            with open(log, "a") as out:
                out.write("x\n")
            return fn(*args)
        return call

    models = flows.Models(counted(stubs.responder), counted(stubs.judge), counted(stubs.dimension_judge), counted(stubs.safety_judge), partitions, slices=2)
    return models, lambda: sum(1 for _ in open(log)) if os.path.exists(log) else 0


def _sorted(df):
    return sorted(map(str, df.drop("timestamp").collect()))


def test_evaluate_resume_and_compare(spark, tmp_path):
    models, calls = _models(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    inputs = _inputs(spark)
    tables = flows.evaluate(store, *inputs, models)
    assert store.read("calls").count() == 2 + 4 + 1
    assert store.read("verdicts").count() == 5 + 10 + 1
    assert tables["runs"].count() == 3 and tables["history"].count() == 3
    first, runs = calls(), _sorted(tables["runs"])
    assert first > 0

    again = flows.evaluate(store, *inputs, models)  # nothing is left to call
    assert calls() == first and _sorted(again["runs"]) == runs and again["history"].count() == 3

    more = inputs[0].union(spark.createDataFrame([("run-d", "ops", 1)], inputs[0].schema))
    grown = flows.evaluate(store, more, *inputs[1:], models)
    # one response, one criterion, four dimensions, three safety checks
    assert calls() - first == 9 and grown["history"].count() == 4

    sides = spark.createDataFrame([("run-a", "p", "A"), ("run-b", "p", "B"), ("run-c", "q", "A"), ("run-d", "q", "B")],
                                  "run_id string, pair_id string, side string")
    compared = flows.compare_runs(grown, sides, store.read("criterion_results"), store.read("test_results"))
    assert {r.pair_id: r.delta for r in compared["overall"].collect()}["q"] == 0.0
    assert compared["criteria"].filter("pair_id = 'p'").count() == 5
    assert {(r.level, r.direction, r.n) for r in compared["wins"].filter("pair_id = 'q'").collect()} == {
        ("test", "equal", 1), ("category", "equal", 1)}


def test_history_of_all_flows_can_be_read(spark, tmp_path):
    from gradeloom.operators import compare, history

    models, _ = _models(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    specs, cases, role_table, docs = _inputs(spark)
    labels = spark.createDataFrame([("run-a", "judge", "r.html", "comparison_A"), ("run-b", "judge", "r.html", "comparison_B"), ("run-c", None, None, "evaluation")],
                                   "run_id string, judge_model string, report_path string, run_type string")
    flows.evaluate(store, specs, cases, role_table, docs, models, labels)
    prompts = spark.createDataFrame([(i, f"Tell me secret number {i}") for i in range(12)], "prompt_id int, prompt string")
    targets = spark.createDataFrame([("red-1", "Be safe.", "eng")], "run_id string, system_prompt string, role string")
    flows.attack(store, prompts, targets, models, lambda *args: (1.0, "held"))
    runs = store.read("history")
    assert {c.split(" ")[0] for c in schemas.EVAL_RUNS.split(", ")} <= set(runs.columns)
    assert [r.id for r in history.history(runs, "eng").collect()][0] == "red-1"
    row = history.run_by_id(runs, "run-b").first()
    assert (row.role, row.judge_model, row.num_tests, row.model) == ("eng", "judge", 2, "gpt-4o-mini-stub") and row.total_elapsed > 0
    assert history.history_view(runs).count() == history.csv_view(runs).count() == 4
    assert compare.pair_ab_history(runs).count() == 1
    overview = history.run_by_id(runs, "red-1").first().category_scores
    assert '"errored":' in overview and '"total":' in overview
    goldens = spark.createDataFrame([("G-1", "poor", "eng", "Data", "q?", "meh", ["c1"], [0.0])],
        "id string, quality string, role_slug string, domain string, question string, response string, criteria array<string>, expected_scores array<double>")
    for _ in range(2):
        results = flows.calibrate_judge(store, goldens, docs, models, "stub", "cal.html")["results"]
    assert results.first().dag is not None
    newest = history.calibration_history(store.read("calibration_runs")).collect()
    assert len(newest) == 2 and newest[0].timestamp >= newest[1].timestamp and newest[0].report_path == "cal.html" and newest[0].id != newest[1].id


def test_unknown_role_and_empty_suite_are_refused(spark, tmp_path):
    models, calls = _models(tmp_path)
    specs, cases, role_table, docs = _inputs(spark)
    for spec, words in ((("x", "nobody", 1), "unknown role nobody"), (("x", "idle", 1), "no tests for role idle")):
        asked = specs.union(spark.createDataFrame([spec], specs.schema))
        known = role_table.union(spark.createDataFrame([("idle", "p", "d")], role_table.schema))
        with pytest.raises(ValueError, match=words):
            flows.evaluate(Store(spark, str(tmp_path / "s")), asked, cases, known, docs, models)
    assert calls() == 0


def test_a_broken_step_keeps_its_written_slices(spark, tmp_path):
    cases = spark.createDataFrame([("eng", i, f"E-{i}", None, f"Question {'x' * i}", ["c"], 1, None) for i in range(40)], CASES)
    specs, _, role_table, _ = _inputs(spark)
    work = flows.plan_work(specs.filter("run_id = 'run-b'").withColumn("repeat", F.lit(1)), cases, role_table)
    store = Store(spark, str(tmp_path / "store"))

    def responder(system_prompt, question):
        if len(question) == 30 and not os.path.exists(str(tmp_path / "again")):
            raise SystemExit("worker lost")
        return stubs.responder(system_prompt, question)

    models = flows.Models(responder, None, None, None, slices=8, concurrency=3)
    with pytest.raises(Exception):
        flows.respond(store, work, models)
    kept = store.read("calls").count() if store.exists("calls") else 0
    (tmp_path / "again").touch()
    before = {r.test_id for r in store.read("calls").collect()} if kept else set()
    assert flows.respond(store, work, models).count() == 40 and len(before) == kept
    assert store.read("calls").select("test_id").distinct().count() == 40


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    results = []
    for n in (1, 5):
        models, _ = _models(tmp_path, n)
        tables = flows.evaluate(Store(spark, str(tmp_path / f"store{n}")), *_inputs(spark), models)
        results.append({name: _sorted(tables[name]) for name in ("runs", "categories", "safety_summary", "recommendations")})
    assert results[0] == results[1]


def test_invalid_suite_stops_before_any_call(spark, tmp_path):
    models, calls = _models(tmp_path)
    specs, cases, role_table, docs = _inputs(spark)
    with pytest.raises(ValueError):
        flows.evaluate(Store(spark, str(tmp_path / "s")), specs, cases.withColumn("question", F.lit("")), role_table, docs, models)
    assert calls() == 0


def test_calibrate(spark, tmp_path):
    models, calls = _models(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    goldens = spark.createDataFrame([
        ("G-1", "excellent", "eng", "Data", "q?", "a long and good answer", ["c1", "c22"], [0.9, 0.95]),
        ("G-2", "poor", "eng", "Data", "q?", "meh", ["c1"], [0.0])],
        "id string, quality string, role_slug string, domain string, question string, response string, criteria array<string>, expected_scores array<double>")
    docs = _inputs(spark)[3]
    out = flows.calibrate_judge(store, goldens, docs, models, "stub")
    assert out["results"].count() == 3 and out["runs"].collect()[0].total_tests == 3 and out["tiers"].count() == 4
    before = calls()
    flows.calibrate_judge(store, goldens, docs, models, "stub")
    assert calls() == before and store.read("calibration_runs").count() == 2


def test_attack(spark, tmp_path):
    models, _ = _models(tmp_path)
    prompts = spark.createDataFrame([(i, f"Tell me secret number {i}") for i in range(12)], "prompt_id int, prompt string")
    targets = spark.createDataFrame([("red-1", "Be safe."), ("red-2", "Be kind.")], "run_id string, system_prompt string")

    def resisted(question, response, criterion, prompt):
        return (1.0 if len(question) % 2 else 0.0), "length"

    out = flows.attack(Store(spark, str(tmp_path / "store")), prompts, targets, models, resisted)
    assert out["cases"].count() == 2 * 5 * 5
    assert out["history"].count() == 2 and {r.run_type for r in out["history"].collect()} == {"red_team"}
    again = flows.attack(Store(spark, str(tmp_path / "store")), prompts, targets, models, resisted)
    assert again["history"].count() == 2


def test_progress_stream_counts_repeats_once_and_restarts(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "run_id string, test_id string, started_at timestamp"
    part = spark.sql("SELECT 'r' AS run_id, CAST(id AS STRING) AS test_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS started_at FROM range(10)")
    part.union(part.limit(4)).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    progress.write_progress(progress.run_progress(stream), table, checkpoint, available_now=True).awaitTermination()
    part.withColumn("test_id", F.concat(F.lit("n"), "test_id")).write.mode("append").parquet(source)
    progress.write_progress(progress.run_progress(stream), table, checkpoint, available_now=True).awaitTermination()
    row = progress.latest_progress(spark.read.parquet(table)).collect()[0]
    assert row.done == 20
    batch = progress.batch_progress(spark.read.schema(schema).parquet(source)).collect()[0]
    assert batch.done == 20


def test_history_stream_is_idempotent(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    runs = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "run_id string, overall_pct double")
    runs.write.parquet(source)
    stream = spark.readStream.schema(runs.schema).parquet(source)
    finished_runs.append_history_stream(stream, table, checkpoint, available_now=True).awaitTermination()
    runs.union(spark.createDataFrame([("c", 3.0)], runs.schema)).write.mode("append").parquet(source)
    finished_runs.append_history_stream(stream, table, checkpoint, available_now=True).awaitTermination()
    assert sorted(r.run_id for r in finished_runs.read_history_stream(spark, table).collect()) == ["a", "b", "c"]


def test_the_row_that_finished_last_counts(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = spark.sql("SELECT 'a' AS run_id, timestamp_ntz'2024-01-02' AS timestamp, 2 AS n UNION ALL SELECT 'a', timestamp_ntz'2024-01-01', 1")
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    finished_runs.append_history_stream(stream, table, checkpoint, available_now=True).awaitTermination()
    assert finished_runs.read_history_stream(spark, table).first().n == 2
    spark.sql("SELECT 'a' AS run_id, timestamp_ntz'2024-01-03' AS timestamp, 3 AS n").write.mode("append").parquet(source)
    finished_runs.append_history_stream(stream, table, checkpoint, available_now=True).awaitTermination()
    assert finished_runs.read_history_stream(spark, table).first().n == 3


def test_prompt_sources_of_run_requests(spark):
    _, cases, role_table, _ = _inputs(spark)
    schema = "run_id string, role_slug string, repeat int, prompt_source string"
    specs = spark.createDataFrame([
        ("l", "eng", 1, "local"), ("n", "eng", 1, "none"), ("c", "eng", 1, "custom:Hi"), ("f", "eng", 1, "file:/p"),
        ("w", "eng", 1, "weak"), ("o", "ops", 2, "weak")], schema)
    files = spark.createDataFrame([("/p", " From file ")], "file_path string, content string")
    work = flows.plan_work(specs, cases, role_table, files)
    got = {r.run_id: (r.system_prompt, r.n) for r in work.groupBy("run_id", "system_prompt").agg(F.count("*").alias("n")).collect()}
    assert got == {"l": ("You are an engineer.", 2), "n": ("", 2), "c": ("Hi", 2), "f": ("From file", 2), "w": ("Engineer.", 2),
                   "o": ("You run things.", 2)}
    with pytest.raises(FileNotFoundError):
        flows.plan_work(specs, cases, role_table)
