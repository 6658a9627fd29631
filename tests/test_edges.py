"""Hand-made edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import labels, numeric, text
from gradeloom.operators import (
    apply, calibrate, compare, context, history, ingest, model_output, perf, recommend, redteam, repeats, roles, safety,
    scoring, versions,
)
from gradeloom.streaming import progress

CRITERIA = "run_id string, test_id string, test_seq long, criterion_seq int, text string, score double, dag_score double"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_grades(spark):
    pcts = [94.95, 95, 90, 85, 80, 75, 70, 65, 60, 59.9]
    df = spark.createDataFrame([(float(p),) for p in pcts], "p double")
    got = [r.g for r in df.select(labels.grade(numeric.half_up("p", 1)).alias("g")).collect()]
    assert got == ["A+", "A+", "A", "A-", "B+", "B", "B-", "C+", "C", "D"]


def test_test_without_criteria_scores_zero(spark):
    criteria = spark.createDataFrame([("r", "a", 1, 0, "x", 0.5, None)], CRITERIA)
    tests = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, test_id string")
    got = {r.test_id: (r.score, r.dag_score, r.num_criteria) for r in scoring.test_scores(criteria, tests).collect()}
    assert got == {"a": (0.5, None, 1), "b": (0.0, None, 0)}


TESTS = "run_id string, test_id string, category string, score double, dag_score double, weight int, num_criteria int"


def test_overall_uses_weights_and_dag_only_where_present(spark):
    rows = [("r", "a", "c", 1.0, 0.5, 3, 5), ("r", "b", "c", 0.0, None, 1, 5), ("z", "a", "c", 0.9, None, 0, 5)]
    got = {r.run_id: r for r in scoring.run_scores(spark.createDataFrame(rows, TESTS)).collect()}
    assert (got["r"].overall_pct, got["r"].dag_pct, got["r"].consolidated_pct) == (75.0, 50.0, 65.0)
    assert (got["z"].overall_pct, got["z"].dag_pct, got["z"].consolidated_pct, got["z"].grade) == (0.0, None, 0.0, "D")


def test_category_mean_ignores_weights(spark):
    rows = [("r", "a", "c", 1.0, None, 3, 5), ("r", "b", "c", 0.0, 0.4, 1, 5)]
    row = one(scoring.category_scores(spark.createDataFrame(rows, TESTS)))
    assert (row.category_pct, row.category_dag_pct) == (50.0, 40.0)


SAFETY = "run_id string, test_id string, metric string, score double, passed boolean, reason string"


def test_safety_errors_are_excluded_and_stored_flag_counts(spark):
    rows = [("r", "a", "bias", 0.5, True, ""), ("r", "b", "bias", 0.5, False, "0.504 before rounding"),
            ("r", "c", "bias", -1.0, False, "Error"), ("r", "a", "toxicity", None, False, "Error")]
    df = spark.createDataFrame(rows, SAFETY)
    row = one(safety.safety_summary(df))
    assert (row.metric, row.pass_rate, row.total_tested, row.passed_count, row.failed_count) == ("bias", 50.0, 2, 1, 1)
    assert one(safety.safety_overall(df)).overall_pass_rate == 50.0
    only_errors = spark.createDataFrame([("e", "a", "bias", None, False, "")], SAFETY)
    runs = spark.createDataFrame([("e",), ("none",)], "run_id string")
    got = {r.run_id: (r.available, r.overall_pass_rate) for r in safety.safety_overall(only_errors, runs).collect()}
    assert got == {"e": (True, 0.0), "none": (False, None)}
    flagged = safety.safety_flagged(df, spark.createDataFrame([("r", "b", "q", "a")], "run_id string, test_id string, question string, response string"))
    assert one(flagged).response == "a"


CALLS = ("run_id string, test_id string, test_seq long, latency_seconds double, input_tokens long, output_tokens long, "
         "response_words long, model_id string, estimated_cost_usd double")


@pytest.mark.parametrize("n, p50, p95", [(1, 0, 0), (2, 1, 1), (19, 9, 18), (20, 10, 19), (21, 10, 19)])
def test_nearest_rank(spark, n, p50, p95):
    rows = [("r", str(i), i, (i + 1) / 4, 1, 2, 3, f"m{i}", 0.1) for i in range(n)]
    row = one(perf.perf_summary(spark.createDataFrame(rows, CALLS)))
    assert (row.p50_latency, row.p95_latency, row.model_id) == ((p50 + 1) / 4, (p95 + 1) / 4, "m0")


def test_perf_unavailable_without_latency_still_sums_tokens(spark):
    rows = [("r", "a", 1, 0.0, 10, 5, 7, "error", 0.0)]
    row = one(perf.perf_summary(spark.createDataFrame(rows, CALLS)))
    assert (row.available, row.p95_latency, row.total_tokens) == (False, None, 15)


def test_prices(spark):
    df = spark.createDataFrame([("GPT-4o-mini-x",), ("other",)], "m string")
    got = [(r.l, r.f) for r in df.select(text.match_price("m")["input_per_million"].alias("l"), text.match_price("m", "first")["input_per_million"].alias("f")).collect()]
    assert got == [(0.15, 2.5), (0.0, 0.0)]
    custom = df.select(text.match_price("m", table=[("other", 1, 2)])["output_per_million"].alias("o")).collect()
    assert [r.o for r in custom] == [0.0, 2.0]


def test_calibration_boundary_and_empty_tiers(spark):
    rows = [("a", "excellent", 0.95, 0.70, "c"), ("b", "excellent", 0.95, 0.69, "c"), ("c", "misleading", 0.0, 0.31, "c")]
    results = calibrate.calibration_results(spark.createDataFrame(rows, "test_id string, quality string, expected double, geval double, criterion string"))
    assert {r.test_id: r.passed for r in results.collect()} == {"a": True, "b": False, "c": False}
    run = one(calibrate.calibration_run(results))
    assert (run.discrimination, run.avg_poor, run.issues_count, run.failed) == (0.0, 0.0, 1, 2)
    assert {r.quality: r.avg_geval for r in calibrate.calibration_by_tier(results).collect()} == {
        "excellent": 0.7, "adequate": 0.0, "poor": 0.0, "misleading": 0.31}


def test_red_team_errors_only(spark):
    rows = [("v", True, None), ("v", False, None), ("w", False, "broken")]
    overview = redteam.red_team_overview(spark.createDataFrame(rows, "vulnerability string, passed boolean, error string"))
    assert {r.vulnerability: (r.pass_rate, r.total, r.errored) for r in overview.collect()} == {"v": (50.0, 2, 0), "w": (-1.0, 0, 1)}
    row = one(redteam.red_team_overall(overview))
    assert (row.overall_pass_rate, row.total_attacks, row.total_errored) == (50.0, 2, 1)


def test_turns_are_joined_only_without_input(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    df = spark.createDataFrame([("", "x", turns), ("in", "out", turns), (None, None, None)],
                               "input string, output string, turns array<struct<role:string,content:string>>")
    got = [(r.input, r.output) for r in redteam.conversation_pairs(df).collect()]
    assert got == [("a\n---\nc", "b"), ("in", "out"), ("", "")]


def test_recommendations_rules(spark):
    rows = [("r", f"t{i}", i, 0, f"criterion {i}", 0.1 + i * 0.05, None) for i in range(9)]
    criteria = spark.createDataFrame(rows, CRITERIA)
    assert recommend.rec_criterion(criteria).count() == 8
    same = spark.createDataFrame([("r", "t", 1, 0, "x" * 80 + "one", 0.5, None), ("r", "t", 1, 1, "x" * 80 + "two", 0.3, None)], CRITERIA)
    categories = spark.createDataFrame([("r", "Security", 84.96, 0.8496, 1)], "run_id string, category string, category_pct double, category_score double, first_seq long")
    runs = spark.createDataFrame([("r", 85.0)], "run_id string, overall_pct double")
    recs = recommend.recommendations(same, categories, runs)
    got = [(r.priority, r.title[:12], r.stage) for r in recommend.rank_recommendations(recs).collect()]
    assert got == [("HIGH", "[t] Weak on:", 2), ("HIGH", "Security rec", 4), ("MEDIUM", "Security sco", 1)]


def test_ab_pairs_by_position_and_keeps_missing_sides(spark):
    a = spark.createDataFrame([("p", "t", i, f"a{i}", 0.5) for i in range(3)], "pair_id string, test_id string, criterion_seq int, text string, score double")
    b = spark.createDataFrame([("p", "t", i, f"b{i}", 0.75) for i in range(2)], "pair_id string, test_id string, criterion_seq int, text string, score double")
    got = {(r.criterion_seq, r.text, r.delta, r.direction) for r in compare.ab_criteria(compare.stack_sides(a, b)).collect()}
    assert got == {(0, "a0", 0.25, "up"), (1, "a1", 0.25, "up")}
    cat = spark.createDataFrame([("p", "only b", 40.0)], "pair_id string, category string, category_pct double")
    row = one(compare.ab_categories(compare.stack_sides(cat.limit(0), cat)))
    assert (row.a_pct, row.b_pct, row.delta) == (0.0, 40.0, 40.0)


CASES = "role_slug string, test_seq long, test_id string, category string, question string, criteria array<string>, weight int, context array<string>"


def test_merge_keeps_existing_and_first_new(spark):
    existing = spark.createDataFrame([("r", 1, "a", "old", "q", ["c"], 3, None)], CASES)
    incoming = spark.createDataFrame([
        ("r", 1, "a", "new", "q", ["c"], 1, None), ("r", 2, "b", "first", "q", ["c"] * 7, None, []),
        ("r", 3, "b", "second", "q", ["c"], 1, None), ("r", 4, None, None, None, None, None, ["x"])], CASES)
    merged = ingest.merge_suite(existing, incoming)
    got = {(r.test_id, r.category, r.test_seq, len(r.criteria), r.added) for r in merged.collect()}
    assert got == {("a", "old", 1, 1, False), ("b", "first", 3, 5, True), ("GEN-05", "General", 5, 0, True)}
    again = ingest.merge_suite(merged.drop("added"), incoming.filter("test_id is not null"))
    assert again.filter("added").count() == 0 and again.count() == 3
    assert one(ingest.merge_counts(merged)).added == 2


def test_fail_fast(spark):
    good = spark.createDataFrame([("r", 1, "a", "c", "q", ["c"], 3, None)], CASES)
    ingest.fail_fast(good)
    with pytest.raises(ingest.SuiteError, match="criterion #2"):
        ingest.fail_fast(spark.createDataFrame([("r", 1, "a", "c", "q", ["c", "\t\n"], 3, None)], CASES))
    with pytest.raises(ingest.SuiteError, match="empty"):
        ingest.fail_fast(good, spark.createDataFrame([("other",)], "role_slug string"))


@pytest.mark.parametrize("raw, parsed_by, items", [
    ('[{"id": "a"}]', "fence", 1), ('```json\n[{"id": "a"}, {"id": "b"}]\n```', "fence", 2), ('```\n[]\n```', "fence", 0),
    ('Here: [{"id": "a"}] done', "slice", 1), ("no json", "rejected", None), ('{"id": "a"}', "rejected", None),
    ('[{"id": "a"', "rejected", None), ('[{"id": "a"}] and [{"id": "b"}]', "rejected", None), ("] [", "rejected", None),
    ('  [{"id": "a"}]  ', "fence", 1), ("", "rejected", None), (None, "rejected", None),
])
def test_json_salvage(spark, raw, parsed_by, items):
    row = one(model_output.parse_json_array(spark.createDataFrame([(raw,)], "raw string"), "raw"))
    assert (row.parsed_by, None if row["items"] is None else len(row["items"])) == (parsed_by, items)


@pytest.mark.parametrize("item, criteria, weight", [
    ('{"id": "a", "weight": "3"}', ["[REVIEW NEEDED] Add criteria"], 3), ('{"id": "a", "weight": 2.5}', ["[REVIEW NEEDED] Add criteria"], 2),
    ('{"id": "a", "criteria": "one string"}', ["one string"], 2), ('{"id": "a", "criteria": {"x": 1}, "weight": [1]}', ["[REVIEW NEEDED] Add criteria"], 2),
])
def test_one_odd_field_costs_nothing_else(spark, item, criteria, weight):
    raw = f'[{item}, {{"id": "b", "weight": 1}}, 7, "text", null]'
    parsed = model_output.parse_json_array(spark.createDataFrame([("r", raw)], "role_slug string, raw string"), "raw")
    got = {r.test_id: (r.criteria, r.weight) for r in model_output.cases_from_output(parsed).collect()}
    assert got == {"a": (criteria, weight), "b": (["[REVIEW NEEDED] Add criteria"], 1)}
    assert [r.test_seq for r in model_output.item_rejects(parsed).orderBy("test_seq").collect()] == [3, 4, 5]


@pytest.mark.parametrize("raw, parsed_by", [('[{"id": "a"}], "extra": [1]', "rejected"), ('{"cases": [{"id": "a"}]}', "slice")])
def test_json_of_another_shape(spark, raw, parsed_by):
    assert one(model_output.parse_json_array(spark.createDataFrame([(raw,)], "raw string"), "raw")).parsed_by == parsed_by


def test_generated_case_defaults(spark):
    raw = '[{"id": "a", "question": "q", "context": "one"}, {"id": "b", "criteria": ["x"], "weight": 3, "context": ["one", "two"]}]'
    parsed = model_output.parse_json_array(spark.createDataFrame([("r", raw)], "role_slug string, raw string"), "raw")
    got = {r.test_id: (r.criteria, r.weight, r.context, r.needs_review) for r in model_output.cases_from_output(parsed).collect()}
    assert got == {"a": (["[REVIEW NEEDED] Add criteria"], 2, ["one"], True), "b": (["x"], 3, ["one", "two"], True)}


def test_apply_error_conventions(spark):
    def broken(*args):
        raise RuntimeError("Server Error " + "x" * 400)

    waits = []
    assert apply.with_retry(broken, sleep=waits.append)[1] == 3 and waits == [2, 4]
    assert apply.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad key")), sleep=waits.append)[1] == 1

    def bad(*args):
        raise ValueError("no")

    work = spark.createDataFrame([("r", "t", 0, "q", "a", "c", "p", "s")], "run_id string, test_id string, criterion_seq int, question string, response string, criterion string, judge_prompt string, system_prompt string")
    call = one(apply.generate_responses(work, bad))
    assert (call.response, call.model_id, call.latency_seconds, call.response_chars) == ("[ERROR: Target model failed — no]", "error", 0.0, 0)
    verdict = one(apply.judge_criteria(work, bad))
    assert (verdict.score, verdict.errored, verdict.explanation) == (0.0, True, "GEval error: no")
    dims = one(apply.judge_dimensions(work, bad))
    assert dims.dag_score == 0.0 and not any(v.passed for v in dims.dag_dimensions.values())
    check = one(apply.judge_safety(work.withColumn("metric", F.lit("bias")), bad))
    assert (check.score, check.passed, check.reason) == (None, False, "Error: no")
    close = one(apply.judge_safety(work.withColumn("metric", F.lit("bias")), lambda m, q, r: (0.504, None)))
    assert (close.score, close.passed) == (0.5, False)


def test_hallucination_only_with_context(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None)], "test_id string, context array<string>")
    got = {r.test_id: r.n for r in apply.safety_work(df).groupBy("test_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}


def test_average_repeats(spark):
    rows = [("r", "t", 0, 1, "first", 0.5, None), ("r", "t", 0, 2, "last", 0.25, 0.8)]
    row = one(repeats.average_criteria(spark.createDataFrame(rows, "run_id string, test_id string, criterion_seq int, repeat int, text string, score double, dag_score double")))
    assert (row.score, row.dag_score, row.text) == (0.38, 0.8, "last")  # 0.375 half up
    sc = spark.createDataFrame([("r", "t", "bias", 1, 0.2), ("r", "t", "bias", 2, -1.0)], "run_id string, test_id string, metric string, repeat int, score double")
    assert (one(repeats.average_safety(sc)).score, one(repeats.average_safety(sc)).passed) == (0.2, True)
    runs = spark.createDataFrame([("r", 1, "1.0", 2.5), ("r", 2, "1.0", 1.5)], "run_id string, repeat int, prompt_version string, total_elapsed double")
    assert (one(repeats.average_runs(runs)).prompt_version, one(repeats.average_runs(runs)).total_elapsed) == ("1.0 (avg of 2 runs)", 4.0)


def test_line_diff_and_restore(spark):
    rows = [("r", 3, "a\nb", "t3", ""), ("r", 9, "a\nc\nd", "", ""), ("r", 5000, "", "", "")]
    df = spark.createDataFrame(rows, "role_slug string, id long, prompt_text string, test_cases string, context_text string")
    got = {(r.id, r.line_no, r.status) for r in versions.version_line_diff(df).collect()}
    assert got == {(9, 1, "same"), (9, 2, "changed"), (9, 3, "added"), (5000, 1, "removed"), (5000, 2, "removed"), (5000, 3, "removed")}
    assert {(r.id, r.test_cases) for r in versions.carried_forward(df, "test_cases").collect()} == {(3, "t3"), (9, "t3"), (5000, "t3")}
    row = one(versions.restore_version(versions.with_hashes(df), spark.createDataFrame([("r", 3)], "role_slug string, id long")))
    assert (row.id, row.prompt_text, row.change_note, row.context_hash) == (5001, "a\nb", "Restored version 3", "")


def test_context_cut_is_exact_with_many_small_documents(spark):
    docs = spark.range(3000).select(F.lit("r").alias("role_slug"), F.format_string("%05d", "id").alias("file_name"), F.lit("").alias("content"))
    whole = "\n\n".join(f"### {i:05d}\n" for i in range(3000))
    assert one(context.judge_context(docs)).context_text == whole[:6000]
    info = one(context.context_info(spark.createDataFrame([("r",)], "role_slug string"), docs))
    assert (info.total_chars, info.doc_count) == (len(whole), 3000)


def test_improvement_prompt_of_a_run_of_any_size(spark):
    weak = spark.range(50_000).selectExpr("'r' AS run_id", "id AS test_seq", "0 AS criterion_seq", "concat('- line ', id) AS line").unionByName(
        spark.createDataFrame([("s", 1, 0, "- z")], "run_id string, test_seq long, criterion_seq int, line string"))
    runs = spark.createDataFrame([("r", 50.0, "D", "p"), ("s", 50.0, "D", None), ("t", 99.0, "A+", "p")], "run_id string, overall_pct double, grade string, system_prompt string")
    recs = spark.createDataFrame([], "run_id string, priority_rank int, stage int, stage_order long, priority string, title string, prompt_suggestion string")
    parts = recommend.improvement_parts(runs, weak, recs)
    got = {r.run_id: r for r in recommend.improve_prompts(parts, lambda prompt: prompt, lambda prompt: prompt[-60:]).collect()}
    assert "\n".join(f"- line {i}" for i in range(50_000)) in got["r"].improved_prompt
    assert "performing well" in got["t"].improved_prompt and "No specific recommendations." in got["t"].improved_prompt
    assert set(got) == {"r", "s", "t"} and got["t"].changes_summary.endswith("no introduction.")


def test_case_parts_of_a_long_conversation(spark):
    turns = spark.range(1000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS content", "CAST(NULL AS string) AS input")
    rows = redteam.case_parts(turns, ["conv_id"]).orderBy("side", "part_no").collect()
    assert [r.text for r in rows if r.side == "input"] == [f"t{i}" for i in range(0, 1000, 2)]
    assert [r.part_no for r in rows if r.side == "output"] == list(range(1, 501))


def test_null_keys_are_kept(spark):
    from gradeloom.operators import perf, spread

    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, None, "c"), (1, 5, "d"), (1, 9000, "e")], "k long, o long, text string")
    assert spread.numbered(rows, ["k"], ["o"], "n").count() == 5
    assert {(r.k, r.o): r.p for r in spread.with_previous(rows, ["k"], "o", "p").collect()}[(None, 2)] == 1
    calls = spark.createDataFrame([("r", None, 0.75), ("r", "m", 0.25)], "role string, model_id string, estimated_cost_usd double")
    got = {(r.role, r.model_id, r.level): r.total_cost for r in perf.cost_totals(calls).collect()}
    assert got[("r", None, 0)] == 0.75 and got[("r", None, 1)] == 1.0 and got[(None, None, 3)] == 1.0


def test_prompt_sources(spark):
    requests = spark.createDataFrame([("local", "L"), ("none", "L"), ("custom:hi", "L"), ("file:/a", "L"), ("file:/b", "L"), ("weak", "L")], "prompt_source string, local_prompt string")
    files = spark.createDataFrame([("/a", " text\n")], "file_path string, content string")
    got = {r.prompt_source: (r.resolved_prompt, r.missing_file) for r in roles.resolve_prompt(requests, files).collect()}
    assert got == {"local": ("L", False), "none": ("", False), "custom:hi": ("hi", False), "file:/a": ("text", False), "file:/b": (None, True), "weak": ("L", False)}


def test_history_csv_keeps_zero(spark):
    row = {"id": 1, "timestamp": None, "role": "r", "model": "", "judge_model": None, "overall_pct": 0.0, "dag_pct": 0.0, "consolidated_pct": None,
           "consolidated_grade": "", "grade": "D", "num_tests": 0, "num_criteria": 0, "avg_latency": 0.0, "p95_latency": None, "total_tokens": 0,
           "estimated_cost": 0.0, "total_elapsed": 0.0, "run_type": "evaluation", "notes": "a,b"}
    schema = ("id long, timestamp timestamp, role string, model string, judge_model string, overall_pct double, dag_pct double, consolidated_pct double, "
              "consolidated_grade string, grade string, num_tests long, num_criteria long, avg_latency double, p95_latency double, total_tokens long, "
              "estimated_cost double, total_elapsed double, run_type string, notes string")
    got = one(history.csv_view(spark.createDataFrame([tuple(row.values())], schema)))
    assert (got["DAG %"], got["Combined %"], got["Avg Latency (s)"], got["P95 Latency (s)"], got["Notes"], got["Model"], got["Grade"]) == (
        "0.0", "0.0", "0.0", "", "a;b", "demo", "D")


def test_progress_status(spark):
    updates = spark.createDataFrame([("r", 0, 1, "a", 1), ("r", 1, 3, "c", 3)], "run_id string, batch_id long, done long, last_test string, last_at long")
    totals = spark.createDataFrame([("r", 3), ("s", 2)], "run_id string, total long")
    got = {r.run_id: (r.done, r.status, r.last_test) for r in progress.latest_progress(updates, totals).collect()}
    assert got == {"r": (3, "done", "c"), "s": (0, "running", None)}


def test_rounding_contract(spark):
    df = spark.createDataFrame([(2.675, 2), (0.125, 2), (88.25, 1)], "v double, n int")
    assert [r.x for r in df.filter("n = 2").select(numeric.half_up("v", 2).alias("x")).collect()] == [2.68, 0.13]
    row = one(df.agg(numeric.exact_avg("v").alias("m")))
    assert math.isclose(row.m, (2.675 + 0.125 + 88.25) / 3)
