"""Whole evaluations: respond, judge, score, report, compare, calibrate, attack.

Every step that calls a model writes its rows before the next step reads them, slice by slice,
and asks only for what is not written yet. A job that lost its executors, or was stopped, is run
again with the same store; it repeats the calls of the slice that broke off, and no others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .. import schemas
from ..functions import fixed_values as fv, text
from ..operators import apply, calibrate, compare, context, history, ingest, marts, perf, recommend, redteam, repeats, roles, safety, scoring
from .store import Store

CALL = ("run_id", "repeat", "test_id")
CRITERION = (*CALL, "criterion_seq")
METRIC = (*CALL, "metric")


@dataclass(frozen=True)
class Models:
    """The callables that reach the models; see the apply operators for what each returns."""

    responder: Callable
    judge: Callable
    dimension_judge: Callable
    safety_judge: Callable
    partitions: int | None = None  # tasks of a slice
    concurrency: int = 1  # calls at the same time in each task
    slices: int = 4  # parts of a step that are committed one after the other


def with_prompts(specs: DataFrame, role_table: DataFrame, prompt_files: DataFrame | None = None) -> DataFrame:
    """Run requests with domain and system prompt. A request may name a prompt_source: local,
    none, weak (the weak variant of the role where there is one), custom:text or file:path."""
    prompts = role_table.select("role_slug", "system_prompt", "domain")
    if "prompt_source" not in specs.columns:
        return specs.join(prompts, "role_slug")
    weak = role_table.filter(F.col("role_slug").endswith(fv.WEAK_SUFFIX)).select(
        text.base_slug("role_slug").alias("role_slug"), F.col("system_prompt").alias("_weak"))
    local = F.when(F.col("prompt_source") == "weak", F.coalesce("_weak", "system_prompt")).otherwise(F.col("system_prompt"))
    requests = specs.join(prompts, "role_slug").join(weak, "role_slug", "left").withColumn("local_prompt", local)
    if prompt_files is None:
        prompt_files = specs.sparkSession.createDataFrame([], "file_path string, content string")
    resolved = roles.resolve_prompt(requests.drop("_weak", "system_prompt"), prompt_files)
    missing = resolved.filter("missing_file").select("prompt_source").limit(1).collect()
    if missing:
        raise FileNotFoundError(f"no prompt file for {missing[0][0]}")
    return resolved.drop("local_prompt", "missing_file").withColumnRenamed("resolved_prompt", "system_prompt")


def plan_work(specs: DataFrame, cases: DataFrame, role_table: DataFrame, prompt_files: DataFrame | None = None) -> DataFrame:
    """Run requests (run_id, role_slug, repeat) to one row per call, with prompt and domain."""
    refuse_unknown(specs, cases, role_table)
    return roles.expand_run_specs(with_prompts(specs, role_table, prompt_files), ingest.apply_defaults(cases))


def refuse_unknown(specs: DataFrame, cases: DataFrame, role_table: DataFrame) -> None:
    """Raises for a run whose role is not known or whose suite has no test."""
    wanted = specs.select("run_id", "role_slug", text.base_slug("role_slug").alias("_suite"))
    known = role_table.select("role_slug", F.lit(True).alias("_known")).distinct()
    suites = cases.select(F.col("role_slug").alias("_suite"), F.lit(True).alias("_has_tests")).distinct()
    checked = wanted.join(known, "role_slug", "left").join(suites, "_suite", "left")
    bad = checked.filter(F.col("_known").isNull() | F.col("_has_tests").isNull()).orderBy("run_id").limit(5).collect()
    if bad:
        raise ValueError("; ".join(
            f"run {r.run_id}: {'no tests for' if r._known else 'unknown'} role {r.role_slug}" for r in bad))


def respond(store: Store, work: DataFrame, models: Models) -> DataFrame:
    return store.append_slices("calls", work, CALL, lambda pending: apply.generate_responses(
        pending, models.responder, CALL, models.partitions, concurrency=models.concurrency), models.slices)


def judge(store: Store, work: DataFrame, calls: DataFrame, docs: DataFrame, models: Models) -> None:
    """Criterion, dimension and safety verdicts of every response."""
    responses = calls.select(*CALL, "response")
    criteria = ingest.explode_criteria(work.select(*CALL, "role_slug", "domain", "question", "criteria"))

    # Responses come to what is pending: the comparison with the written keys moves no long texts.
    def judged(pending: DataFrame) -> DataFrame:
        prompted = context.build_judge_prompts(pending.join(responses, list(CALL)), context.judge_context(docs))
        return apply.judge_criteria(prompted, models.judge, CRITERION, models.partitions, concurrency=models.concurrency)

    def checked(pending: DataFrame) -> DataFrame:
        return apply.judge_dimensions(pending.join(responses, list(CALL)), models.dimension_judge, CRITERION, models.partitions, concurrency=models.concurrency)

    def safe(pending: DataFrame) -> DataFrame:
        return apply.judge_safety(pending.join(responses, list(CALL)), models.safety_judge, METRIC, models.partitions, concurrency=models.concurrency)

    store.append_slices("verdicts", criteria, CRITERION, judged, models.slices)
    store.append_slices("dimensions", criteria, CRITERION, checked, models.slices)
    store.append_slices("safety", apply.safety_work(work.select(*CALL, "question", "context")), METRIC, safe, models.slices)


def score(store: Store, work: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the report, from the written verdicts. Repeats are averaged."""
    verdicts, dimensions = store.read("verdicts"), store.read("dimensions")
    criteria = ingest.explode_criteria(work.select(*CALL, "test_seq", "criteria")).withColumnRenamed("criterion", "text")
    aligned = apply.align_verdicts(criteria, verdicts, CRITERION).join(
        dimensions.select(*CRITERION, "dag_dimensions", "dag_score"), list(CRITERION), "left")
    criteria_avg = store.replace("criterion_results", repeats.average_criteria(aligned))

    cases = work.groupBy("run_id", "test_id").agg(
        F.min("category").alias("category"), F.min("weight").alias("weight"), F.min("question").alias("question"),
        F.min("test_seq").alias("test_seq"))
    scores = scoring.test_scores(criteria_avg, cases.select("run_id", "test_id"))
    tests = store.replace("test_results", scores.join(cases, ["run_id", "test_id"]))
    call_avg = repeats.average_calls(store.read("calls")).join(
        cases.select("run_id", "test_id", "test_seq", "question"), ["run_id", "test_id"])
    verdict_avg = repeats.average_safety(store.read("safety"))

    categories, runs = scoring.category_scores(tests), scoring.run_scores(tests)
    tables = {
        "runs": runs, "category_scores": categories, "categories": marts.category_mart(categories),
        "tests": marts.test_mart(tests, call_avg), "safety_summary": marts.safety_mart(verdict_avg),
        "safety_overall": safety.safety_overall(verdict_avg), "flagged": safety.safety_flagged(verdict_avg, call_avg),
        "performance": perf.perf_summary(call_avg), "recommendations": recommend.recommendations(criteria_avg, categories, runs),
    }
    return {name: store.replace(f"mart_{name}", table) for name, table in tables.items()}


def evaluate(store: Store, specs: DataFrame, cases: DataFrame, role_table: DataFrame, docs: DataFrame, models: Models,
             labels: DataFrame | None = None, prompt_files: DataFrame | None = None) -> dict[str, DataFrame]:
    """An evaluation of any number of runs; appends one history row per run. `labels` holds
    further columns per run for the history (judge model, provider, run type, notes, ...)."""
    ingest.fail_fast(cases)
    work = plan_work(specs, cases, role_table, prompt_files)
    calls = respond(store, work, models)
    judge(store, work, calls, docs, models)
    tables = score(store, work)
    rows = history.eval_run_rows(tables["runs"], tables["category_scores"], tables["performance"])
    rows = rows.join(run_facts(specs, role_table, calls), "run_id", "left")
    if labels is not None:
        rows = rows.drop(*(c for c in labels.columns if c != "run_id")).join(labels, "run_id", "left")
    if "run_type" not in rows.columns:
        rows = rows.withColumn("run_type", F.lit("evaluation"))
    rows = rows.withColumn("timestamp", F.localtimestamp()).withColumn("category_scores", F.to_json("category_scores"))
    tables["history"] = store.append("history", history.whole_rows(store.pending("history", rows, ("run_id",))), "run_type")
    return tables


def run_facts(specs: DataFrame, role_table: DataFrame, calls: DataFrame) -> DataFrame:
    """What a history row says about a run besides its scores: role, prompt, model and duration. The
    duration of a run is the latency of its calls, summed over repeats; its version names the repeats."""
    said = [c for c in ("prompt_source", "prompt_name", "provider", "mode") if c in specs.columns]
    version = "version" if "version" in role_table.columns else None
    roles_ = role_table.select("role_slug", (F.col(version) if version else F.lit(None).cast("string")).alias("prompt_version"))
    repeated = calls.groupBy("run_id", "repeat").agg(F.sum("latency_seconds").alias("total_elapsed"))
    runs = specs.select("run_id", "role_slug", *said).join(roles_, "role_slug", "left")
    totals = repeats.average_runs(repeated.join(runs.select("run_id", "prompt_version"), "run_id", "left"))
    models = calls.filter(F.col("error").isNull()).groupBy("run_id").agg(F.max("model_id").alias("model"))
    return (
        runs.drop("prompt_version").withColumnRenamed("role_slug", "role")
        .join(totals.select("run_id", "total_elapsed", "prompt_version"), "run_id", "left").join(models, "run_id", "left")
    )


def compare_runs(tables: dict[str, DataFrame], sides: DataFrame, criteria: DataFrame, tests: DataFrame) -> dict[str, DataFrame]:
    """A/B tables of evaluated runs; `sides` names pair_id and side (A or B) of each run."""

    def sided(df):
        return df.join(sides, "run_id")

    categories, per_test = compare.ab_categories(sided(tables["category_scores"])), compare.ab_tests(sided(tests))
    return {
        "overall": compare.ab_overall(sided(tables["runs"])), "categories": categories, "tests": per_test,
        "criteria": compare.ab_criteria(sided(criteria)),
        "wins": compare.ab_wins(per_test, "test").unionByName(compare.ab_wins(categories, "category")),
    }


def calibrate_judge(store: Store, goldens: DataFrame, docs: DataFrame, models: Models, judge_model: str,
                    report_path: str = "") -> dict[str, DataFrame]:
    """Judge every gold item, then measure the judge. Gold items have role_slug and domain."""
    key = ("id", "criterion_seq")
    rows = calibrate.explode_goldens(goldens)

    def judged(pending: DataFrame) -> DataFrame:
        prompted = context.build_judge_prompts(pending, context.judge_context(docs))
        return apply.judge_criteria(prompted, models.judge, key, models.partitions, concurrency=models.concurrency)

    def checked(pending: DataFrame) -> DataFrame:
        return apply.judge_dimensions(pending, models.dimension_judge, key, models.partitions, concurrency=models.concurrency)

    verdicts = store.append_slices("gold_verdicts", rows, key, judged, models.slices)
    dimensions = store.append_slices("gold_dimensions", rows, key, checked, models.slices)
    scored = calibrate.judged_goldens(rows, verdicts, dimensions, key).withColumnsRenamed({"id": "test_id", "actual_dag": "dag"})
    results = store.replace("calibration_results", calibrate.calibration_results(scored))
    headline = calibrate.calibration_run(results).withColumns({
        "judge_model": F.lit(judge_model), "timestamp": F.localtimestamp(), "report_path": F.lit(report_path), "id": F.expr("uuid()")})
    headline = history.whole_rows(headline, schemas.CALIBRATION_RUNS, key="id")
    return {
        "results": results, "tiers": calibrate.calibration_by_tier(results),
        "issues": store.replace("calibration_issues", calibrate.calibration_issues(results)),
        "runs": store.append("calibration_runs", headline),
    }


def attack(store: Store, prompts: DataFrame, targets: DataFrame, models: Models,
           verdict: Callable) -> dict[str, DataFrame]:
    """Send attacks to every target (run_id, system_prompt, and what else its history row is to say:
    role, model, provider, mode, prompt_source, report_path) and rate how it held.

    `verdict(question, response, criterion, prompt)` returns (score, reason), 1 for a
    resisted attack; the criterion is the vulnerability.
    """
    key = ("run_id", "test_id")
    attacks = redteam.pick_attacks(prompts).withColumn(
        "test_id", F.concat_ws("|", "vulnerability", "vulnerability_type", F.col("prompt_id").cast("string")))
    # The same attacks meet every target: five vulnerability types with `per_type` attacks each, one
    # row per target and attack number first, whose text then comes by that number.
    numbered = store.replace("attacks", attacks.withColumn("_no", F.row_number().over(Window.orderBy("test_id"))).select(
        "_no", "test_id", "vulnerability", "vulnerability_type", "attack", F.col("input").alias("question")))
    numbers = F.sequence(F.lit(1), F.lit(max(numbered.count(), 1)))
    work = targets.select("run_id", "system_prompt", F.explode(numbers).alias("_no")).join(numbered, "_no").drop("_no")
    calls = store.append_slices("attack_calls", work, key, lambda pending: apply.generate_responses(
        pending, models.responder, key, models.partitions, concurrency=models.concurrency), models.slices)
    answered = work.join(calls.select(*key, "response", F.col("error").alias("call_error")), list(key)).withColumn(
        "criterion", F.col("vulnerability")).withColumn("judge_prompt", F.lit(""))
    verdicts = store.append_slices("attack_verdicts", answered.filter(F.col("call_error").isNull()), key, lambda pending: apply.judge_criteria(
        pending, verdict, key, models.partitions, concurrency=models.concurrency), models.slices)
    cases = answered.join(verdicts, list(key), "left").select(
        *key, "vulnerability", "vulnerability_type", "attack", F.col("question").alias("input"), F.col("response").alias("output"),
        F.lit(None).cast("array<struct<role:string,content:string>>").alias("turns"), "score",
        F.col("explanation").alias("reason"),
        F.coalesce("call_error", F.when(F.col("errored"), F.col("explanation"))).alias("error"))
    cleaned = store.replace("attack_cases", redteam.clean_red_team_cases(cases))
    overview = redteam.red_team_overview(cleaned, ("run_id",))
    rows = history.red_team_rows(overview, redteam.red_team_overall(overview, ("run_id",))).withColumn(
        "category_scores", F.to_json("category_scores")).withColumn("timestamp", F.localtimestamp())
    said = [c for c in ("role", "model", "provider", "mode", "prompt_source", "report_path") if c in targets.columns]
    rows = rows.join(targets.select("run_id", *said), "run_id", "left")
    return {"cases": cleaned, "overview": overview,
            "history": store.append("history", history.whole_rows(store.pending("history", rows, ("run_id",))), "run_type")}
