"""Calling models from Spark: responses, criterion, dimension and safety verdicts.

The model client is a callable given by the user. Rows reach it in Arrow batches inside
the tasks; all rounding, counting, pricing and fallbacks happen in Spark around it. A task
that Spark repeats calls the model again for its rows, so write the result of one apply
step before the next one reads it, and start from `pending_work` on a re-run.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

import gradeloom

from ..functions import fixed_values as fv, text
from ..functions.numeric import half_up
from .scoring import dag_score_of

# Ship this package inside the task closure, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(gradeloom)

CALL_KEY = ("run_id", "test_id")
CRITERION_KEY = ("run_id", "test_id", "criterion_seq")
CALLS_AT_ONCE = 8  # rows per thread that a task hands on together

_RESPONSE = T.StructType([
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("latency_seconds", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("attempt", T.LongType()),
])
_VERDICT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("error", T.StringType()),
])


def with_retry(fn: Callable, *args, sleep: Callable = time.sleep):
    """(result, attempts, error): transient errors are tried again with doubling waits."""
    for attempt in range(1, fv.MAX_ATTEMPTS + 1):
        try:
            return fn(*args), attempt, None
        except Exception as exc:
            error = str(exc)
            transient = any(marker in error.lower() for marker in fv.TRANSIENT_MARKERS)
            if not transient or attempt == fv.MAX_ATTEMPTS:
                return None, attempt, error
            sleep(fv.FIRST_WAIT_SECONDS * 2 ** (attempt - 1))


def _apply(df: DataFrame, call: Callable, keys, inputs, outputs: T.StructType, partitions: int | None, concurrency: int = 1) -> DataFrame:
    """Keys plus the outputs of `call(*inputs)` per row. With `partitions`, rows are spread by a
    hash of their key. A task makes `concurrency` calls at the same time, each in a thread of its
    own, and hands on a few rows at once."""
    df = df.select(*keys, *[c for c in inputs if c not in keys])
    if partitions:
        df = df.repartition(partitions, *keys)
    names = [f.name for f in outputs]
    kinds = [to_arrow_type(f.dataType) for f in outputs]
    keys, inputs = list(keys), list(inputs)

    def run(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for whole in batches:
                for start in range(0, whole.num_rows, CALLS_AT_ONCE * concurrency):
                    batch = whole.slice(start, CALLS_AT_ONCE * concurrency)
                    rows = list(pool.map(lambda row: call(*row), zip(*(batch.column(c).to_pylist() for c in inputs))))
                    made = [pa.array([row[i] for row in rows], type=kind) for i, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + made, names=keys + names)

    return df.mapInArrow(run, T.StructType([df.schema[k] for k in keys] + list(outputs)))


def generate_responses(work: DataFrame, responder: Callable, keys=CALL_KEY, partitions: int | None = None,
                       sleep: Callable = time.sleep, concurrency: int = 1) -> DataFrame:
    """One call per test. `responder(system_prompt, question)` returns a dict with response,
    input_tokens, output_tokens, model_id and optionally latency_seconds.

    A failed call becomes a response that says so, with zero metrics; it is still judged.
    """

    def call(system_prompt, question):
        started = time.perf_counter()
        got, attempts, error = with_retry(responder, system_prompt or "", question, sleep=sleep)
        if error is not None:
            return fv.ERROR_RESPONSE.format(error[:200]), error, 0.0, 0, 0, "error", attempts
        latency = got.get("latency_seconds", time.perf_counter() - started)
        return (got["response"], None, float(latency), got.get("input_tokens", 0), got.get("output_tokens", 0),
                got.get("model_id", ""), attempts)

    raw = _apply(work, call, keys, ("system_prompt", "question"), _RESPONSE, partitions, concurrency)
    return with_call_metrics(raw)


def with_call_metrics(raw: DataFrame) -> DataFrame:
    """Token total, text sizes and cost of each call; zero for a failed one."""
    ok = F.col("error").isNull()
    return (
        raw.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("response_chars", F.when(ok, F.length("response")).otherwise(0).cast("bigint"))
        .withColumn("response_words", F.when(ok, text.word_count("response")).otherwise(0).cast("bigint"))
        .withColumn("estimated_cost_usd", text.call_cost("model_id", "input_tokens", "output_tokens"))
    )


def judge_criteria(work: DataFrame, judge: Callable, keys=CRITERION_KEY, partitions: int | None = None,
                   sleep: Callable = time.sleep, concurrency: int = 1) -> DataFrame:
    """Graded score of each criterion. `judge(question, response, criterion, judge_prompt)`
    returns (score, reason). A criterion whose judge failed scores 0 and counts."""

    def call(question, response, criterion, prompt):
        got, _, error = with_retry(judge, question, response, criterion, prompt, sleep=sleep)
        return (None, None, error) if error is not None else (float(got[0]), got[1], None)

    raw = _apply(work, call, keys, ("question", "response", "criterion", "judge_prompt"), _VERDICT, partitions, concurrency)
    failed = F.col("error").isNotNull()
    return raw.select(
        *keys,
        F.when(failed, F.lit(0.0)).otherwise(half_up("score", 2)).alias("score"),
        F.when(failed, F.concat(F.lit("GEval error: "), F.substring("error", 1, 200)))
        .otherwise(F.coalesce(text.blank_to_null("reason"), F.lit("No explanation provided."))).alias("explanation"),
        failed.alias("errored"),
    )


def judge_dimensions(work: DataFrame, judge: Callable, keys=CRITERION_KEY, partitions: int | None = None,
                     sleep: Callable = time.sleep, concurrency: int = 1) -> DataFrame:
    """Four yes/no checks per criterion in one map, and the weighted dag score.

    `judge(question, response, criterion, dimension, asked)` returns a score, passed from 0.5;
    `asked` is the dimension's question about the criterion, with the role's domain. A dimension
    whose judge failed counts as not passed.
    """
    names = list(fv.DIMENSION_WEIGHTS)
    schema = T.StructType([T.StructField("_raw", T.ArrayType(T.DoubleType()))])

    def call(question, response, criterion, domain):
        scores = []
        for name in names:
            asked = fv.DIMENSION_QUESTIONS[name].format(criterion=criterion, domain=domain or "")
            got, _, error = with_retry(judge, question, response, criterion, name, asked, sleep=sleep)
            scores.append(None if error is not None else float(got))
        return (scores,)

    if "domain" not in work.columns:
        work = work.withColumn("domain", F.lit(""))
    raw = _apply(work, call, keys, ("question", "response", "criterion", "domain"), schema, partitions, concurrency)
    entries = []
    for i, name in enumerate(names):
        score = F.coalesce(F.col("_raw")[i], F.lit(0.0))
        entries += [F.lit(name), F.struct(half_up(score, 2).alias("score"), (score >= 0.5).alias("passed"))]
    return raw.select(*keys, F.create_map(*entries).alias("dag_dimensions")).withColumn(
        "dag_score", dag_score_of("dag_dimensions")
    )


def safety_work(responses: DataFrame) -> DataFrame:
    """One row per response and metric; hallucination only where there is context."""
    always = [m for m in fv.SAFETY_METRICS if m != "hallucination"]
    context = F.coalesce(F.size("context") > 0, F.lit(False)) if "context" in responses.columns else F.lit(False)
    metrics = F.concat(
        F.array(*[F.lit(m) for m in always]),
        F.when(context, F.array(F.lit("hallucination"))).otherwise(F.array().cast("array<string>")),
    )
    return responses.withColumn("metric", F.explode(metrics))


def judge_safety(work: DataFrame, judge: Callable, keys=("run_id", "test_id", "metric"), partitions: int | None = None,
                 sleep: Callable = time.sleep, concurrency: int = 1) -> DataFrame:
    """`judge(metric, question, response)` returns (score, reason), 0 safe to 1 unsafe; the hallucination
    check also gets the test's context, as a fourth value. Passed is decided on the unrounded score;
    a failed check has no score and is not passed."""
    told = F.array_join("context", "\n") if "context" in work.columns else F.lit("")
    work = work.withColumn("context_text", F.when(F.col("metric") == "hallucination", told).otherwise(F.lit("")))

    def call(metric, question, response, context_text):
        told = (context_text or "",) if metric == "hallucination" else ()
        got, _, error = with_retry(judge, metric, question, response, *told, sleep=sleep)
        return (None, None, error) if error is not None else (float(got[0]), got[1], None)

    raw = _apply(work, call, keys, ("metric", "question", "response", "context_text"), _VERDICT, partitions, concurrency)
    return raw.select(
        *keys,
        half_up("score", 2).alias("score"),
        F.coalesce(F.col("score") <= fv.SAFETY_LIMIT, F.lit(False)).alias("passed"),
        F.coalesce("reason", F.concat(F.lit("Error: "), F.substring("error", 1, 150)), F.lit("")).alias("reason"),
    )


def align_verdicts(criteria: DataFrame, verdicts: DataFrame, keys=CRITERION_KEY) -> DataFrame:
    """Every criterion with its verdict; a criterion without one scores 0."""
    return (
        criteria.join(verdicts, list(keys), "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .withColumn("explanation", F.coalesce("explanation", F.lit("Not evaluated")))
    )


def pending_work(work: DataFrame, done: DataFrame, keys=CRITERION_KEY) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def retry_policy(calls: DataFrame) -> DataFrame:
    """What happens to each call: whether its error may pass, whether it is tried again, and
    how long to wait before. The same rules as `with_retry`, for calls kept in a table."""
    transient = F.coalesce(text.is_transient("error"), F.lit(False))
    again = transient & (F.col("attempt") < fv.MAX_ATTEMPTS)
    wait = (F.pow(F.lit(2.0), F.col("attempt") - 1) * fv.FIRST_WAIT_SECONDS).cast("bigint")
    return calls.withColumns({"transient": transient, "retry": again, "delay_seconds": F.when(again, wait)})


def retry_worklist(calls: DataFrame, keys=CALL_KEY) -> DataFrame:
    """Calls whose latest attempt failed for a passing reason and may be tried again."""
    latest = calls.groupBy(*keys).agg(F.max(F.struct("attempt", "error")).alias("_l"))
    latest = latest.select(*keys, F.col("_l.attempt").alias("attempt"), F.col("_l.error").alias("error"))
    return retry_policy(latest).filter("retry").drop("transient", "retry")
