"""Run history: queries over written runs and the views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import fixed_values as fv, labels, text
from ..functions.numeric import one_decimal


def whole_rows(rows: DataFrame, columns: str = schemas.EVAL_RUNS, key: str = "run_id") -> DataFrame:
    """Rows with every column of the written table and no other but the key, which is the id. What a
    run does not have is NULL. Readers and writers share this one list of columns."""
    kinds = dict(column.split(" ") for column in columns.split(", "))
    values = [F.col(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c != "id"]
    return rows.select(*([F.col(key)] if key != "id" else []), F.col(key).alias("id"), *values)


def history(runs: DataFrame, role: str | None = None, limit: int = 100) -> DataFrame:
    """Newest runs first."""
    if role:
        runs = runs.filter(F.col("role") == role)
    return runs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def run_by_id(runs: DataFrame, run_id) -> DataFrame:
    return runs.filter(F.col("id") == run_id)


def calibration_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def history_union(*tables: DataFrame) -> DataFrame:
    """Runs of all kinds in one table; columns a kind lacks are NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def split_by_run_type(runs: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind; comparison covers both sides."""
    if kind == "comparison":
        return runs.filter(F.col("run_type").startswith("comparison"))
    return runs.filter(F.col("run_type") == kind)


def history_view(runs: DataFrame) -> DataFrame:
    """Columns as a history page shows them."""
    return runs.select(
        "id", "role", "run_type",
        F.date_format("timestamp", "yyyy-MM-dd").alias("run_date"),
        F.date_format("timestamp", "HH:mm").alias("run_time"),
        F.coalesce(text.blank_to_null("model"), F.lit("demo")).alias("model"),
        "overall_pct", "dag_pct",
        F.coalesce("consolidated_pct", "overall_pct").alias("combined_pct"),
        text.first_filled("consolidated_grade", "grade").alias("combined_grade"),
        labels.grade_band(text.first_filled("consolidated_grade", "grade")).alias("grade_band"),
        labels.pass_warn_fail("overall_pct").alias("verdict"),
        text.file_name("report_path").alias("report_file"),
    )


def csv_view(runs: DataFrame, run_type: str = "") -> DataFrame:
    """History as exported to CSV: all text, blank for missing, commas in notes replaced."""
    kept = runs.filter(F.col("run_type").startswith(run_type)) if run_type else runs

    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    values = [
        shown("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), shown("role"),
        F.coalesce(text.blank_to_null("model"), F.lit("demo")), F.coalesce(text.blank_to_null("judge_model"), F.lit("-")),
        shown("overall_pct"), shown("dag_pct"), F.coalesce("consolidated_pct", "overall_pct").cast("string"),
        F.coalesce(text.first_filled("consolidated_grade", "grade"), F.lit("")), shown("num_tests"), shown("num_criteria"), shown("avg_latency"),
        shown("p95_latency"), shown("total_tokens"), shown("estimated_cost"), shown("total_elapsed"), shown("run_type"),
        F.replace(shown("notes"), F.lit(","), F.lit(";")),
    ]
    return kept.select(*[v.alias(h) for v, h in zip(values, fv.CSV_HEADERS)])


def red_team_note(rate: str = "overall_pass_rate", attacks: str = "total_attacks") -> "F.Column":
    return F.concat(F.lit("Pass rate: "), one_decimal(rate), F.lit("% | "), F.col(attacks).cast("string"), F.lit(" attacks"))


def eval_run_rows(runs: DataFrame, categories: DataFrame, perf: DataFrame, by=("run_id",)) -> DataFrame:
    """Summary rows of evaluation runs: scores, category map, latency, tokens and cost. A run
    without timed calls has zeros there."""
    from .scoring import category_map

    timed = F.coalesce("available", F.lit(False))

    def metric(name, alias, kind):
        return F.when(timed, F.col(name)).otherwise(F.lit(0)).cast(kind).alias(alias)

    keys = list(by)
    return (
        runs.join(category_map(categories, by), keys, "left")
        .join(perf, keys, "left")
        .select(
            *runs.columns, "category_scores",
            metric("avg_latency", "avg_latency", "double"), metric("p95_latency", "p95_latency", "double"),
            metric("total_tokens", "total_tokens", "bigint"), metric("estimated_cost_usd", "estimated_cost", "double"),
        )
    )


def red_team_rows(overview: DataFrame, overall: DataFrame, by=("run_id",)) -> DataFrame:
    """Summary rows of red-team runs in the shape of evaluation runs."""
    keys = list(by)
    rates = overview.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "vulnerability", F.struct("pass_rate", "total", "passed", "failed", "errored"))))).alias("category_scores")
    )
    return overall.join(rates, keys, "left").select(
        *keys, F.lit("red_team").alias("run_type"), F.lit("Red Team Assessment").alias("prompt_name"),
        F.lit("1.0").alias("prompt_version"), F.col("overall_pass_rate").alias("overall_pct"),
        labels.pass_warn_fail("overall_pass_rate").alias("grade"), F.col("total_attacks").alias("num_tests"),
        F.lit(0).cast("bigint").alias("num_criteria"), "category_scores",
        F.lit(0.0).alias("avg_latency"), F.lit(0.0).alias("p95_latency"), F.lit(0).cast("bigint").alias("total_tokens"),
        F.lit(0.0).alias("estimated_cost"), F.lit(0.0).alias("total_elapsed"), red_team_note().alias("notes"),
    )
