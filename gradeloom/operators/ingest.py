"""Test suites: validation, defaults, clean-up of imported cases, merging, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv, text
from .spread import smallest_n


class SuiteError(ValueError):
    """A suite has cases that cannot be evaluated."""


def _issue(condition, severity: str, rule: str, message):
    return F.when(
        condition, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))
    )


def _rows(cases: DataFrame, issues: list) -> DataFrame:
    return cases.select("role_slug", "test_seq", "test_id", F.explode(F.array_compact(F.array(*issues))).alias("_i")).select(
        "role_slug", "test_seq", "test_id", "_i.*"
    )


def suite_violations(cases: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """One row per broken rule. With `roles`, a role without any case is reported too."""
    name = F.coalesce(F.col("test_id"), F.col("test_seq").cast("string"))
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(label))
        for c, label in [("test_id", "id"), ("question", "question"), ("criteria", "criteria")]
    ]))
    blank = F.filter(
        F.transform("criteria", lambda x, i: F.when(text.strip(F.coalesce(x, F.lit(""))) == "", i + 1)), lambda x: x.isNotNull()
    )
    found = _rows(cases, [
        _issue(F.size(missing) > 0, "error", "missing_field",
               F.concat(F.lit("Test case #"), F.col("test_seq").cast("string"), F.lit(": missing required fields: "),
                        F.array_join(missing, ", "))),
        _issue(text.strip("question") == "", "error", "blank_question",
               F.concat(F.lit("Test case '"), name, F.lit("': question must be a non-empty string"))),
        _issue(F.size("criteria") == 0, "error", "empty_criteria",
               F.concat(F.lit("Test case '"), name, F.lit("': criteria must be a non-empty list"))),
        _issue(F.size(blank) > 0, "error", "blank_criterion",
               F.concat(F.lit("Test '"), name, F.lit("': criterion #"),
                        F.array_join(F.transform(blank, lambda i: i.cast("string")), ", #"),
                        F.lit(" must be a non-empty string"))),
    ])
    if roles is None:
        return found
    empty = roles.select("role_slug").distinct().join(cases.select("role_slug"), "role_slug", "left_anti").select(
        "role_slug", F.lit(None).cast("bigint").alias("test_seq"), F.lit(None).cast("string").alias("test_id"),
        F.lit("error").alias("severity"), F.lit("empty_suite").alias("rule"),
        F.lit("Test suite is empty — no test cases to evaluate.").alias("message"),
    )
    return found.withColumn("test_seq", F.col("test_seq").cast("bigint")).unionByName(empty)


def suite_warnings(cases: DataFrame) -> DataFrame:
    """Absent category or weight, and more criteria than recommended."""
    name = F.coalesce(F.col("test_id"), F.col("test_seq").cast("string"))
    test = F.concat(F.lit("Test '"), name)
    return _rows(cases, [
        _issue(F.col("category").isNull(), "warning", "no_category",
               F.concat(test, F.lit("': no category — will be grouped as 'General'"))),
        _issue(F.col("weight").isNull(), "warning", "no_weight",
               F.concat(test, F.lit("': no weight — defaulting to 2"))),
        _issue(F.size("criteria") > fv.MAX_CRITERIA, "warning", "many_criteria",
               F.concat(test, F.lit("': "), F.size("criteria").cast("string"), F.lit(" criteria (max recommended: 5)"))),
    ])


def fail_fast(cases: DataFrame, roles: DataFrame | None = None) -> None:
    """Raise on the first violation found; one row at most reaches the driver."""
    first = suite_violations(cases, roles).limit(1).collect()
    if first:
        raise SuiteError(first[0]["message"])


def apply_defaults(cases: DataFrame) -> DataFrame:
    """Absent (NULL) category and weight get their defaults; empty values stay."""
    return cases.withColumn("category", F.coalesce("category", F.lit(fv.DEFAULT_CATEGORY))).withColumn(
        "weight", F.coalesce("weight", F.lit(fv.DEFAULT_WEIGHT))
    )


def normalize_generated(cases: DataFrame) -> DataFrame:
    """Generated cases are flagged for review and never lack criteria or a weight."""
    return (
        cases.withColumn("generated", F.lit(True))
        .withColumn("needs_review", F.lit(True))
        .withColumn("criteria", F.coalesce("criteria", F.array(F.lit(fv.REVIEW_PLACEHOLDER))))
        .withColumn("weight", F.coalesce("weight", F.lit(fv.DEFAULT_WEIGHT)))
    )


def import_clean(cases: DataFrame) -> DataFrame:
    """Defaults by position for imported cases, at most five criteria, empty context dropped."""
    return cases.select(
        *[c for c in ("role_slug",) if c in cases.columns],
        "test_seq",
        F.coalesce("test_id", F.format_string("GEN-%02d", "test_seq")).alias("test_id"),
        F.coalesce("category", F.lit(fv.DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.slice(F.coalesce("criteria", F.array().cast("array<string>")), 1, fv.MAX_CRITERIA).alias("criteria"),
        F.coalesce("weight", F.lit(fv.DEFAULT_WEIGHT)).alias("weight"),
        F.when(F.size("context") > 0, F.col("context")).alias("context"),
    )


def merge_suite(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing cases plus the incoming ones with a new id; the first of repeated ids wins.

    New cases come after the existing ones: their sequence starts past the largest existing
    number and keeps the incoming order (with gaps where a case was skipped). An incoming
    case without an id is named by that number.
    """
    last = existing.groupBy("role_slug").agg(F.max("test_seq").alias("_last"))
    shifted = (
        incoming.join(last, "role_slug", "left")
        .withColumn("test_seq", (F.coalesce("_last", F.lit(0)) + F.col("test_seq")).cast("bigint"))
        .drop("_last")
    )
    new = smallest_n(import_clean(shifted), ["role_slug", "test_id"], ["test_seq"], 1).drop("rank")
    new = new.join(existing.select("role_slug", "test_id"), ["role_slug", "test_id"], "left_anti")
    return (
        existing.withColumn("added", F.lit(False))
        .withColumn("test_seq", F.col("test_seq").cast("bigint"))
        .unionByName(new.withColumn("added", F.lit(True)), allowMissingColumns=True)
    )


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("role_slug").agg(
        F.count(F.when(F.col("added"), F.lit(1))).alias("added"), F.count(F.lit(1)).alias("total")
    )


def suite_diff(existing: DataFrame, incoming: DataFrame, keys=("role_slug", "test_id")) -> DataFrame:
    """Ids of the incoming suite, each marked as new or already known. One aggregation over
    both suites gives the semi and the anti side together."""
    ids = existing.select(*keys, F.lit(True).alias("_old")).unionByName(incoming.select(*keys, F.lit(False).alias("_old")))
    return (
        ids.groupBy(*keys)
        .agg(F.max("_old").alias("_old"), F.min("_old").alias("_all_old"))
        .filter(~F.col("_all_old"))
        .select(*keys, F.when(F.col("_old"), "known").otherwise("new").alias("status"))
    )


def explode_criteria(cases: DataFrame) -> DataFrame:
    """One row per criterion with its position from 0."""
    keep = [c for c in cases.columns if c != "criteria"]
    return cases.select(*keep, F.posexplode("criteria").alias("criterion_seq", "criterion"))


def suite_profile(cases: DataFrame, by=("role_slug",)) -> DataFrame:
    """Number of tests and criteria, distinct categories in order, tests per weight.

    Grouped by (category, weight) first, so the lists are built from distinct values only.
    """
    return (
        cases.groupBy(*by, "category", "weight")
        .agg(F.count(F.lit(1)).alias("_tests"), F.sum(F.size("criteria")).alias("_criteria"))
        .groupBy(*by)
        .agg(
            F.sum("_tests").cast("bigint").alias("num_tests"),
            F.sum("_criteria").cast("bigint").alias("num_criteria"),
            F.sort_array(F.collect_set("category")).alias("categories"),
            *[
                F.coalesce(F.sum(F.when(F.col("weight") == w, F.col("_tests"))), F.lit(0)).cast("bigint").alias(f"weight_{w}")
                for w in (1, 2, 3)
            ],
        )
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return smallest_n(df, keys, order, 1).drop("rank")


def missing_fields(present: str = "fields") -> "F.Column":
    """Required fields a case lacks."""
    return F.array_except(F.array(*[F.lit(f) for f in ("id", "question", "criteria")]), F.col(present))


def manual_case(cases: DataFrame) -> DataFrame:
    """Text boxes of a hand-written case to a test case."""
    return cases.withColumn("criteria", text.filled_lines("criteria_text", fv.MAX_CRITERIA)).withColumn(
        "context", F.when(F.size(text.filled_lines("context_text")) > 0, text.filled_lines("context_text"))
    ).drop("criteria_text", "context_text")
