"""Criterion verdicts to test, category and run scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, labels
from ..functions.numeric import col, exact_avg, exact_sum, half_up, mean_of_units, share, units
from .spread import smallest_n

TEST_KEY = ("run_id", "test_id")
DIMENSIONS_TYPE = "map<string,struct<score:double,passed:boolean>>"


def test_scores(criteria: DataFrame, tests: DataFrame | None = None, keys=TEST_KEY) -> DataFrame:
    """Unweighted mean of the criterion scores of each test, and of its dag scores.

    With `tests` (one row per test, holding the keys) a test without criteria scores 0.
    The dag score is NULL when no criterion has one.
    """
    sums = criteria.groupBy(*keys).agg(
        F.sum(units(F.coalesce("score", F.lit(0.0)))).alias("_units"),
        F.count(F.lit(1)).alias("num_criteria"),
        F.sum(units("dag_score")).alias("_dag_units"),
        F.count("dag_score").alias("_num_dag"),
    )
    if tests is not None:
        sums = tests.join(sums, list(keys), "left").withColumn("num_criteria", F.coalesce("num_criteria", F.lit(0)))
    score = F.coalesce(mean_of_units(F.col("_units"), F.col("num_criteria")), F.lit(0.0))
    return (
        sums.withColumn("score", score)
        .withColumn("dag_score", mean_of_units(F.col("_dag_units"), F.col("_num_dag")))
        .withColumn("score_pct", half_up(F.col("score") * 100, 1))
        .withColumn("dag_score_pct", half_up(F.col("dag_score") * 100, 1))
        .drop("_units", "_dag_units", "_num_dag")
    )


def with_cases(scores: DataFrame, cases: DataFrame, on=("test_id",)) -> DataFrame:
    """Add category and weight of each test."""
    return scores.join(cases.select(*on, "category", "weight"), list(on))


def run_scores(tests: DataFrame, by=("run_id",)) -> DataFrame:
    """Weighted run score, dag score over the tests that have one, grades and counts.

    `tests` holds score, dag_score, weight and num_criteria per test.
    """
    weight = F.col("weight")
    has_dag = F.col("dag_score").isNotNull()
    sums = tests.groupBy(*by).agg(
        exact_sum(F.col("score") * weight).alias("_scored"),
        F.sum(weight).cast("bigint").alias("_weight"),
        exact_sum(F.when(has_dag, F.col("dag_score") * weight)).alias("_dag_scored"),
        F.sum(F.when(has_dag, weight)).cast("bigint").alias("_dag_weight"),
        F.count(F.lit(1)).alias("num_tests"),
        F.sum("num_criteria").cast("bigint").alias("num_criteria"),
    )
    return (
        sums.withColumn("overall_score", F.coalesce(share(F.col("_scored"), F.col("_weight")), F.lit(0.0)))
        .withColumn("overall_pct", half_up(F.col("overall_score") * 100, 1))
        .withColumn("dag_pct", half_up(share(F.col("_dag_scored"), F.col("_dag_weight")) * 100, 1))
        .withColumn("grade", labels.grade("overall_pct"))
        .withColumn("consolidated_pct", labels.consolidated("overall_pct", "dag_pct"))
        .withColumn("consolidated_grade", labels.grade("consolidated_pct"))
        .drop("_scored", "_weight", "_dag_scored", "_dag_weight")
    )


def category_scores(tests: DataFrame, by=("run_id",)) -> DataFrame:
    """Unweighted mean of the test scores of each category; also the unrounded mean and,
    where tests are numbered, the first test of the category."""
    first = [F.min("test_seq").alias("first_seq")] if "test_seq" in tests.columns else []
    return (
        tests.groupBy(*by, "category")
        .agg(
            exact_avg("score").alias("category_score"),
            exact_avg("dag_score").alias("_dag"),
            F.count(F.lit(1)).alias("num_tests"),
            *first,
        )
        .withColumn("category_pct", half_up(F.col("category_score") * 100, 1))
        .withColumn("category_dag_pct", half_up(F.col("_dag") * 100, 1))
        .drop("_dag")
    )


def category_map(categories: DataFrame, by=("run_id",)) -> DataFrame:
    """One map category -> pct per run; its size is the number of categories of the run."""
    entries = F.sort_array(F.collect_list(F.struct("category", "category_pct")))
    return categories.groupBy(*by).agg(F.map_from_entries(entries).alias("category_scores"))


def dag_score_of(dimensions: str | Column) -> Column:
    """Weighted share of passed dimensions, two decimals. A dimension that failed to run is
    stored as not passed and keeps its weight, so no group-by is needed: the four verdicts
    of a criterion sit in one map."""
    dims = col(dimensions)
    total = F.lit(0)
    for name, weight in fv.DIMENSION_WEIGHTS.items():
        passed = F.coalesce(F.try_element_at(dims, F.lit(name))["passed"], F.lit(False))
        total = total + F.when(passed, F.lit(weight)).otherwise(F.lit(0))
    score = half_up(total.cast("double") / F.lit(float(sum(fv.DIMENSION_WEIGHTS.values()))), 2)
    return F.when(dims.isNotNull(), score)


def dag_criterion_scores(verdicts: DataFrame, keys) -> DataFrame:
    """The same score from one row per (criterion, dimension)."""
    weight = F.lit(0)
    for name, w in fv.DIMENSION_WEIGHTS.items():
        weight = F.when(F.col("dimension") == name, F.lit(w)).otherwise(weight)
    passed = F.coalesce(F.col("passed"), F.lit(False))
    return (
        verdicts.groupBy(*keys)
        .agg(
            F.sum(F.when(passed, weight).otherwise(F.lit(0))).alias("_passed"),
            F.sum(weight).alias("_all"),
        )
        .select(*keys, half_up(share(F.col("_passed"), F.col("_all")), 2).alias("dag_score"))
    )


def weakest_criteria(criteria: DataFrame, n: int = 5, by=("run_id",), ties=("test_seq", "criterion_seq")) -> DataFrame:
    """The n lowest scores of each run, ties in suite order."""
    return smallest_n(criteria, list(by), ["score", *ties], n)


def category_report(categories: DataFrame) -> DataFrame:
    """Category scores as a console listing shows them."""
    return categories.orderBy("run_id", "category")
