"""A/B comparison of two runs.

Both sides are stacked with a side column and compared in one aggregation per level, so
each table is read and shuffled once and a side that lacks a row needs no outer join.
The pair key says which run A meets which run B; one job compares any number of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels, text
from ..functions.numeric import half_up

PAIR = ("pair_id",)


def stack_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B")))


def _side(side: str, value: str | Column) -> Column:
    return F.max(F.when(F.col("side") == side, F.col(value) if isinstance(value, str) else value))


def _with_delta(df: DataFrame, a: str, b: str, digits: int = 1) -> DataFrame:
    return df.withColumn("delta", half_up(F.col(b) - F.col(a), digits)).withColumn("direction", labels.direction("delta"))


def ab_overall(runs: DataFrame, by=PAIR) -> DataFrame:
    """Overall score and grade of both sides and the gain of B over A."""
    both = runs.groupBy(*by).agg(
        _side("A", "overall_pct").alias("a_pct"), _side("B", "overall_pct").alias("b_pct"),
        _side("A", "grade").alias("a_grade"), _side("B", "grade").alias("b_grade"),
    )
    return _with_delta(both.filter(F.col("a_pct").isNotNull() & F.col("b_pct").isNotNull()), "a_pct", "b_pct")


def ab_categories(categories: DataFrame, by=PAIR) -> DataFrame:
    """All categories of either side; a missing side counts as 0."""
    both = categories.groupBy(*by, "category").agg(
        F.coalesce(_side("A", "category_pct"), F.lit(0.0)).alias("a_pct"),
        F.coalesce(_side("B", "category_pct"), F.lit(0.0)).alias("b_pct"),
    )
    return _with_delta(both, "a_pct", "b_pct")


def ab_tests(tests: DataFrame, by=PAIR) -> DataFrame:
    """All tests of either side. Order: tests of A in suite order, then those only in B."""
    in_a = F.count(F.when(F.col("side") == "A", F.lit(1)))
    both = tests.groupBy(*by, "test_id").agg(
        F.coalesce(_side("A", "score_pct"), F.lit(0.0)).alias("a_pct"),
        F.coalesce(_side("B", "score_pct"), F.lit(0.0)).alias("b_pct"),
        F.coalesce(_side("A", "category"), _side("B", "category")).alias("category"),
        F.when(in_a > 0, 0).otherwise(1).alias("order_side"),
        F.coalesce(_side("A", "test_seq"), _side("B", "test_seq")).alias("order_seq"),
    )
    return _with_delta(both, "a_pct", "b_pct")


def ab_criteria(criteria: DataFrame, by=PAIR) -> DataFrame:
    """Criteria at the same position of a test that both sides have; text from A."""
    both = criteria.groupBy(*by, "test_id", "criterion_seq").agg(
        _side("A", "score").alias("a_score"), _side("B", "score").alias("b_score"), _side("A", "text").alias("text"),
    )
    both = both.filter(F.col("a_score").isNotNull() & F.col("b_score").isNotNull())
    return _with_delta(both, "a_score", "b_score", 2)


def ab_wins(deltas: DataFrame, level: str, by=PAIR) -> DataFrame:
    """How many rows of a comparison went up, down or stayed equal."""
    return deltas.groupBy(*by, "direction").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(level))


def pair_ab_history(runs: DataFrame) -> DataFrame:
    """History rows of comparisons side by side. Both rows of a comparison share one report
    path; the newest of each side counts, and a comparison with one side only is kept."""
    newest = F.struct(
        F.col("id"), F.col("timestamp"), F.col("role"),
        F.coalesce(F.nullif("consolidated_pct", F.lit(0.0)), F.nullif("overall_pct", F.lit(0.0)), F.lit(0.0)).alias("score"),
        text.first_filled("consolidated_grade", "grade").alias("grade"),
        text.first_filled("notes", "model").alias("label"),
    )

    def side(kind):
        return F.max(F.when(F.col("run_type") == kind, newest))

    return (
        runs.filter(F.col("run_type").isin("comparison_A", "comparison_B"))
        .groupBy("report_path")
        .agg(side("comparison_A").alias("a"), side("comparison_B").alias("b"))
        .select(
            "report_path",
            F.coalesce("a.timestamp", "b.timestamp").alias("timestamp"),
            F.coalesce("a.role", "b.role").alias("role"),
            F.col("a.label").alias("a_label"), F.col("a.score").alias("a_score"), F.col("a.grade").alias("a_grade"),
            F.col("b.label").alias("b_label"), F.col("b.score").alias("b_score"), F.col("b.grade").alias("b_grade"),
            half_up(F.coalesce("b.score", F.lit(0.0)) - F.coalesce("a.score", F.lit(0.0)), 1).alias("delta"),
        )
    )
