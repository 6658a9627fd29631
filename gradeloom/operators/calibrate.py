"""Judge calibration against gold items with known scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import exact_avg, half_up, percent, whole_percent


def all_goldens(built_in: DataFrame, generated: DataFrame) -> DataFrame:
    return built_in.unionByName(generated, allowMissingColumns=True)


def explode_goldens(goldens: DataFrame) -> DataFrame:
    """One row per gold item and criterion with its expected score."""
    keep = [c for c in goldens.columns if c not in ("criteria", "expected_scores")]
    pairs = F.posexplode(F.arrays_zip("criteria", "expected_scores"))
    return goldens.select(*keep, pairs.alias("criterion_seq", "_p")).select(
        *keep, "criterion_seq", F.col("_p.criteria").alias("criterion"), F.col("_p.expected_scores").alias("expected")
    )


def judged_goldens(rows: DataFrame, verdicts: DataFrame, dimensions: DataFrame, keys) -> DataFrame:
    """Gold rows with the judge's score (`geval`) and, from the verdicts on the dimensions, the dag score
    (`actual_dag`); either is NULL where the judge gave none."""
    keys = list(keys)
    return (
        rows.join(verdicts.select(*keys, F.col("score").alias("geval")), keys, "left")
        .join(dimensions.select(*keys, F.col("dag_score").alias("actual_dag")), keys, "left")
    )


def calibration_results(rows: DataFrame) -> DataFrame:
    """Deviation of the judge's score (`geval`) from the expected one; within 0.25 passes.
    Compared as decimals, so that exactly 0.25 passes."""
    decimal = "decimal(12,6)"
    actual = F.coalesce("geval", F.lit(0.0))
    deviation = F.abs(F.col("expected").cast(decimal) - actual.cast(decimal))
    return (
        rows.withColumn("geval", actual)
        .withColumn("deviation", deviation.cast("double"))
        .withColumn("passed", deviation <= F.lit(fv.TOLERANCE).cast(decimal))
    )


def calibration_metrics(results: DataFrame, by=()) -> DataFrame:
    """Accuracy, mean deviation and counts. Only sums leave the tasks."""
    n = F.count(F.lit(1))
    passed = F.count(F.when(F.col("passed"), F.lit(1)))
    return results.groupBy(*by).agg(
        F.coalesce(percent(passed, n), F.lit(0.0)).alias("accuracy"),
        F.coalesce(half_up(exact_avg("deviation"), 3), F.lit(0.0)).alias("avg_deviation"),
        n.alias("total_tests"), passed.alias("passed"), (n - passed).alias("failed"),
    )


def _tier(quality: str):
    return F.when(F.col("quality") == quality, F.col("geval"))


def calibration_tiers(results: DataFrame, by=()) -> DataFrame:
    """Mean score of each quality tier as columns, 0 for an empty tier."""
    return results.groupBy(*by).agg(*[
        F.coalesce(half_up(exact_avg(_tier(q)), 2), F.lit(0.0)).alias(f"avg_{q}") for q, *_ in fv.GOLD_TIERS
    ])


def calibration_by_tier(results: DataFrame, by=()) -> DataFrame:
    """The same, one row per tier; an empty tier is listed with 0."""
    wide = calibration_tiers(results, by)
    tiers = F.array(*[
        F.struct(F.lit(q).alias("quality"), F.col(f"avg_{q}").alias("avg_geval")) for q, *_ in fv.GOLD_TIERS
    ])
    return wide.select(*by, F.inline(tiers))


def discrimination(results: DataFrame, by=()) -> DataFrame:
    """Gap between the unrounded means of excellent and poor items, 0 when one is empty."""
    gap = exact_avg(_tier("excellent")) - exact_avg(_tier("poor"))
    return results.groupBy(*by).agg(F.coalesce(half_up(gap, 2), F.lit(0.0)).alias("discrimination"))


def calibration_issues(results: DataFrame) -> DataFrame:
    """Scores that contradict the tier of their item, with a text line."""
    score, quality = F.col("geval"), F.col("quality")
    tail = F.concat(whole_percent("geval"), F.lit(" on '"), F.substring("criterion", 1, 50), F.lit("'"))

    def issue(wording):
        return F.concat(F.col("test_id").cast("string"), F.lit(f": {wording} "), tail)

    line = (
        F.when((quality == "excellent") & (score < 0.5), issue("Excellent response scored only"))
        .when((quality == "poor") & (score > 0.5), issue("Poor response scored"))
        .when((quality == "misleading") & (score > 0.3), issue("Misleading response scored"))
    )
    return results.withColumn("issue", line).filter(F.col("issue").isNotNull())


def calibration_run(results: DataFrame, by=()) -> DataFrame:
    """The headline row of a calibration run: all figures from one pass over the results."""
    n = F.count(F.lit(1))
    passed = F.count(F.when(F.col("passed"), F.lit(1)))
    score, quality = F.col("geval"), F.col("quality")
    is_issue = (
        ((quality == "excellent") & (score < 0.5)) | ((quality == "poor") & (score > 0.5))
        | ((quality == "misleading") & (score > 0.3))
    )
    gap = exact_avg(_tier("excellent")) - exact_avg(_tier("poor"))
    return results.groupBy(*by).agg(
        F.coalesce(percent(passed, n), F.lit(0.0)).alias("accuracy"),
        F.coalesce(half_up(gap, 2), F.lit(0.0)).alias("discrimination"),
        F.coalesce(half_up(exact_avg("deviation"), 3), F.lit(0.0)).alias("avg_deviation"),
        n.alias("total_tests"), passed.alias("passed"), (n - passed).alias("failed"),
        F.count(F.when(is_issue, F.lit(1))).alias("issues_count"),
        *[F.coalesce(half_up(exact_avg(_tier(q)), 2), F.lit(0.0)).alias(f"avg_{q}") for q, *_ in fv.GOLD_TIERS],
    )
