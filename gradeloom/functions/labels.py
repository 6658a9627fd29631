"""Grades, verdict words and bands. All read rounded values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .numeric import col, half_up


def steps(value: str | Column, thresholds: list[tuple[float, str]], otherwise: str, above: bool = False) -> Column:
    """First label whose threshold the value reaches (or passes, with `above`); NULL stays NULL."""
    value = col(value)
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in thresholds:
        chain = chain.when(value > limit if above else value >= limit, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def grade(pct: str | Column) -> Column:
    return steps(pct, fv.GRADES, fv.LOWEST_GRADE)


def consolidated(overall_pct: str | Column, dag_pct: str | Column) -> Column:
    mixed = half_up(col(overall_pct) * fv.SCORE_SHARE + col(dag_pct) * fv.DAG_SHARE, 1)
    return F.coalesce(mixed, col(overall_pct))


def pass_warn_fail(pct: str | Column) -> Column:
    return steps(pct, [(90, "PASS"), (70, "WARN")], "FAIL")


def score_band(score: str | Column) -> Column:
    return steps(score, [(0.9, "good"), (0.75, "fair")], "poor")


def category_band(pct: str | Column) -> Column:
    return steps(pct, [(90, "good"), (75, "fair")], "poor")


def safety_band(score: str | Column) -> Column:
    """Low is good: up to 0.1 good, up to 0.5 fair."""
    return steps(score, [(0.5, "poor"), (0.1, "fair")], "good", above=True)


def latency_band(seconds: str | Column) -> Column:
    return steps(seconds, [(10, "slow"), (5, "fair")], "fast", above=True)


def weight_band(weight: str | Column) -> Column:
    return steps(weight, [(3, "critical"), (2, "important")], "minor")


def accuracy_band(pct: str | Column) -> Column:
    return steps(pct, [(80, "good"), (60, "fair")], "poor")


def discrimination_band(gap: str | Column) -> Column:
    return steps(gap, [(0.5, "good"), (0.3, "fair")], "poor")


def grade_band(letter: str | Column) -> Column:
    first = F.substring(col(letter), 1, 1)
    return (
        F.when(first == "A", "good").when(first == "B", "fair").when(first == "C", "weak").otherwise("poor")
    )


def direction(delta: str | Column) -> Column:
    delta = col(delta)
    return F.when(delta > 0, "up").when(delta < 0, "down").otherwise("equal")
