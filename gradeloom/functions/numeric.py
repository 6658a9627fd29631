"""The numeric contract: sums that do not depend on row order, and half-up rounding.

Scores and latencies are doubles, whose plain sum differs with the order of the rows. Sums
therefore run over decimals or whole units, and rounding runs over a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = 1_000_000  # whole units in a score of 1.0; scores carry two decimals


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(c: str | Column) -> Column:
    """A score as a whole number of millionths: cheap to sum on the largest tables."""
    return F.floor(col(c) * F.lit(float(UNITS)) + F.lit(0.5))


def mean_of_units(total: Column, n: Column) -> Column:
    return total.cast("double") / F.nullif(n * F.lit(UNITS), F.lit(0)).cast("double")


def exact_sum(c: str | Column) -> Column:
    return F.sum(col(c).cast("decimal(20,12)")).cast("double")


def exact_avg(c: str | Column) -> Column:
    """Mean of the non-null values, NULL when there is none."""
    return exact_sum(c) / F.nullif(F.count(col(c)), F.lit(0))


def half_up(c: str | Column, digits: int) -> Column:
    return F.round(col(c).cast("decimal(18,9)"), digits).cast("double")


def half_up_wide(c: str | Column, digits: int) -> Column:
    """As `half_up`, for totals that may pass a thousand million."""
    return F.round(col(c).cast("decimal(32,9)"), digits).cast("double")


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL for an empty whole."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return half_up(share(part, whole) * 100, digits)


def whole_percent(score: str | Column) -> Column:
    """Score 0..1 as a text like 65%."""
    return F.concat(half_up(col(score) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def one_decimal(pct: str | Column) -> Column:
    """A percentage that is already rounded, as text."""
    return F.format_string("%.1f", col(pct))
