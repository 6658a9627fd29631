"""Text helpers built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .numeric import col


WHITESPACE = " \t\n\r\x0b\x0c"  # Spark's trim alone removes spaces only


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*columns: str | Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def normalize_slug(c: str | Column) -> Column:
    return F.translate(F.lower(strip(c)), " -", "__")


def base_slug(c: str | Column) -> Column:
    return F.replace(col(c), F.lit(fv.WEAK_SUFFIX), F.lit(""))


def word_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != "")).cast("bigint")


def filled_lines(c: str | Column, limit: int | None = None) -> Column:
    """Trimmed non-blank lines of a text box, optionally only the first few."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")
    return F.slice(lines, 1, limit) if limit else lines


def short_hash(c: str | Column) -> Column:
    """First 8 hex digits of the MD5; an empty or missing text has an empty hash."""
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.lit("")).otherwise(F.substring(F.md5(col(c)), 1, 8))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), r"[/\\]"), -1)


def fill(template: str, **values: Column) -> Column:
    """Put columns into a `{name}` template as one concat."""
    parts, rest = [], template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(values[rest[start + 1:end]])
        rest = rest[end + 1:]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def is_transient(error: str | Column) -> Column:
    return F.lower(col(error)).rlike("|".join(fv.TRANSIENT_MARKERS))


def match_price(model_id: str | Column, mode: str = "longest", table: list | None = None) -> Column:
    """Struct(model_key, input_per_million, output_per_million) of the matching price row.

    A price matches when its key is part of the lower-cased model id. `longest` takes the
    longest such key; `first` takes the first in table order, which prices a mini model as
    its larger sibling. The table is a short constant, so the match is one expression
    inside the scan stage, not a join.
    """
    rows = list(table if table is not None else fv.COST_TABLE)
    if mode == "longest":
        rows.sort(key=lambda r: -len(r[0]))
    elif mode != "first":
        raise ValueError(f"unknown mode {mode!r}")

    def price(key, cost_in, cost_out):
        return F.struct(
            F.lit(key).cast("string").alias("model_key"),
            F.lit(float(cost_in)).alias("input_per_million"),
            F.lit(float(cost_out)).alias("output_per_million"),
        )

    model = F.lower(col(model_id))
    chain = None
    for row in rows:
        hit = model.contains(row[0])
        chain = F.when(hit, price(*row)) if chain is None else chain.when(hit, price(*row))
    none = price(None, 0.0, 0.0)
    return none if chain is None else chain.otherwise(none)


def call_cost(model_id, input_tokens, output_tokens, mode: str = "longest", table: list | None = None) -> Column:
    price = match_price(model_id, mode, table)
    return (
        col(input_tokens) * price["input_per_million"] + col(output_tokens) * price["output_per_million"]
    ) / F.lit(1000000.0)
