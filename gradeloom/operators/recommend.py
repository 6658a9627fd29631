"""Ranked recommendations and the input of prompt improvement."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed_values as fv, text
from ..functions.numeric import half_up, one_decimal, whole_percent
from .apply import with_retry
from .scoring import weakest_criteria
from .spread import null_safe_join, numbered, smallest_n

FIELDS = ("priority", "category", "title", "description", "prompt_suggestion")
# Rules apply in this order; it breaks ties between equal priorities.
STAGE_CATEGORY, STAGE_CRITERION, STAGE_OVERALL, STAGE_PATTERN = 1, 2, 3, 4


def _texts(template: dict, **values):
    return {field: text.fill(template[field], **values) for field in ("title", "description", "prompt_suggestion")}


def _when(condition, then: dict, otherwise: dict) -> dict:
    return {field: F.when(condition, then[field]).otherwise(otherwise[field]) for field in then}


def _rec(stage: int, order, priority, category, texts: dict):
    return F.struct(
        F.lit(stage).alias("stage"), order.cast("bigint").alias("stage_order"), priority.alias("priority"),
        category.alias("category"), *[c.alias(f) for f, c in texts.items()],
    )


def _emit(df: DataFrame, by, *rules) -> DataFrame:
    """One row per rule that applies; rules on the same rows are tried in one pass."""
    return df.select(*by, F.inline_outer(F.array_compact(F.array(*rules)))).filter(F.col("stage").isNotNull())


def _category_rule():
    pct = F.col("category_pct")
    values = {"c": F.col("category"), "l": F.lower("category"), "p": one_decimal("category_pct")}
    texts = _when(pct < 70, _texts(fv.CATEGORY_CRITICAL, **values), _texts(fv.CATEGORY_MODERATE, **values))
    priority = F.when(pct < 70, "HIGH").otherwise("MEDIUM")
    return F.when(pct < 85, _rec(STAGE_CATEGORY, F.col("first_seq"), priority, F.col("category"), texts))


def _pattern_rule():
    hit = None
    for i, (category, priority, *texts) in enumerate(fv.PATTERN_RULES):
        row = _rec(STAGE_PATTERN, F.lit(i), F.lit(priority), F.col("category"), dict(zip(FIELDS[2:], map(F.lit, texts))))
        known = F.col("category") == category
        hit = F.when(known, row) if hit is None else hit.when(known, row)
    return F.when(F.col("category_score") < fv.PATTERN_BELOW, hit)


def rec_category(categories: DataFrame, by=("run_id",)) -> DataFrame:
    """Categories below 70 % (HIGH) or 85 % (MEDIUM), by the rounded score."""
    return _emit(categories, by, _category_rule())


def rec_pattern(categories: DataFrame, by=("run_id",)) -> DataFrame:
    """Four known categories whose unrounded mean is below 0.85."""
    return _emit(categories, by, _pattern_rule())


def rec_criterion(criteria: DataFrame, by=("run_id",), ties=("test_seq", "criterion_seq")) -> DataFrame:
    """Of the 8 weakest criteria of a run, those below 0.7. Filtering first gives the same
    rows, and the scan then drops what could not be among them."""
    weak = weakest_criteria(criteria.filter(F.col("score") < fv.WEAK_BELOW), fv.IMPROVER_RECOMMENDATIONS, by, ties)
    texts = _texts(
        fv.CRITERION_WEAK, t=F.col("test_id").cast("string"), s=F.substring("text", 1, 80), c=F.col("text"),
        l=F.lower("text"), p=half_up(F.col("score") * 100, 0).cast("bigint").cast("string"),
    )
    priority = F.when(F.col("score") < 0.4, "HIGH").otherwise("MEDIUM")
    return _emit(weak, by, _rec(STAGE_CRITERION, F.col("rank"), priority, F.lit("Specific Criterion"), texts))


def rec_overall(runs: DataFrame, by=("run_id",)) -> DataFrame:
    """A run below 80 % needs a revision, one from 90 % gets a baseline note."""
    pct = F.col("overall_pct")
    values = {"p": one_decimal("overall_pct")}
    texts = _when(pct < 80, _texts(fv.OVERALL_LOW, **values), _texts(fv.OVERALL_STRONG, **values))
    rec = _rec(STAGE_OVERALL, F.lit(0), F.when(pct < 80, "HIGH").otherwise("LOW"), F.lit("Overall"), texts)
    return _emit(runs, by, F.when((pct < 80) | (pct >= 90), rec))


def recommendations(criteria: DataFrame, categories: DataFrame, runs: DataFrame, by=("run_id",),
                    ties=("test_seq", "criterion_seq")) -> DataFrame:
    """All rules together, one row per run and title: the highest ranked one is kept."""
    found = (
        _emit(categories, by, _category_rule(), _pattern_rule())
        .unionByName(rec_criterion(criteria, by, ties))
        .unionByName(rec_overall(runs, by))
    )
    rank = F.lit(len(fv.PRIORITIES))
    for i, name in enumerate(fv.PRIORITIES):
        rank = F.when(F.col("priority") == name, F.lit(i)).otherwise(rank)
    best = F.min(F.struct(rank.alias("priority_rank"), "stage", "stage_order", "priority", "category", "description",
                          "prompt_suggestion"))
    return (
        found.groupBy(*by, "title").agg(best.alias("_b"))
        .select(*by, "_b.priority_rank", "_b.stage", "_b.stage_order", "_b.priority", "_b.category", "title",
                "_b.description", "_b.prompt_suggestion")
    )


def rank_recommendations(recs: DataFrame, by=("run_id",)) -> DataFrame:
    """Sorted by run, priority and the order of the rules."""
    return recs.orderBy(*by, "priority_rank", "stage", "stage_order")


def top_recommendations(recs: DataFrame, k: int = fv.CONSOLE_RECOMMENDATIONS, by=("run_id",)) -> DataFrame:
    return smallest_n(recs, list(by), ["priority_rank", "stage", "stage_order"], k)


def weak_line() -> "F.Column":
    """`- [test] criterion — GEval: 65% (Failed DAG dimensions: a, b)`."""
    failed = F.transform(
        F.filter(F.map_entries("dag_dimensions"), lambda e: ~e["value"]["passed"]), lambda e: e["key"]
    )
    suffix = F.when(F.size(failed) > 0, F.concat(F.lit(" (Failed DAG dimensions: "), F.array_join(failed, ", "), F.lit(")")))
    return F.concat(
        F.lit("- ["), F.col("test_id").cast("string"), F.lit("] "), F.col("text"), F.lit(" — GEval: "),
        whole_percent("score"), F.coalesce(suffix, F.lit("")),
    )


def weak_areas(criteria: DataFrame, by=("run_id",), order=("test_seq", "criterion_seq")) -> DataFrame:
    """Every criterion below 0.7 with the names of its failed dimensions."""
    return criteria.filter(F.col("score") < fv.WEAK_BELOW).select(
        *by, "test_id", *[c for c in order if c != "test_id"], F.col("text").alias("criterion"), weak_line().alias("line")
    )


def weak_areas_or_default(criteria: DataFrame, by=("run_id",), order=("test_seq", "criterion_seq")) -> DataFrame:
    """As `weak_areas`, with one line for a run that has none."""
    strong = (
        criteria.groupBy(*by)
        .agg(F.count(F.when(F.col("score") < fv.WEAK_BELOW, F.lit(1))).alias("_weak"))
        .filter(F.col("_weak") == 0)
        .select(*by, F.lit(fv.NO_WEAK_AREAS).alias("line"))
    )
    return weak_areas(criteria, by, order).unionByName(strong, allowMissingColumns=True)


def prompt_frame() -> tuple[str, str, str]:
    """The text before the weak areas, between them and the recommendations, and after those."""
    header, rest = fv.IMPROVEMENT_PROMPT.split("{weak_areas}")
    return (header, *rest.split("{recommendations}"))


def improvement_parts(runs: DataFrame, weak: DataFrame, recs: DataFrame, by=("run_id",), order=("test_seq", "criterion_seq")) -> DataFrame:
    """The prompt of the improving model as ordered rows, for runs of any size: keys, section (0 header,
    1 weak areas, 2 middle, 3 recommendations, 4 closing), part_no and text; the rows of sections 1 and
    3 are lines. original_prompt, original_score and original_grade stand in the header's row."""
    keys, (header, middle, closing) = list(by), prompt_frame()
    part = lambda section, number, line: (F.lit(section).alias("section"), number.cast("bigint").alias("part_no"), line.alias("text"))
    one = F.lit(1)
    first = text.fill(header, current_prompt=F.substring(F.coalesce("system_prompt", F.lit("")), 1, fv.JUDGE_CONTEXT_CHARS), overall_score=one_decimal("overall_pct"), grade=F.col("grade"))
    frame = runs.select(
        *keys, F.col("system_prompt").alias("original_prompt"), F.col("overall_pct").alias("original_score"), F.col("grade").alias("original_grade"), *part(0, one, first)
    )
    lines = numbered(weak.select(*keys, *order, "line"), keys, list(order), "_no").select(*keys, *part(1, F.col("_no"), F.col("line")))
    rec_line = F.concat(F.lit("- ["), "priority", F.lit("] "), "title", F.lit(": "), "prompt_suggestion")
    top = top_recommendations(recs, fv.IMPROVER_RECOMMENDATIONS, by).select(*keys, *part(3, F.col("rank"), rec_line))
    fixed = [runs.select(*keys, *part(section, one, F.lit(value))) for section, value in ((2, middle), (4, closing))]
    for section, rows, value in ((1, weak, fv.NO_WEAK_AREAS), (3, recs, fv.NO_RECOMMENDATIONS)):
        without = null_safe_join(runs.select(*keys), rows.select(*keys).distinct(), keys, "left_anti")
        fixed.append(without.select(*keys, *part(section, one, F.lit(value))))
    out = frame
    for rows in (lines, top, *fixed):
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def areas_addressed(weak: DataFrame, by=("run_id",)) -> DataFrame:
    """The criteria an improved prompt is to address, as rows."""
    return weak.select(*by, "test_id", F.col("criterion").alias("area"))


def improve_prompts(parts: DataFrame, improver: Callable, summarizer: Callable | None = None, by=("run_id",), partitions: int | None = None,
                    sleep: Callable = time.sleep) -> DataFrame:
    """Improved prompt of each run from `improver(prompt)` and, where given, the change summary from
    `summarizer(prompt)`; keeps score and grade of the run.

    Parts reach their task sorted, and one run's prompt at a time is put together there.
    """
    keys = list(by)
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    fields = [*keys, "original_score", "original_grade"]
    schema = T.StructType([T.StructField(f, kinds[f]) for f in fields] + [T.StructField(f, T.StringType()) for f in ("improved_prompt", "changes_summary", "error")])
    spread = parts.repartition(partitions, *keys) if partitions else parts.repartition(*keys)
    rows = spread.sortWithinPartitions(*keys, "section", "part_no").select(*fields, "original_prompt", "section", "text")
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def finished(head, lines):
        pieces = [first if section in (0, 2, 4) else "\n".join([first, *rest]) for section, (first, *rest) in lines.items()]
        got, _, error = with_retry(improver, "".join(pieces), sleep=sleep)
        summary = None
        if error is None and summarizer is not None:
            summary, _, error = with_retry(summarizer, fv.SUMMARY_PROMPT.format(original=(head[-1] or "")[:2000], improved=(got or "")[:2000]), sleep=sleep)
        return (*head[:-1], got, summary, error)

    def batch_of(row):
        return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, types, strict=True)], names=schema.names)

    def run(batches):
        head, lines = None, {}
        for batch in batches:
            for *values, section, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if section == 0 and head is not None:
                    yield batch_of(finished(head, lines))
                    lines = {}
                if section == 0:
                    head = values
                lines.setdefault(section, []).append(line or "")
        if head is not None:
            yield batch_of(finished(head, lines))

    return rows.mapInArrow(run, schema)
