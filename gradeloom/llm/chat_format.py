"""Chat formatting: each participant's view of a dialogue.

For every participant the whole dialogue is rendered with that speaker as the assistant and the
others as named users; only the assistant's words and the end mark after them are to be learned.
Speakers in `context_roles` (system) stay what they are and get no view of their own.

The result has a row for each view and turn: rendered text, its place in the rendered view, and
the span that the mask keeps. A view is never gathered in one task: places are running sums of
lengths inside ranges of turns plus the sums of the ranges before, so a dialogue of any length
and any number of speakers is spread over many tasks.

Null text: empty. Null role: the speaker named "unknown". Null conversation ids form one
conversation of their own; null turns come first. Rows with the same turn stand in the order of
role and text; repeated rows are repeated turns. A dialogue without participants has no view.
An empty table gives no rows. Other columns are left out, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CONTEXT_ROLES = ("system",)
RANGE_TURNS = 256
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def plain_text(text: Column) -> Column:
    """Marks of the format inside a text lose their meaning: a blank is put behind the first bracket."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def plain_name(name: Column) -> Column:
    """A name in a header line: one line, no marks."""
    return F.translate(F.coalesce(name, F.lit(UNKNOWN)), "\n\r<>|", "  ___")


def rotated(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES, range_turns: int = RANGE_TURNS,
) -> DataFrame:
    """conv_id, view, turn, position, message_role, message_name, rendered, start, n_chars, mask_start, mask_end.

    Lengths and places count characters; mask_start and mask_end are null in turns that are not learned.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), plain_name(F.col(role_col)).alias("speaker"), plain_text(F.col(text_col)).alias("text"),
    )
    speaks = ~F.col("speaker").isin(*context_roles)
    views = rows.filter(speaks).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("view")).distinct()
    own = F.col("speaker") == F.col("view")
    role = F.when(~speaks, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    header = F.concat(F.lit(OPEN), role, F.when(speaks & ~own, F.concat(F.lit(" name="), "speaker")).otherwise(F.lit("")), F.lit("\n"))
    spoken = (
        rows.join(views, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumns({"message_role": role, "message_name": F.when(speaks & ~own, F.col("speaker")), "_header": F.length(header),
                      "rendered": F.concat(header, "text", F.lit(f"{CLOSE}\n"))})
        .withColumns({"n_chars": F.length("rendered").cast("long"), "_range": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / range_turns)})
    )
    view = ["conv_id", "view", "_range"]
    inside = Window.partitionBy(*view).orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id", "view").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        spoken.groupBy(*view).agg(F.sum("n_chars").alias("_chars"), F.count(F.lit(1)).alias("_turns"))
        .select(*(F.col(c).alias(f"{c}_r") for c in view), F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_chars_before"),
                F.coalesce(F.sum("_turns").over(before), F.lit(0)).alias("_turns_before"))
    )
    placed = spoken.withColumns({"_upto": F.sum("n_chars").over(inside), "_place": F.row_number().over(inside)})
    same = F.lit(True)
    for c in view:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    start = F.col("_chars_before") + F.col("_upto") - F.col("n_chars")
    learned = F.col("message_role") == "assistant"
    return placed.join(ranges, same).select(
        "conv_id", "view", "turn", (F.col("_turns_before") + F.col("_place")).cast("long").alias("position"), "message_role", "message_name", "rendered",
        start.alias("start"), "n_chars", F.when(learned, start + F.col("_header")).alias("mask_start"),
        F.when(learned, start + F.col("n_chars") - 1).alias("mask_end"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, translate(coalesce(role, 'unknown'), chr(10) || chr(13) || '<>|', '  ___') AS speaker,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS text
  FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS view FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.conv_id, v.view, t.turn, t.speaker, t.text,
         CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = v.view THEN 'assistant' ELSE 'user' END AS message_role,
         CASE WHEN t.speaker <> 'system' AND t.speaker <> v.view THEN t.speaker END AS message_name
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
r AS (
  SELECT *, '<|im_start|>' || message_role || coalesce(' name=' || message_name, '') || chr(10) AS header FROM s),
f AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM r),
p AS (
  SELECT *, row_number() OVER w AS position, length(rendered) AS n_chars,
         CAST(sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(rendered) AS start
  FROM f WINDOW w AS (PARTITION BY conv_id, view ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, view, turn, position, message_role, message_name, rendered, start, n_chars,
       CASE WHEN message_role = 'assistant' THEN start + length(header) END AS mask_start,
       CASE WHEN message_role = 'assistant' THEN start + n_chars - 1 END AS mask_end
FROM p
"""
