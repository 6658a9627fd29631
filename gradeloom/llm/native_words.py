"""Words of texts as Spark expressions: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is the cheaper way where there are only ASCII characters."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each word: doc_id, sig (hash of the text), words (all of them), at (from 1) and word; and for each
    document one row with at = 0, so that documents without a word or a match stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("sig"), words(F.col(text_col)).alias("words"))
    return rows.select("doc_id", "sig", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "word"))


def repeated(rows: DataFrame, copies: str, step: int = 4096) -> DataFrame:
    """Every row as often as column `copies` says, by arrays of `step` at most within each step."""
    steps = F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(step).cast("long"))
    inner = F.sequence(F.lit(1).cast("long"), F.least(F.col(copies) - F.col("_from"), F.lit(step)))
    return rows.withColumn("_from", F.explode(steps)).withColumn("_copy", F.explode(inner)).drop("_from", "_copy")
