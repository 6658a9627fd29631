"""Prompt versions: snapshots, previous version, line difference, restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from .spread import null_safe_join, with_latest_set, with_previous

TEXTS = {"prompt_text": "prompt_hash", "test_cases": "test_hash", "context_text": "context_hash"}
LENGTHS = {"prompt_text": "prompt_len", "test_cases": "test_len", "context_text": "context_len"}


def with_hashes(versions: DataFrame) -> DataFrame:
    return versions.withColumns({h: text.short_hash(F.coalesce(t, F.lit(""))) for t, h in TEXTS.items()})


def version_history(versions: DataFrame, role_slug, limit: int = 20) -> DataFrame:
    """Newest versions of one role, texts replaced by their lengths."""
    shown = [c for c in ("id", "timestamp", "role_slug", "version", "author", "change_note") if c in versions.columns]
    return (
        versions.filter(F.col("role_slug") == role_slug)
        .select(*shown, *[h for h in TEXTS.values() if h in versions.columns],
                *[F.length(t).cast("bigint").alias(n) for t, n in LENGTHS.items()])
        .orderBy(F.desc("id"))
        .limit(limit)
    )


def version_detail(versions: DataFrame, version_id) -> DataFrame:
    return versions.filter(F.col("id") == version_id)


def latest_version(versions: DataFrame) -> DataFrame:
    """Newest version id of each role."""
    return versions.groupBy("role_slug").agg(F.max("id").alias("latest_id"), F.count(F.lit(1)).alias("num_versions"))


def previous_version(versions: DataFrame) -> DataFrame:
    """Each version with the id of the next older one of its role."""
    return with_previous(versions, ["role_slug"], "id", "previous_id")


def version_line_diff(versions: DataFrame) -> DataFrame:
    """Each version against the one before it, line by line: same, added, removed, changed.

    The previous version is found on ids alone; its text then comes by key, and the two
    texts are compared inside one row.
    """
    links = previous_version(versions).filter(F.col("previous_id").isNotNull())
    new = versions.select("role_slug", "id", F.col("prompt_text").alias("_new"))
    old = versions.select("role_slug", F.col("id").alias("previous_id"), F.col("prompt_text").alias("_old"))
    pairs = null_safe_join(null_safe_join(new, links, ["role_slug", "id"]), old, ["role_slug", "previous_id"])

    def lines(c):
        return F.split(F.coalesce(c, F.lit("")), "\n")

    zipped = F.arrays_zip(lines("_old").alias("o"), lines("_new").alias("n"))
    exploded = pairs.select("role_slug", "id", "previous_id", F.posexplode(zipped).alias("_pos", "_line"))
    old_line, new_line = F.coalesce("_line.o", F.lit("")), F.coalesce("_line.n", F.lit(""))
    status = (
        F.when(old_line == new_line, "same").when(old_line == "", "added").when(new_line == "", "removed").otherwise("changed")
    )
    return exploded.select(
        "role_slug", "id", "previous_id", (F.col("_pos") + 1).cast("bigint").alias("line_no"),
        old_line.alias("old_line"), new_line.alias("new_line"), status.alias("status"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("role_slug", "id", "status").agg(F.count(F.lit(1)).alias("num_lines"))


def carried_forward(versions: DataFrame, column: str) -> DataFrame:
    """Versions in which a text that was not given keeps its last given value. Only ids go
    through the ordered step; the text is fetched by key."""
    given = F.coalesce(F.col(column), F.lit("")) != ""
    source = with_latest_set(versions, ["role_slug"], "id", given, "_from")
    texts = versions.select("role_slug", F.col("id").alias("_from"), F.col(column).alias("_text"))
    kept = null_safe_join(source, texts, ["role_slug", "_from"], "left").select("role_slug", "id", F.col("_text").alias(column))
    return null_safe_join(versions.drop(column), kept, ["role_slug", "id"])


def restore_version(versions: DataFrame, chosen: DataFrame, timestamp=None) -> DataFrame:
    """A new newest version per role that repeats the chosen one (role_slug, id); one choice
    per role. Texts and hashes are those of the chosen version."""
    restored = (
        versions.join(chosen.select("role_slug", "id"), ["role_slug", "id"], "left_semi")
        .join(latest_version(versions).select("role_slug", "latest_id"), "role_slug")
        .withColumn("change_note", F.concat(F.lit("Restored version "), F.col("id").cast("string")))
        .withColumn("id", F.col("latest_id") + 1)
        .drop("latest_id")
    )
    return restored if timestamp is None else restored.withColumn("timestamp", timestamp)
