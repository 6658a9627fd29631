"""Documents to packed training sequences: five stages, each written as Parquet and read again.

1. Quality rules: documents that the base rules or the learned rules reject go.
2. Near duplicates: of each class the document with the smallest id stays, once.
3. Substrings: words of windows that an earlier document has go; a document left without words goes.
4. Decontamination: documents that hold a window of the benchmark go.
5. Packing: the rest becomes pieces of sequences.

In stage 2 rows that share an id, or have none, are documents of their own, told apart by their text: equal
rows are one document, and behind all others in the order of ids. Documents without id lose no words in stage 3; they are judged
like all others elsewhere. Columns besides doc_id, text, lang, source and n_chars pass through the stages under
names of their own, so they may have any name. The stages read their input twice, so it must come from files, as it does here.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradeloom.llm import decontaminate, near_dup, packing, quality_rules, substring_dedup  # noqa: E402
from gradeloom.session import shared_dir  # noqa: E402


#: Columns that the stages know; all others get numbered names on the way through a stage.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in KNOWN else f"own_{k}" for k, c in enumerate(docs.columns)])


def _any_names(stage):
    """The stage with columns of any name: they come out as they went in."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(spark, _plain(docs), sf_dir).toDF(*docs.columns)

    return run


@_any_names
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter(quality_rules.PREFIX + "kept").select(docs.columns)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with a column key: the id where it is given and stands once, else a number above 2^62 made of id and text."""
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if counted.isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    again = counted.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("other"))
    by_text = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    known = docs.filter("doc_id IS NOT NULL").join(again, F.col("doc_id") == F.col("other"), "left")
    known = known.withColumn("key", F.when(F.col("other").isNull(), F.col("doc_id").cast("long")).otherwise(by_text)).drop("other")
    path = shared_dir(spark, "keyed")  # from files, as near_dup reads it twice
    known.union(docs.filter("doc_id IS NULL").withColumn("key", by_text)).write.parquet(path)
    return spark.read.parquet(path)


@_any_names
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, docs)
    surplus = near_dup.classes(keyed, id_col="key").filter("class_id <> doc_id").select(F.col("doc_id").alias("key"))
    left = keyed.join(surplus.hint("merge"), "key", "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # rows of one key are equal in id and text
    return left.withColumn("place", first).filter("place = 1").select(docs.columns)


@_any_names
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = substring_dedup.dedup(docs, keep=[*rest, "n_chars"]).filter("n_words = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(f"keep_{len(rest)}")).cast(docs.schema["n_chars"].dataType)
    named = {c: F.col(f"keep_{k}") for k, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": n_chars}
    return rows.select([named[c].alias(c) for c in docs.columns])


@_any_names
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0")
    hits = hits.select(F.col("doc_id").alias("_id"), "sig").distinct()
    same = F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("sig")
    return docs.join(hits, same & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_plain(docs), packing.default_tokenizer()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", without_near_duplicates),
    ("substring dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: The learned rules and the tokenizer have no SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
