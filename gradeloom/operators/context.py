"""Reference documents as judge context and as source of generated tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, text
from ..functions.numeric import col
from .spread import smallest_n

# The scoring rubric put into every judge prompt.
SCORING_RUBRIC = """
SCORING RUBRIC — Use this rubric to assign scores consistently:

Score 1.0 (Excellent):
- Criterion is fully addressed with specific, correct details
- Names exact technologies, standards, versions, or configurations
- Provides actionable guidance (steps, commands, architecture decisions)
- Demonstrates depth beyond surface-level knowledge
- Example: "Use AES-256 with customer-managed keys in FIPS 140-2 Level 2 HSM-backed Key Vault"

Score 0.8 (Good):
- Criterion addressed with mostly specific details
- Correct direction but may miss one specific element
- Provides guidance that a practitioner could act on
- Example: "Use customer-managed keys in Azure Key Vault for encryption at rest"

Score 0.6 (Adequate):
- Criterion mentioned with some relevant detail
- General direction is correct but lacks specificity
- Missing important qualifiers or specific configurations
- Example: "Use Azure Key Vault for key management"

Score 0.4 (Weak):
- Criterion barely addressed or only implied
- Vague statement without specific guidance
- Missing critical details that a practitioner would need
- Example: "Encryption should be used"

Score 0.2 (Poor):
- Criterion mentioned in passing or tangentially
- No useful detail or actionable guidance
- May be misleading or incomplete
- Example: "Security is important"

Score 0.0 (Not Addressed):
- Criterion not mentioned at all in the response
- Or the response contradicts the criterion
"""
# The lines around rubric, reference block and criterion.
PROMPT_HEADER = "You are an expert evaluator for a {domain} AI assistant."
PROMPT_REFERENCE = "REFERENCE STANDARDS — The response should align with these organizational standards:"
PROMPT_CRITERION = "CRITERION TO EVALUATE: {criterion}"
PROMPT_CLOSING = [
    "",
    "Score the response on a scale of 0.0 to 1.0 based on how well it addresses this criterion.",
    "Consider the scoring rubric above and the reference standards (if provided).",
    "A response that aligns with the reference standards should score higher than generic advice.",
]


def distinct_docs(docs: DataFrame) -> DataFrame:
    """One document per role and file name. A file of the role's own folder wins over one
    matched by name in the root folder (`in_root`)."""
    order = ["in_root", "path"] if "in_root" in docs.columns else ["path"]
    return smallest_n(docs, ["role_slug", "file_name"], order, 1).drop("rank", *order)


def requested_docs(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents asked for by path: `requests` has role_slug and an array of paths, `docs` has
    path, file_name and content. A path that no document has is skipped."""
    wanted = requests.select("role_slug", F.explode("paths").alias("path")).distinct()
    return distinct_docs(wanted.join(docs.select("path", "file_name", "content"), "path"))


def context_parts(docs: DataFrame) -> DataFrame:
    """The whole context of every role as its parts. Joined by a blank line in order of the
    file name they are the context text; as rows they stay distributed, so the documents
    of one role may be of any size."""
    part = F.concat(F.lit("### "), "file_name", F.lit("\n"), "content")
    return docs.select("role_slug", "file_name", part.alias("part_text"))


def context_info(roles: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether a role has context, its documents and the length of its context text."""
    part_chars = F.length("file_name") + F.length("content") + F.lit(len("### ") + len("\n"))
    sums = docs.groupBy("role_slug").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum(part_chars.cast("bigint")).alias("_chars")
    )
    return roles.select("role_slug").join(sums, "role_slug", "left").select(
        "role_slug",
        F.col("doc_count").isNotNull().alias("loaded"),
        F.coalesce("doc_count", F.lit(0)).cast("bigint").alias("doc_count"),
        F.coalesce(F.col("_chars") + (F.col("doc_count") - 1) * len("\n\n"), F.lit(0)).cast("bigint").alias("total_chars"),
    )


def _leading_text(docs: DataFrame, part: Column, shortest_part: int, limit: int) -> DataFrame:
    """First `limit` characters of the parts of each role, joined in file name order; a name stands
    once per role (see `distinct_docs`).

    Every part with its separator is at least `shortest_part` long, so only the first
    limit / shortest_part names can reach into the result. Names and lengths are ranked; those whose separator
    starts before the limit then fetch their text by key, so a role with most of the documents does
    not gather their texts.
    """
    sizes = docs.select("role_slug", "file_name", F.length(part).alias("_chars"))
    first = smallest_n(sizes, ["role_slug"], ["file_name"], limit // shortest_part + 1)
    before = Window.partitionBy("role_slug").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = first.withColumn("_start", F.coalesce(F.sum(F.col("_chars") + len("\n\n")).over(before), F.lit(0))).filter(F.col("_start") < limit + len("\n\n"))
    texts = docs.select("role_slug", "file_name", F.substring(part, 1, limit).alias("_part")).join(used.select("role_slug", "file_name"), ["role_slug", "file_name"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_name", "_part"))), lambda x: x["_part"]), "\n\n")
    return texts.groupBy("role_slug").agg(F.substring(joined, 1, limit).alias("_text"))


def context_files(docs: DataFrame) -> DataFrame:
    """The files behind each role's context: role, file name, length of its text."""
    return docs.select("role_slug", "file_name", F.length("content").cast("bigint").alias("chars"))


def judge_context(docs: DataFrame, limit: int = fv.JUDGE_CONTEXT_CHARS) -> DataFrame:
    """The context text of each role as a judge prompt takes it in."""
    part = F.concat(F.lit("### "), "file_name", F.lit("\n"), "content")
    shortest = len("### ") + 1 + len("\n") + len("\n\n")
    return _leading_text(docs, part, shortest, limit).withColumnRenamed("_text", "context_text")


def judge_prompt(criterion: str | Column, domain: str | Column, context_text: str | Column,
                 rubric: str = SCORING_RUBRIC) -> Column:
    """The judge prompt of one criterion; the reference block only where there is context."""
    context = F.substring(text.blank_to_null(context_text), 1, fv.JUDGE_CONTEXT_CHARS)
    reference = F.concat(F.lit(f"\n{PROMPT_REFERENCE}\n---\n"), context, F.lit("\n---\n\n"))
    return F.concat(
        text.fill(PROMPT_HEADER, domain=col(domain)), F.lit(f"\n\n{rubric}\n"),
        F.coalesce(reference, F.lit("")),
        text.fill(PROMPT_CRITERION, criterion=col(criterion)), F.lit("\n" + "\n".join(PROMPT_CLOSING)),
    )


def build_judge_prompts(criteria: DataFrame, contexts: DataFrame, rubric: str = SCORING_RUBRIC) -> DataFrame:
    """Criteria (role_slug, domain, criterion) with their judge prompt."""
    return (
        criteria.join(contexts.select("role_slug", "context_text"), "role_slug", "left")
        .withColumn("judge_prompt", judge_prompt("criterion", "domain", "context_text", rubric))
        .drop("context_text")
    )


def generation_source(roles: DataFrame, docs: DataFrame, limit: int = fv.GENERATION_SOURCE_CHARS) -> DataFrame:
    """Source text for generating tests: the documents with the system prompt after them,
    or the system prompt alone."""
    part = F.concat(F.lit("--- "), "file_name", F.lit(" ---\n"), "content")
    shortest = len("--- ") + 1 + len(" ---\n") + len("\n\n")
    source = _leading_text(docs, part, shortest, limit)
    return roles.select("role_slug", "system_prompt").join(source, "role_slug", "left").select(
        "role_slug",
        F.substring(
            F.when(F.col("_text").isNotNull(),
                   F.concat("_text", F.lit(f"\n\n{fv.SYSTEM_PROMPT_HEADING}\n"), "system_prompt"))
            .otherwise(F.col("system_prompt")), 1, limit,
        ).alias("source_text"),
    )
