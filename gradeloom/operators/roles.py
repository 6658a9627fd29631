"""Roles, prompt sources and run requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv, text


def list_roles(roles: DataFrame, include_weak: bool = False) -> DataFrame:
    """Roles that have both a prompt and metadata, in name order."""
    ok = F.col("system_prompt").isNotNull() & F.col("name").isNotNull()
    if not include_weak:
        ok = ok & ~F.col("role_slug").endswith(fv.WEAK_SUFFIX)
    return roles.filter(ok).select("role_slug").orderBy("role_slug")


def role_info(roles: DataFrame, cases: DataFrame) -> DataFrame:
    """Display fields with defaults, and whether the role has tests and a weak variant."""
    tested = cases.select("role_slug").distinct().withColumn("_tests", F.lit(True))
    weak = (
        roles.filter(F.col("role_slug").endswith(fv.WEAK_SUFFIX))
        .select(text.base_slug("role_slug").alias("role_slug"), F.lit(True).alias("_weak"))
        .distinct()
    )
    return (
        roles.join(tested, "role_slug", "left")
        .join(weak, "role_slug", "left")
        .select(
            "role_slug",
            F.coalesce("name", "role_slug").alias("name"),
            F.coalesce("version", F.lit("?")).alias("version"),
            F.coalesce("domain", F.lit("?")).alias("domain"),
            F.coalesce("_tests", F.lit(False)).alias("has_tests"),
            F.coalesce("_weak", F.lit(False)).alias("has_weak_variant"),
        )
    )


def resolve_prompt(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The system prompt of each request.

    `requests` has prompt_source and local_prompt, `files` has file_path and content. A file
    that does not exist leaves the prompt NULL and sets `missing_file`. Requests without a
    file get scattered join keys that no path equals: as NULL keys they would all meet in
    one task.
    """
    source = F.col("prompt_source")
    is_file = source.startswith("file:")
    scattered = F.concat(F.lit("none:"), F.xxhash64(*requests.columns).cast("string"))
    wanted = requests.withColumn("_path", F.when(is_file, F.substr(source, F.lit(6))).otherwise(scattered))
    joined = wanted.join(files.select(F.col("file_path").alias("_path"), F.col("content").alias("_content")), "_path", "left")
    prompt = (
        F.when(source == "none", F.lit(""))
        .when(source.startswith("custom:"), F.substr(source, F.lit(8)))
        .when(is_file, text.strip("_content"))
        .otherwise(F.col("local_prompt"))
    )
    return joined.withColumn("resolved_prompt", prompt).withColumn(
        "missing_file", is_file & F.col("_content").isNull()
    ).drop("_path", "_content")


def resolve_run_config(configs: DataFrame) -> DataFrame:
    """Judge settings fall back to the target's; an empty value counts as missing."""
    target_deployment = text.first_filled("target_deployment", "target_model")
    fields = ["provider", "api_key", "model", "base_url", "api_version"]
    resolved = {
        f"judge_{f}": F.coalesce(text.blank_to_null(f"judge_{f}"), F.col(f"target_{f}"))
        for f in fields if f"judge_{f}" in configs.columns
    }
    return configs.withColumns({
        **resolved,
        "target_deployment": target_deployment,
        "judge_deployment": F.coalesce(
            text.blank_to_null("judge_deployment"), text.blank_to_null("judge_model"), target_deployment
        ),
    })


def expand_run_specs(specs: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per (run, repeat, test): run requests meet the cases of their role.

    A weak variant uses the suite of its base role. An A/B request is two specs with the
    same pair id.
    """
    wanted = specs.withColumn("_suite", text.base_slug("role_slug")).withColumn(
        "repeat", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("repeat", F.lit(1)), F.lit(1))))
    )
    return wanted.join(cases.withColumnRenamed("role_slug", "_suite"), "_suite").drop("_suite")


def run_totals(work: DataFrame, by=("run_id",)) -> DataFrame:
    """Progress total of each run."""
    return work.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def model_display_name(model: str = "model", provider: str = "provider") -> "F.Column":
    return F.concat(F.col(model), F.lit(" ("), F.col(provider), F.lit(")"))


def run_label(model: str = "model", provider: str = "provider", source: str = "prompt_source") -> "F.Column":
    """`model / source`, naming the provider only where no model was chosen."""
    chosen = text.blank_to_null(model)
    fallback = F.concat(F.col("default_model"), F.lit(" ("), F.col(provider), F.lit(")"))
    return F.concat(F.coalesce(chosen, fallback), F.lit(" / "), F.col(source))
