"""Written tables: test suites, reference documents, run history. Readers and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import fixed_values as fv, text
from ..operators import model_output
from ..operators.context import distinct_docs, requested_docs
from ..operators.history import csv_view, history as newest_runs
from ..session import shared_dir
from . import documents, keyed


# --- test suites ---------------------------------------------------------------------

def read_test_suite(spark: SparkSession, path: str, role_slug: str | None = None, fmt: str = "json") -> DataFrame:
    """Test cases with a fixed schema; a weak variant reads the suite of its base role."""
    cases = spark.read.schema(schemas.TEST_CASES).format(fmt).load(path)
    if role_slug is None:
        return cases
    return cases.filter(F.col("role_slug") == role_slug.replace(fv.WEAK_SUFFIX, ""))


def read_generated_json(spark: SparkSession, path: str, per_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected texts) from files that each hold one JSON array of cases, or with
    `per_line` one array in every line. The position in the array becomes test_seq; a text
    that is not an array is rejected."""
    files = spark.read.text(path, wholetext=not per_line).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    parsed = model_output.parse_json_array(files, "raw")
    strict = parsed.withColumn("parsed_by", F.when(F.col("parsed_by") == "slice", "rejected").otherwise(F.col("parsed_by")))
    cases = model_output.cases_from_output(strict.filter(F.col("parsed_by") != "rejected"))
    return cases, model_output.rejects(strict)


def save_suite_json(cases: DataFrame, path: str) -> None:
    """One JSON object per line, as many files as there are partitions."""
    cases.write.mode("errorifexists").json(path)


# --- reference documents -------------------------------------------------------------

def read_reference_docs(spark: SparkSession, root: str, roles: DataFrame) -> DataFrame:
    """Documents of each role: the files of its folder, and files right below the root whose
    name starts with the role. Undecodable bytes are replaced; a name counts once per role.

    The name match is an equality join on the prefixes of the file name.
    """
    files = documents.read_files(spark, root=root, suffixes=",".join(fv.DOC_SUFFIXES)).filter("error IS NULL").drop("size", "error")
    slugs = roles.select("role_slug").distinct()
    in_folder = (
        files.filter("folder IS NOT NULL").withColumnRenamed("folder", "role_slug").join(slugs, "role_slug", "left_semi")
        .withColumn("in_root", F.lit(False))
    )
    prefixes = F.transform(F.sequence(F.lit(1), F.length("file_name")), lambda n: F.substr("file_name", F.lit(1), n))
    in_root = (
        files.filter("folder IS NULL").drop("folder").withColumn("role_slug", F.explode(prefixes))
        .join(slugs, "role_slug", "left_semi").withColumn("in_root", F.lit(True))
    )
    return distinct_docs(in_folder.unionByName(in_root))


def read_source_docs(spark: SparkSession, paths: list[str], role_slug: str) -> DataFrame:
    """Documents from an explicit list of paths; paths that do not exist are skipped."""
    files = documents.read_files(spark, paths=json.dumps([str(p) for p in paths]))
    return distinct_docs(files.filter("error IS NULL").select(F.lit(role_slug).alias("role_slug"), "path", "file_name", "content"))


def read_requested_docs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of many roles at once: `requests` has role_slug and an array of paths.

    Each distinct path is read once, by tasks that take their paths from a written manifest, so
    neither the paths nor their number reach the driver. Errors are rows (role_slug, path, error).
    """
    spark = requests.sparkSession
    wanted = requests.select("role_slug", F.explode("paths").alias("path")).distinct()
    folder = shared_dir(spark, "requested")
    documents.write_manifest(wanted, f"{folder}/manifest")
    documents.read_files(spark, manifest=f"{folder}/manifest").write.parquet(f"{folder}/files")  # read once for both results
    files = spark.read.parquet(f"{folder}/files")
    errors = wanted.join(files.filter("error IS NOT NULL").select("path", "error"), "path").select("role_slug", "path", "error")
    return requested_docs(requests, files.filter("error IS NULL")), errors


# --- history -------------------------------------------------------------------------

#: Partition column of tables by period.
PERIOD = "run_period"


def append_rows(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append to a parquet table. Runs are partitioned by run_type, which the history pages
    filter on."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_eval_runs(rows: DataFrame, path: str, key: str = "run_id") -> None:
    """Summary rows of evaluation, comparison, generated or red-team runs. A run appended again replaces its row."""
    keyed.put_rows(rows.withColumn("category_scores", F.to_json("category_scores")), path, [key], "run_type")


def append_calibration_run(run: DataFrame, issues: DataFrame, path: str, issues_path: str, key: str = "run_id") -> None:
    """Headline row and its issue lines. The lines are rows of their own table, keyed by the
    run, because their number grows with the gold data. A run appended again replaces row and lines; of a run
    without lines none are left."""
    keyed.put_rows(run, path, [key])
    keyed.put_rows(issues, issues_path, [key], gone=run.select(key))


def append_role_version(versions: DataFrame, path: str) -> None:
    """Snapshots with the hashes of their texts. A version appended again replaces itself."""
    from ..operators.versions import with_hashes

    keyed.put_rows(with_hashes(versions), path, ["role_slug", "id"])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all schema generations; columns that older files lack are NULL."""
    return evolve_schema(keyed.read_keyed(spark, path))


def append_by_period(rows: DataFrame, path: str, period: str = "yyyy-MM", key: str = "id", time: str = "timestamp") -> None:
    """Runs in folders by the month (or, with yyyy-MM-dd, the day) they finished, for `read_newest`. A run appended again
    replaces its row. Choose periods that hold many runs: each is a folder."""
    keyed.put_rows(rows.withColumn(PERIOD, F.concat(F.lit("p"), F.date_format(time, period))), path, [key], PERIOD, buckets=1)


def read_newest(spark: SparkSession, path: str, limit: int = 100, role: str | None = None) -> DataFrame:
    """The newest runs of a table of `append_by_period`. Periods are read from the newest back, twice as many each time
    until enough runs stand; older ones are not touched. Runs without time come last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if f.isDirectory()]
    periods = sorted((n for n in names if n.startswith(f"{PERIOD}=")), key=lambda n: (n.startswith(f"{PERIOD}=p"), n), reverse=True)
    taken = 1
    while True:
        runs = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/{d}" for d in periods[:taken]]).drop(PERIOD, keyed.BUCKET)
        found = newest_runs(runs, role, limit)
        if taken >= len(periods) or found.count() >= limit:
            return found
        taken *= 2


def evolve_schema(runs: DataFrame) -> DataFrame:
    """Add the columns that came later to data written before them."""
    kinds = dict(column.split(" ") for column in schemas.EVAL_RUNS.split(", "))
    for name in fv.LATE_COLUMNS:
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast(kinds[name]))
    return runs


def with_category_map(runs: DataFrame) -> DataFrame:
    return runs.withColumn("category_scores", F.from_json("category_scores", "map<string,double>"))


def export_history_csv(runs: DataFrame, path: str, run_type: str = "") -> None:
    csv_view(runs, run_type).write.mode("errorifexists").csv(path, header=True)


# --- small inputs --------------------------------------------------------------------

def prompt_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Prompt text files for requests with a `file:` source."""
    return spark.read.text(pattern, wholetext=True).select(
        F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("file_path"), F.col("value").alias("content"))
