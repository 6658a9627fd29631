"""Registered queries: run history, sinks, prompt versions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, history, perf, redteam, scoring, versions
from ..session import shared_dir
from ..sources import keyed, tables
from ..streaming import batches, finished_runs, progress, tracker
from . import bindings as b
from .bindings import sql_verdict, with_tables
from .queries_scoring import PERF, SQL_GAP, SQL_IS_ISSUE, SQL_METRICS, SQL_TIERS, scored_tests

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


SQL_TIME = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"

RUN_COLUMNS = f"id, {SQL_TIME}, role, model, overall_pct, dag_pct, consolidated_pct, grade, run_type"


def time_text():
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")


def run_columns(runs):
    return runs.select("id", time_text(), "role", "model", "overall_pct", "dag_pct", "consolidated_pct", "grade", "run_type")


# --- reading history -----------------------------------------------------------------

@query("history", with_tables("runs") + f"SELECT {RUN_COLUMNS} FROM runs WHERE role = '2-HIGH' ORDER BY runs.timestamp DESC, id DESC LIMIT 100")
def history_newest(spark, d):
    return run_columns(history.history(b.eval_runs(spark, d), "2-HIGH"))


@query("newest_runs", with_tables("runs") + f"SELECT {RUN_COLUMNS} FROM runs WHERE role = '2-HIGH' ORDER BY runs.timestamp DESC, id DESC LIMIT 100")
def newest_runs(spark, d):
    """The same from a table by month, of which the newest months are read."""
    path = shared_dir(spark, "by-month")
    tables.append_by_period(b.eval_runs(spark, d), path)
    return run_columns(tables.read_newest(spark, path, 100, "2-HIGH"))


@query("run_by_id", with_tables("runs") + f"SELECT {RUN_COLUMNS} FROM runs WHERE id = 1234")
def run_by_id(spark, d):
    return run_columns(history.run_by_id(b.eval_runs(spark, d), 1234))


@query("calibration_history", with_tables("runs") + f"SELECT id, {SQL_TIME}, judge_model, overall_pct AS accuracy FROM runs ORDER BY runs.timestamp DESC, id DESC LIMIT 20")
def calibration_history(spark, d):
    rows = b.eval_runs(spark, d).select("id", "timestamp", "judge_model", F.col("overall_pct").alias("accuracy"))
    return history.calibration_history(rows).withColumn("timestamp", time_text())


@query("split_by_run_type", with_tables("runs") + """SELECT 'comparison' AS kind, id, run_type FROM runs WHERE run_type LIKE 'comparison%'
  UNION ALL SELECT 'red_team', id, run_type FROM runs WHERE run_type = 'red_team'""")
def split_by_run_type(spark, d):
    runs = b.eval_runs(spark, d).select("id", "run_type")
    return history.split_by_run_type(runs, "comparison").select(F.lit("comparison").alias("kind"), "id", "run_type").unionByName(
        history.split_by_run_type(runs, "red_team").select(F.lit("red_team").alias("kind"), "id", "run_type"))


@query("history_union", with_tables("runs") + """SELECT run_type, count(*) AS n, count(dag_pct) AS with_dag FROM (
  SELECT run_type, dag_pct FROM runs WHERE run_type <> 'red_team' UNION ALL SELECT run_type, NULL FROM runs WHERE run_type = 'red_team') u GROUP BY run_type""")
def history_union(spark, d):
    runs = b.eval_runs(spark, d)
    evaluated = runs.filter(F.col("run_type") != "red_team")
    attacked = history.split_by_run_type(runs, "red_team").select("id", "run_type", "overall_pct")
    return history.history_union(evaluated, attacked).groupBy("run_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("dag_pct").alias("with_dag"))


@query("history_view", with_tables("runs") + f"""SELECT id, role, run_type, strftime(timestamp, '%Y-%m-%d') AS run_date, strftime(timestamp, '%H:%M') AS run_time,
  coalesce(nullif(model, ''), 'demo') AS model, overall_pct, dag_pct, consolidated_pct AS combined_pct, consolidated_grade AS combined_grade,
  CASE consolidated_grade[1] WHEN 'A' THEN 'good' WHEN 'B' THEN 'fair' WHEN 'C' THEN 'weak' ELSE 'poor' END AS grade_band,
  {sql_verdict('overall_pct')} AS verdict, split_part(report_path, '/', 2) AS report_file FROM runs""")
def history_view(spark, d):
    return history.history_view(b.eval_runs(spark, d))


def _csv_text(name: str) -> str:
    return f"coalesce(CAST({name} AS VARCHAR), '')"


@query("export_history_csv", with_tables("runs") + f"""SELECT CAST(id AS VARCHAR) AS "ID", strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS "Timestamp", role AS "Role",
  coalesce(nullif(model, ''), 'demo') AS "Model", coalesce(judge_model, '-') AS "Judge Model", {_csv_text('overall_pct')} AS "GEval %",
  CAST(dag_pct AS VARCHAR) AS "DAG %", {_csv_text('consolidated_pct')} AS "Combined %", consolidated_grade AS "Grade", {_csv_text('num_tests')} AS "Tests",
  {_csv_text('num_criteria')} AS "Criteria", CAST(avg_latency AS VARCHAR) AS "Avg Latency (s)", {_csv_text('p95_latency')} AS "P95 Latency (s)",
  {_csv_text('total_tokens')} AS "Total Tokens", {_csv_text('estimated_cost')} AS "Est Cost (USD)", {_csv_text('total_elapsed')} AS "Duration (s)",
  run_type AS "Type", replace(notes, ',', ';') AS "Notes" FROM runs WHERE run_type LIKE 'comparison%'""")
def export_history_csv(spark, d):
    """Written as CSV and read back; a blank field reads as NULL."""
    path = shared_dir(spark, "csv")
    tables.export_history_csv(b.eval_runs(spark, d), path, "comparison")
    return spark.read.csv(path, header=True)


# --- writing history -----------------------------------------------------------------

@query("append_eval_run", with_tables("run_scores", "category_scores", "priced_longest") + f"""SELECT s.run_id, 'evaluation' AS run_type, s.overall_pct, s.consolidated_grade,
  s.num_tests, s.num_criteria, m.category_scores, CASE WHEN p.available THEN p.avg_latency ELSE 0.0 END AS avg_latency,
  CASE WHEN p.available THEN p.p95_latency ELSE 0.0 END AS p95_latency, CASE WHEN p.available THEN p.total_tokens ELSE 0 END AS total_tokens,
  CASE WHEN p.available THEN p.estimated_cost_usd ELSE 0.0 END AS estimated_cost FROM run_scores s
  JOIN (SELECT run_id, '{{' || string_agg('"' || category || '":' || printf('%.1f', category_pct), ',' ORDER BY category) || '}}' AS category_scores
    FROM category_scores GROUP BY run_id) m ON m.run_id = s.run_id LEFT JOIN ({PERF}) p ON p.run_id = s.run_id""")
def append_eval_run(spark, d):
    """Summary rows appended to a history folder and read back from it."""
    tests = scored_tests(spark, d)
    rows = history.eval_run_rows(
        scoring.run_scores(tests), scoring.category_scores(tests), perf.perf_summary(perf.priced(b.calls(spark, d))))
    path = shared_dir(spark, "history")
    tables.append_eval_runs(rows.withColumn("run_type", F.lit("evaluation")), path)
    return tables.read_history(spark, path).select(
        "run_id", "run_type", "overall_pct", "consolidated_grade", "num_tests", "num_criteria", "category_scores",
        "avg_latency", "p95_latency", "total_tokens", "estimated_cost")


@query("append_repeated", with_tables("runs") + "SELECT run_type, count(*) AS n, CAST(sum(CAST(round(overall_pct * 10) AS BIGINT)) AS BIGINT) AS tenths, max(num_tests) AS num_tests FROM runs GROUP BY run_type")
def append_repeated(spark, d):
    """Runs appended with other numbers, then whole, then one half again: the table holds each run once, as it was appended last."""
    path, runs = shared_dir(spark, "history"), b.eval_runs(spark, d)
    odd = F.col("id") % 2 == 1
    for rows in (runs.withColumns({"overall_pct": F.lit(0.0), "num_tests": F.lit(10**6).cast("long")}), runs, runs.filter(odd)):
        keyed.put_rows(rows, path, ["id"], "run_type", buckets=4)
    return tables.read_history(spark, path).groupBy("run_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("overall_pct") * 10).cast("long")).alias("tenths"), F.max("num_tests").alias("num_tests"))


@query("append_red_team_run", with_tables("red_team") + f"""SELECT run_id, 'red_team' AS run_type, 'Red Team Assessment' AS prompt_name, rate AS overall_pct,
  {sql_verdict('rate')} AS grade, attacks AS num_tests, 0 AS num_criteria, category_scores, 'Pass rate: ' || printf('%.1f', rate) || '% | ' || attacks || ' attacks' AS notes FROM (
  SELECT run_id, coalesce({b.sql_round(b.sql_avg('CASE WHEN pass_rate >= 0 THEN pass_rate END'), 1)}, 0.0) AS rate, CAST(sum(total) AS BIGINT) AS attacks,
  '{{' || string_agg('"' || vulnerability || '":{{"pass_rate":' || printf('%.1f', pass_rate) || ',"total":' || total || ',"passed":' || passed
    || ',"failed":' || (total - passed) || ',"errored":' || errored || '}}', ',' ORDER BY vulnerability) || '}}' AS category_scores FROM (
  SELECT case_id % 10 AS run_id, vulnerability, coalesce({b.sql_pct('count(*) FILTER (error IS NULL AND passed)', 'count(*) FILTER (error IS NULL)')}, -1.0) AS pass_rate,
  count(*) FILTER (error IS NULL) AS total, count(*) FILTER (error IS NULL AND passed) AS passed, count(*) FILTER (error IS NOT NULL) AS errored FROM red_team GROUP BY case_id % 10, vulnerability) v GROUP BY run_id) r""")
def append_red_team_run(spark, d):
    cases = redteam.clean_red_team_cases(b.red_team_cases(spark, d)).withColumn("run_id", F.col("case_id") % 10)
    overview = redteam.red_team_overview(cases, ("run_id",))
    path = shared_dir(spark, "history")
    tables.append_eval_runs(history.red_team_rows(overview, redteam.red_team_overall(overview, ("run_id",))), path)
    return tables.read_history(spark, path).select(
        "run_id", "run_type", "prompt_name", "overall_pct", "grade", "num_tests", "num_criteria", "category_scores", "notes")


@query("append_calibration_run", with_tables("calibrated") + f"""SELECT run_id, accuracy, avg_deviation, total_tests, passed, failed, discrimination, issues_count,
  avg_excellent, avg_adequate, avg_poor, avg_misleading, issues_count AS issue_rows FROM (
  SELECT test_id % 8 AS run_id, {SQL_METRICS}, {SQL_GAP}, count(*) FILTER ({SQL_IS_ISSUE}) AS issues_count, {SQL_TIERS} FROM calibrated GROUP BY test_id % 8) c""")
def append_calibration_run(spark, d):
    """Headline rows and issue lines written to two tables and read back together."""
    results = calibrate.calibration_results(b.gold_rows(spark, d)).withColumn("run_id", F.col("test_id") % 8)
    runs_path, issues_path = shared_dir(spark, "calibration"), shared_dir(spark, "issues")
    issues = calibrate.calibration_issues(results).select("run_id", "test_id", "issue")
    tables.append_calibration_run(calibrate.calibration_run(results, ("run_id",)), issues, runs_path, issues_path)
    counts = keyed.read_keyed(spark, issues_path).groupBy("run_id").agg(F.count(F.lit(1)).alias("issue_rows"))
    return keyed.read_keyed(spark, runs_path).join(counts, "run_id", "left").withColumn("issue_rows", F.coalesce("issue_rows", F.lit(0)))


@query("append_role_version", with_tables("versions") + """SELECT role_slug, id, substr(md5(prompt_text), 1, 8) AS prompt_hash,
  CASE WHEN test_cases = '' THEN '' ELSE substr(md5(test_cases), 1, 8) END AS test_hash, '' AS context_hash FROM versions""")
def append_role_version(spark, d):
    path = shared_dir(spark, "versions")
    tables.append_role_version(b.versions(spark, d), path)
    return keyed.read_keyed(spark, path).select("role_slug", "id", "prompt_hash", "test_hash", "context_hash")


@query("evolve_schema", with_tables("runs") + """SELECT id, overall_pct, CASE WHEN run_type <> 'evaluation' THEN dag_pct END AS dag_pct,
  CASE WHEN run_type <> 'evaluation' THEN consolidated_grade END AS consolidated_grade, CASE WHEN run_type <> 'evaluation' THEN report_path END AS report_path FROM runs""")
def evolve_schema(spark, d):
    """Evaluation rows in the old shape and other rows in the new one, read as one table."""
    path = shared_dir(spark, "history")
    runs = b.eval_runs(spark, d)
    tables.append_rows(runs.filter(F.col("run_type") == "evaluation").select("id", "overall_pct", "run_type"), path, "run_type")
    tables.append_rows(runs.filter(F.col("run_type") != "evaluation"), path, "run_type")
    return tables.read_history(spark, path).select("id", "overall_pct", "dag_pct", "consolidated_grade", "report_path")


# --- versions ------------------------------------------------------------------------

@query("version_history", with_tables("versions") + """SELECT id, role_slug, author, length(prompt_text) AS prompt_len, length(test_cases) AS test_len,
  length(context_text) AS context_len FROM versions WHERE role_slug = 7 ORDER BY id DESC LIMIT 20""")
def version_history(spark, d):
    return versions.version_history(b.versions(spark, d), 7)


@query("version_detail", with_tables("versions") + "SELECT * FROM versions WHERE id = 3")
def version_detail(spark, d):
    return versions.version_detail(b.versions(spark, d), 3)


@query("latest_version", with_tables("versions") + "SELECT role_slug, max(id) AS latest_id, count(*) AS num_versions FROM versions GROUP BY role_slug")
def latest_version(spark, d):
    return versions.latest_version(b.versions(spark, d))


@query("previous_version", with_tables("versions") + "SELECT role_slug, id, lag(id) OVER (PARTITION BY role_slug ORDER BY id) AS previous_id FROM versions")
def previous_version(spark, d):
    return versions.previous_version(b.versions(spark, d))


LINE_DIFF = """SELECT role_slug, id, previous_id, line_no, old_line, new_line, CASE WHEN old_line = new_line THEN 'same' WHEN old_line = '' THEN 'added'
  WHEN new_line = '' THEN 'removed' ELSE 'changed' END AS status FROM (
  SELECT role_slug, id, previous_id, n AS line_no, coalesce(o[n], '') AS old_line, coalesce(w[n], '') AS new_line FROM (
  SELECT role_slug, id, previous_id, o, w, unnest(range(1, greatest(len(o), len(w)) + 1)) AS n FROM (
  SELECT role_slug, id, previous_id, string_split(prev, chr(10)) AS o, string_split(prompt_text, chr(10)) AS w FROM (
  SELECT role_slug, id, prompt_text, lag(id) OVER v AS previous_id, lag(prompt_text) OVER v AS prev FROM versions
  WINDOW v AS (PARTITION BY role_slug ORDER BY id)) a WHERE previous_id IS NOT NULL) b) c) e"""


@query("version_line_diff", with_tables("versions") + LINE_DIFF)
def version_line_diff(spark, d):
    return versions.version_line_diff(b.versions(spark, d))


@query("diff_summary", with_tables("versions") + f"SELECT role_slug, id, status, count(*) AS num_lines FROM ({LINE_DIFF}) x GROUP BY role_slug, id, status")
def diff_summary(spark, d):
    return versions.diff_summary(versions.version_line_diff(b.versions(spark, d)))


@query("restore_version", with_tables("versions") + """SELECT v.role_slug, m.last + 1 AS id, v.prompt_text, v.test_cases, 'Restored version ' || v.id AS change_note
  FROM versions v JOIN (SELECT role_slug, min(id) AS first, max(id) AS last FROM versions GROUP BY role_slug) m ON m.role_slug = v.role_slug AND m.first = v.id""")
def restore_version(spark, d):
    rows = b.versions(spark, d)
    first = rows.groupBy("role_slug").agg(F.min("id").alias("id"))
    return versions.restore_version(rows, first).select("role_slug", "id", "prompt_text", "test_cases", "change_note")


@query("carried_forward", with_tables("versions") + """SELECT role_slug, id, last_value(nullif(test_cases, '') IGNORE NULLS) OVER
  (PARTITION BY role_slug ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS test_cases FROM versions""")
def carried_forward(spark, d):
    return versions.carried_forward(b.versions(spark, d), "test_cases").select("role_slug", "id", "test_cases")


# --- streams -------------------------------------------------------------------------

def _stream(spark, d, name):
    schema = b.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _finish(stream) -> None:
    stream.awaitTermination()


@query("run_progress", with_tables("calls") + "SELECT run_id, count(DISTINCT test_id) AS done, arg_max(test_id, started_at) AS last_test FROM calls GROUP BY run_id")
def run_progress(spark, d):
    """The call log as a stream, run to its end; the newest state of every run is read back."""
    calls = b.calls_of(_stream(spark, d, "events")).select("run_id", "test_id", "started_at")
    table, checkpoint = shared_dir(spark, "progress"), shared_dir(spark, "progress-checkpoint")
    _finish(progress.write_progress(progress.run_progress(calls), table, checkpoint, available_now=True))
    return progress.latest_progress(spark.read.parquet(table)).select("run_id", "done", "last_test")


#: Time without a call after which a run counts as stalled. No two calls are as far apart to the microsecond.
STALL_US = 21_600_000_500


@query("run_status", with_tables("calls") + f"""SELECT run_id, done, total, last_test, CASE WHEN done >= total THEN 'done'
  WHEN last_us + {STALL_US} < (SELECT max(epoch_us(started_at)) FROM calls) - 3600000000 THEN 'stalled' ELSE 'running' END AS status FROM (
  SELECT run_id, count(DISTINCT test_id) AS done, count(DISTINCT test_id) + run_id % 3 % 2 AS total, CAST(arg_max(test_id, started_at) AS VARCHAR) AS last_test,
  max(epoch_us(started_at)) AS last_us FROM calls GROUP BY run_id) r""")
def run_status(spark, d):
    """The call log and the starts of its runs as streams, run to their end. Every third run asks for one test more than it has calls of."""
    starts = b.calls(spark, d).groupBy("run_id").agg((F.count_distinct("test_id") + F.col("run_id") % 3 % 2).alias("total"), F.min("started_at").alias("started_at"))
    path, table, checkpoint = shared_dir(spark, "starts"), shared_dir(spark, "status"), shared_dir(spark, "status-checkpoint")
    starts.write.parquet(path)
    own = spark.newSession()  # its state store setting is its own
    for name, value in tracker.STATE_STORE.items():
        own.conf.set(name, value)
    events = tracker.run_events(own.readStream.schema(starts.schema).parquet(path), b.calls_of(_stream(own, d, "events")))
    _finish(progress.write_progress(tracker.tracked_runs(events, stall_after_ms=STALL_US // 1000, forget_after_ms=10**12), table, checkpoint, available_now=True))
    return progress.latest_progress(batches.read_batches(spark, table)).select("run_id", "done", "total", "last_test", "status")


@query("run_progress_batch", with_tables("calls") + "SELECT run_id, count(DISTINCT test_id) AS done, arg_max(test_id, started_at) AS last_test FROM calls GROUP BY run_id")
def run_progress_batch(spark, d):
    return progress.batch_progress(b.calls(spark, d))


@query("append_history_stream", "SELECT o_orderkey AS run_id, o_orderpriority AS role, o_totalprice AS total FROM orders")
def append_history_stream(spark, d):
    runs = _stream(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("role"), F.col("o_totalprice").alias("total"))
    table, checkpoint = shared_dir(spark, "finished"), shared_dir(spark, "finished-checkpoint")
    _finish(finished_runs.append_history_stream(runs, table, checkpoint, available_now=True))
    return finished_runs.read_history_stream(spark, table)
