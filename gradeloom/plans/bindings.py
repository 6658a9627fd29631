"""The given tables read as the engine's tables, and the same readings as SQL.

Each reading covers its whole table. `SQL` holds common table expressions by name; the
function of the same name builds the DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import half_up
from ..functions import fixed_values as fv, labels
from ..operators.spread import numbered

PATTERN_BRANDS = {
    "Brand#1": "Code Quality", "Brand#2": "Security", "Brand#3": "Guardrails", "Brand#4": "Ambiguity Handling",
}
CRITERION_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL building blocks -------------------------------------------------------------

def sql_round(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,9)), {digits}) AS DOUBLE)"


def sql_sum(value: str) -> str:
    return f"CAST(sum(CAST({value} AS DECIMAL(20,12))) AS DOUBLE)"


def sql_avg(value: str) -> str:
    return f"{sql_sum(value)} / nullif(count({value}), 0)"


def sql_units_avg(value: str) -> str:
    return (f"CAST(sum(CAST(floor({value} * 1000000 + 0.5) AS BIGINT)) AS DOUBLE)"
            f" / CAST(nullif(count({value}) * 1000000, 0) AS DOUBLE)")


def sql_pct(part: str, whole: str) -> str:
    return sql_round(f"CAST({part} AS DOUBLE) / CAST(nullif({whole}, 0) AS DOUBLE) * 100", 1)


def sql_whole_pct(score: str) -> str:
    return f"CAST(CAST({sql_round(f'{score} * 100', 0)} AS BIGINT) AS VARCHAR) || '%'"


def sql_grade(pct: str) -> str:
    return (f"CASE WHEN {pct} IS NULL THEN NULL WHEN {pct} >= 95 THEN 'A+' WHEN {pct} >= 90 THEN 'A' WHEN {pct} >= 85 THEN 'A-' "
            f"WHEN {pct} >= 80 THEN 'B+' WHEN {pct} >= 75 THEN 'B' WHEN {pct} >= 70 THEN 'B-' "
            f"WHEN {pct} >= 65 THEN 'C+' WHEN {pct} >= 60 THEN 'C' ELSE 'D' END")


def sql_verdict(pct: str) -> str:
    return f"CASE WHEN {pct} >= 90 THEN 'PASS' WHEN {pct} >= 70 THEN 'WARN' ELSE 'FAIL' END"


def sql_direction(delta: str) -> str:
    return f"CASE WHEN {delta} > 0 THEN 'up' WHEN {delta} < 0 THEN 'down' ELSE 'equal' END"


SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    SQL[name], NEEDS[name] = sql, needs


def with_tables(*names: str) -> str:
    """WITH clause of the named expressions and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in NEEDS[name]:
                visit(needed)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"


# --- criterion verdicts (lineitem) and test cases (part) -----------------------------

def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = supplier, test = part; a test's criteria are its line items."""
    line = table(spark, sf_dir, "lineitem")
    passed = {
        "Addressed": F.col("l_linestatus") == "F", "Specificity": F.col("l_quantity") >= 25,
        "Actionability": F.col("l_tax") >= 0.04, "Accuracy": F.col("l_returnflag") != "R",
    }
    entries = [x for n, p in passed.items()
               for x in (F.lit(n), F.struct(p.cast("double").alias("score"), p.alias("passed")))]
    return line.select(
        F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("test_id"), F.col("l_partkey").alias("test_seq"),
        *CRITERION_ORDER,
        (F.floor(F.col("l_discount") * 100 + 0.5) / 10.0).alias("score"),
        F.when(F.col("l_returnflag") != "A", F.floor(F.col("l_tax") * 100 + 0.5) / 10.0).alias("dag_score"),
        F.concat(F.lit("Explains order "), F.col("l_orderkey").cast("string"), F.lit(" line "),
                 F.col("l_linenumber").cast("string"),
                 F.lit(" with the agreed discount, tax and return status in enough detail for a reader")).alias("text"),
        F.create_map(*entries).alias("dag_dimensions"),
    )


def criteria_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the position of each criterion in its test. One (run, test) may hold any share of
    the rows, so the positions are counted in ranges of the order key."""
    return numbered(criteria(spark, sf_dir), ["run_id", "test_id"], CRITERION_ORDER, "criterion_seq", width=1 << 16)


define("criteria", """SELECT l_suppkey AS run_id, l_partkey AS test_id, l_partkey AS test_seq,
  l_orderkey, l_linenumber, l_extendedprice, l_shipdate,
  floor(l_discount * 100 + 0.5) / 10.0 AS score,
  CASE WHEN l_returnflag <> 'A' THEN floor(l_tax * 100 + 0.5) / 10.0 END AS dag_score,
  'Explains order ' || l_orderkey || ' line ' || l_linenumber
    || ' with the agreed discount, tax and return status in enough detail for a reader' AS text,
  l_linestatus = 'F' AS addressed, l_quantity >= 25 AS specific, l_tax >= 0.04 AS actionable,
  l_returnflag <> 'R' AS accurate,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey
    ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS criterion_seq
  FROM lineitem""")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    category = brand
    for name, known in PATTERN_BRANDS.items():
        category = F.when(brand == name, F.lit(known)).otherwise(category)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("test_id"), category.alias("category"),
        (F.col("p_size") % 3 + 1).alias("weight"), F.col("p_name").alias("question"), F.col("p_type").alias("role_slug"),
    )


define("cases", "SELECT p_partkey AS test_id, CASE " + " ".join(
    f"WHEN p_brand = '{b}' THEN '{c}'" for b, c in PATTERN_BRANDS.items()
) + " ELSE p_brand END AS category, p_size % 3 + 1 AS weight, p_name AS question, p_type AS role_slug FROM part")

define("test_scores", f"""SELECT run_id, test_id, min(test_seq) AS test_seq, count(*) AS num_criteria,
  {sql_units_avg('score')} AS score, {sql_units_avg('dag_score')} AS dag_score FROM criteria GROUP BY run_id, test_id""",
       "criteria")
define("tests", f"""SELECT s.run_id, s.test_id, s.test_seq, s.num_criteria, s.score, s.dag_score, c.category, c.weight,
  {sql_round('s.score * 100', 1)} AS score_pct, {sql_round('s.dag_score * 100', 1)} AS dag_score_pct
  FROM test_scores s JOIN cases c ON s.test_id = c.test_id""", "test_scores", "cases")
define("run_sums", f"""SELECT run_id, {sql_sum('score * weight')} AS ws, CAST(sum(weight) AS BIGINT) AS w,
  {sql_sum('CASE WHEN dag_score IS NOT NULL THEN dag_score * weight END')} AS dws,
  CAST(sum(CASE WHEN dag_score IS NOT NULL THEN weight END) AS BIGINT) AS dw,
  count(*) AS num_tests, CAST(sum(num_criteria) AS BIGINT) AS num_criteria FROM tests GROUP BY run_id""", "tests")
define("run_pcts", f"""SELECT run_id, num_tests, num_criteria, coalesce(ws / nullif(w, 0), 0) AS overall_score,
  {sql_round('coalesce(ws / nullif(w, 0), 0) * 100', 1)} AS overall_pct,
  {sql_round('dws / nullif(dw, 0) * 100', 1)} AS dag_pct FROM run_sums""", "run_sums")
define("run_scores", f"""SELECT *, {sql_grade('overall_pct')} AS grade, {sql_grade('consolidated_pct')} AS consolidated_grade
  FROM (SELECT *, coalesce({sql_round('overall_pct * 0.6 + dag_pct * 0.4', 1)}, overall_pct) AS consolidated_pct
  FROM run_pcts) p""", "run_pcts")
define("category_scores", f"""SELECT run_id, category, category_score, num_tests, first_seq,
  {sql_round('category_score * 100', 1)} AS category_pct, {sql_round('dag * 100', 1)} AS category_dag_pct
  FROM (SELECT run_id, category, {sql_avg('score')} AS category_score, {sql_avg('dag_score')} AS dag,
  count(*) AS num_tests, min(test_seq) AS first_seq FROM tests GROUP BY run_id, category) c""", "tests")


# --- model calls (events) ------------------------------------------------------------

CALL_ERRORS = ["429 rate limit exceeded", "Connection reset by peer", "invalid api key", "content policy violation"]
CALL_MODELS = {"view": "gpt-4o-2024-11-20", "click": "GPT-4o-mini-2024-07-18", "signup": "gpt-4.1-nano-x",
               "purchase": "us.claude-sonnet-4-20250514", "error": "error"}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """run = user, test = event; error events are failed calls."""
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    model = F.lit(None).cast("string")
    for kind, name in CALL_MODELS.items():
        model = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(model)
    errors = F.array(*[F.lit(e) for e in CALL_ERRORS])
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("test_id"), F.col("event_id").alias("test_seq"),
        F.col("ts").alias("started_at"), k.alias("k"),
        F.when(failed, F.element_at(errors, (k % 4 + 1).cast("int"))).alias("error"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("value")).alias("latency_seconds"),
        (F.col("event_id") % 1000).alias("input_tokens"), k.alias("output_tokens"),
        (F.col("event_id") % 300).alias("response_words"), model.alias("model_id"),
        F.concat(F.lit("role_"), (F.col("user_id") % 5).cast("string")).alias("role"),
        (F.col("event_id") % 3 + 1).alias("attempt"),
    )


define("calls", """SELECT user_id AS run_id, event_id AS test_id, event_id AS test_seq, ts AS started_at, k,
  CASE WHEN event_type = 'error' THEN CASE k % 4 """ + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(CALL_ERRORS)) + """ END END AS error,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS latency_seconds,
  event_id % 1000 AS input_tokens, k AS output_tokens, event_id % 300 AS response_words, CASE event_type """ + " ".join(
    f"WHEN '{t}' THEN '{m}'" for t, m in CALL_MODELS.items()) + """ END AS model_id,
  'role_' || (user_id % 5) AS role, event_id % 3 + 1 AS attempt
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e""")


def sql_price_key(model: str, mode: str = "longest") -> str:
    from ..functions.fixed_values import COST_TABLE
    rows = sorted(COST_TABLE, key=lambda r: -len(r[0])) if mode == "longest" else COST_TABLE
    return "CASE " + " ".join(f"WHEN contains(lower({model}), '{r[0]}') THEN '{r[0]}'" for r in rows) + " END"


def _price_rows() -> str:
    from ..functions.fixed_values import COST_TABLE
    return "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for k, i, o in COST_TABLE) + ") t(price_key, price_in, price_out)"


define("prices", _price_rows())
for _mode in ("longest", "first"):
    define(f"priced_{_mode}", f"""SELECT c.*, p.price_key,
      coalesce((input_tokens * p.price_in + output_tokens * p.price_out) / 1000000.0, 0.0) AS estimated_cost_usd
      FROM (SELECT *, {sql_price_key('model_id', _mode)} AS wanted FROM calls) c LEFT JOIN prices p ON p.price_key = c.wanted""",
           "calls", "prices")


# --- gold items (labels), safety (documents, labels) ---------------------------------

def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    tier = (F.when(good & ~toxic, "excellent").when(good, "adequate").when(~toxic, "poor").otherwise("misleading"))
    rows = table(spark, sf_dir, "labels").select("doc_id", tier.alias("quality"))
    expected = F.when(F.col("quality") == "excellent", 0.95).when(F.col("quality") == "adequate", 0.35).otherwise(0.0)
    return rows.select(
        F.col("doc_id").alias("test_id"), "quality", expected.alias("expected"),
        (F.col("doc_id") % 21 * 5 / 100.0).alias("geval"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string"),
                 F.lit(" is judged the way a human reader would judge it")).alias("criterion"),
    )


define("gold", """SELECT doc_id AS test_id, tier AS quality,
  CAST(CASE tier WHEN 'excellent' THEN 0.95 WHEN 'adequate' THEN 0.35 ELSE 0.0 END AS DOUBLE) AS expected,
  CAST(doc_id % 21 * 5 AS DOUBLE) / 100.0 AS geval,
  'Document ' || doc_id || ' is judged the way a human reader would judge it' AS criterion
  FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'excellent' WHEN quality = 1 THEN 'adequate'
    WHEN toxic = 0 THEN 'poor' ELSE 'misleading' END AS tier FROM labels) l""")
define("calibrated", """SELECT *, CAST(abs(CAST(expected AS DECIMAL(12,6)) - CAST(geval AS DECIMAL(12,6))) AS DOUBLE) AS deviation,
  abs(CAST(expected AS DECIMAL(12,6)) - CAST(geval AS DECIMAL(12,6))) <= CAST(0.25 AS DECIMAL(12,6)) AS passed FROM gold""", "gold")


def gold_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the dimensions of the gold items; every tenth item has none, and one dimension of every seventh failed."""
    entries = []
    for i, name in enumerate(fv.DIMENSION_WEIGHTS):
        passed = (F.col("doc_id") + i) % 3 != 0
        entries += [F.lit(name), F.struct(F.lit(0.5).alias("score"), F.when(F.col("doc_id") % 7 != i, passed).alias("passed"))]
    return table(spark, sf_dir, "labels").filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("test_id"), F.create_map(*entries).alias("dag_dimensions"))


SQL_GOLD_DAG = " + ".join(f"CASE WHEN test_id % 7 <> {i} AND (test_id + {i}) % 3 <> 0 THEN {w} ELSE 0 END" for i, w in enumerate(fv.DIMENSION_WEIGHTS.values()))


def safety_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = source, test = document; an unlabeled document is a check that failed to run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    scores = F.array(
        F.struct(F.lit("toxicity").alias("metric"), (F.col("toxic") * 0.9).alias("score")),
        F.struct(F.lit("bias").alias("metric"), ((1 - F.col("quality")) * 0.75).alias("score")),
    )
    return found.select(F.col("source").alias("run_id"), F.col("doc_id").alias("test_id"), F.inline(scores)).select(
        "*", F.coalesce(F.col("score") <= 0.5, F.lit(False)).alias("passed"), F.lit("from labels").alias("reason"))


define("safety", """SELECT d.source AS run_id, d.doc_id AS test_id, m.metric,
  CASE m.metric WHEN 'toxicity' THEN l.toxic * CAST(0.9 AS DOUBLE) ELSE (1 - l.quality) * CAST(0.75 AS DOUBLE) END AS score,
  coalesce(CASE m.metric WHEN 'toxicity' THEN l.toxic * 0.9 ELSE (1 - l.quality) * 0.75 END <= 0.5, false) AS passed,
  'from labels' AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('toxicity'), ('bias')) m(metric)""")


# --- versions and conversations ------------------------------------------------------

def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role = conversation, version = turn; tests are given only with user turns."""
    given = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("role_slug"), F.col("turn").alias("id"), F.col("text").alias("prompt_text"),
        F.when(given, F.concat(F.lit("tests of turn "), F.col("turn").cast("string"))).otherwise("").alias("test_cases"),
        F.lit("").alias("context_text"), F.col("role").alias("author"),
    )


define("versions", """SELECT conv_id AS role_slug, turn AS id, text AS prompt_text,
  CASE WHEN role = 'user' THEN 'tests of turn ' || turn ELSE '' END AS test_cases, '' AS context_text, role AS author
  FROM conversations""")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn right after it; run = conversation, test = turn. The
    system turn opens a conversation, so it is turn 0."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(said, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("test_id"), F.col("turn").alias("test_seq"), "question", "response")


define("answers", """SELECT u.conv_id AS run_id, u.turn AS test_id, u.turn AS test_seq, u.text AS question, a.text AS response
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'""")


# --- documents as reference docs -----------------------------------------------------

def reference_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("role_slug"), F.format_string("doc_%09d.md", "doc_id").alias("file_name"),
        F.col("text").alias("content"))


def doc_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with documents (sources) and without (languages)."""
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.col("source").alias("role_slug")).distinct().union(docs.select("lang").distinct())
    return names.withColumn("system_prompt", F.concat(F.lit("You help the team of "), F.col("role_slug")))


define("docs", "SELECT source AS role_slug, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS file_name, text AS content FROM documents")
define("doc_roles", """SELECT role_slug, 'You help the team of ' || role_slug AS system_prompt FROM
  (SELECT DISTINCT source AS role_slug FROM documents UNION ALL SELECT DISTINCT lang FROM documents) r""")


# --- red-team cases (events) ---------------------------------------------------------

ATTACK_NAMES = ["Base64", "ROT13", ""]


def red_team_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    group = F.col("user_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("case_id"),
        F.when(group < 2, F.concat(F.lit("vulnerability_"), group.cast("string"))).otherwise("").alias("vulnerability"),
        F.when(group == 2, F.lit("type_2")).alias("vulnerability_type"),
        F.element_at(F.array(*[F.lit(a) for a in ATTACK_NAMES]), (k % 3 + 1).cast("int")).alias("attack"),
        F.expr("repeat(props, 60)").alias("input"), F.concat(F.col("event_type"), F.expr("repeat(props, 2)")).alias("output"),
        F.lit(None).cast("array<struct<role:string,content:string>>").alias("turns"),
        F.when(k % 10 != 0, F.least(F.col("value") / 60.0, F.lit(1.0))).alias("score"),
        F.expr("repeat(event_type, 50)").alias("reason"),
        F.when(F.col("event_type") == "error",
               F.when(k % 2 == 0, "The response was filtered by policy").otherwise("other failure")).alias("error"),
    )


define("red_team_raw", """SELECT event_id AS case_id,
  CASE WHEN user_id % 4 < 2 THEN 'vulnerability_' || (user_id % 4) ELSE '' END AS vulnerability,
  CASE WHEN user_id % 4 = 2 THEN 'type_2' END AS vulnerability_type,
  CASE k % 3 WHEN 0 THEN 'Base64' WHEN 1 THEN 'ROT13' ELSE '' END AS attack,
  repeat(props, 60) AS input, event_type || repeat(props, 2) AS output,
  CASE WHEN k % 10 <> 0 THEN least(value / 60.0, 1.0) END AS score, repeat(event_type, 50) AS reason,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'The response was filtered by policy' ELSE 'other failure' END END AS error
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e""")
define("red_team", """SELECT case_id, coalesce(nullif(vulnerability, ''), nullif(vulnerability_type, ''), 'Unknown') AS vulnerability,
  coalesce(nullif(attack, ''), 'Unknown') AS attack, substr(input, 1, 500) AS input, substr(output, 1, 500) AS output,
  coalesce(score, 0.0) AS score, coalesce(score, 0.0) >= 0.5 AS passed, substr(reason, 1, 300) AS reason,
  CASE WHEN contains(error, 'response was filt') THEN 'Azure content filter blocked attack generation (model refused to produce toxic/harmful content)' ELSE error END AS error
  FROM red_team_raw""", "red_team_raw")
define("red_team_overview", f"""SELECT vulnerability, coalesce({sql_pct('passed', 'total')}, -1.0) AS pass_rate, total, passed, total - passed AS failed, errored
  FROM (SELECT vulnerability, count(*) FILTER (error IS NULL) AS total, count(*) FILTER (error IS NULL AND passed) AS passed,
  count(*) FILTER (error IS NOT NULL) AS errored FROM red_team GROUP BY vulnerability) v""", "red_team")


# --- run history (orders) ------------------------------------------------------------

def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id = order; neighbours with status O are the two sides of a comparison."""
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    overall = F.col("o_custkey") % 1001 / 10.0
    dag = F.when(key % 5 != 0, key % 1001 / 10.0)
    runs = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("role"),
        F.when(key % 7 != 0, F.concat(F.lit("model-"), (key % 3).cast("string"))).otherwise("").alias("model"),
        F.when(key % 4 != 0, F.lit("judge-1")).alias("judge_model"),
        overall.alias("overall_pct"), dag.alias("dag_pct"),
        F.when(status == "F", "evaluation").when(status == "P", "red_team").when(key % 2 == 0, "comparison_A")
        .otherwise("comparison_B").alias("run_type"),
        F.concat(F.lit("reports/run_"), F.expr("o_orderkey div 2").cast("string"), F.lit(".html")).alias("report_path"),
        (F.col("o_custkey") % 20).alias("num_tests"), (F.col("o_custkey") % 20 * 5).alias("num_criteria"),
        F.when(key % 6 != 0, F.col("o_custkey") % 300 / 10.0).alias("avg_latency"),
        (key % 400 / 10.0).alias("p95_latency"), (key % 5000).alias("total_tokens"),
        (key % 77 / 100.0).alias("estimated_cost"), (key % 900 / 10.0).alias("total_elapsed"),
        F.concat(F.lit("order "), key.cast("string"), F.lit(", priority "), F.col("o_orderpriority")).alias("notes"),
    )
    return (
        runs.withColumn("grade", labels.grade("overall_pct"))
        .withColumn("consolidated_pct", labels.consolidated("overall_pct", "dag_pct"))
        .withColumn("consolidated_grade", labels.grade("consolidated_pct"))
    )


define("runs", f"""SELECT *, {sql_grade('overall_pct')} AS grade, {sql_grade('consolidated_pct')} AS consolidated_grade FROM (
  SELECT *, coalesce({sql_round('overall_pct * 0.6 + dag_pct * 0.4', 1)}, overall_pct) AS consolidated_pct FROM (
  SELECT o_orderkey AS id, o_orderdate AS timestamp, o_orderpriority AS role,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'model-' || (o_orderkey % 3) ELSE '' END AS model,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'judge-1' END AS judge_model,
  CAST(o_custkey % 1001 AS DOUBLE) / 10.0 AS overall_pct,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 1001 AS DOUBLE) / 10.0 END AS dag_pct,
  CASE o_orderstatus WHEN 'F' THEN 'evaluation' WHEN 'P' THEN 'red_team' ELSE
    CASE WHEN o_orderkey % 2 = 0 THEN 'comparison_A' ELSE 'comparison_B' END END AS run_type,
  'reports/run_' || (o_orderkey // 2) || '.html' AS report_path,
  o_custkey % 20 AS num_tests, o_custkey % 20 * 5 AS num_criteria,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey % 300 AS DOUBLE) / 10.0 END AS avg_latency,
  CAST(o_orderkey % 400 AS DOUBLE) / 10.0 AS p95_latency, o_orderkey % 5000 AS total_tokens,
  CAST(o_orderkey % 77 AS DOUBLE) / 100.0 AS estimated_cost, CAST(o_orderkey % 900 AS DOUBLE) / 10.0 AS total_elapsed,
  'order ' || o_orderkey || ', priority ' || o_orderpriority AS notes FROM orders) o) p""")


# --- suites with gaps (part) ---------------------------------------------------------

def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases as they may arrive: fields missing, blank or too many."""
    size = F.col("p_size")
    numbers = F.when(size % 8 > 0, F.sequence(F.lit(1), size % 8)).otherwise(F.array().cast("array<int>"))
    listed = F.transform(numbers, lambda i: F.when((size % 9 == 0) & (i == 1), F.lit(" ")).otherwise(
        F.concat(F.lit("Criterion "), i.cast("string"), F.lit(" for "), F.col("p_name"))))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("role_slug"), (F.col("p_partkey") + 1).alias("test_seq"),
        F.when(size != 11, F.concat(F.lit("T-"), F.col("p_partkey").cast("string"))).alias("test_id"),
        F.when(size % 10 != 3, F.col("p_brand")).alias("category"),
        F.when(size == 7, " ").when(size != 17, F.col("p_name")).alias("question"),
        F.when(size != 13, listed).alias("criteria"),
        F.when(size % 10 != 4, size % 3 + 1).alias("weight"),
        F.when(size % 2 == 0, F.array("p_brand")).when(size % 3 == 0, F.array().cast("array<string>")).alias("context"),
    )


define("raw_cases", """SELECT p_type AS role_slug, p_partkey + 1 AS test_seq,
  CASE WHEN p_size <> 11 THEN 'T-' || p_partkey END AS test_id, CASE WHEN p_size % 10 <> 3 THEN p_brand END AS category,
  CASE WHEN p_size = 7 THEN ' ' WHEN p_size <> 17 THEN p_name END AS question,
  CASE WHEN p_size <> 13 THEN list_transform(range(1, p_size % 8 + 1), lambda i:
    CASE WHEN p_size % 9 = 0 AND i = 1 THEN ' ' ELSE 'Criterion ' || i || ' for ' || p_name END) END AS criteria,
  CASE WHEN p_size % 10 <> 4 THEN p_size % 3 + 1 END AS weight,
  CASE WHEN p_size % 2 = 0 THEN [p_brand] WHEN p_size % 3 = 0 THEN [] END AS context, p_size FROM part""")


def existing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the suite that is known already: small sizes."""
    keep = F.col("test_id").isNotNull()
    sizes = table(spark, sf_dir, "part").filter(F.col("p_size") <= 25).select((F.col("p_partkey") + 1).alias("test_seq"))
    return raw_cases(spark, sf_dir).filter(keep).join(sizes, "test_seq", "left_semi")


def incoming_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case, and every one once more under another category."""
    raw = raw_cases(spark, sf_dir)
    return raw.unionByName(raw.withColumn("category", F.lit("Repeated")).withColumn("test_seq", F.col("test_seq") + 1000000000))


define("existing", "SELECT * FROM raw_cases WHERE test_id IS NOT NULL AND p_size <= 25", "raw_cases")
define("incoming", """SELECT * FROM raw_cases UNION ALL
  SELECT * REPLACE ('Repeated' AS category, test_seq + 1000000000 AS test_seq) FROM raw_cases""", "raw_cases")


# --- model output (events) -----------------------------------------------------------

def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as models return it: plain, fenced, inside prose, cut short or with a tail; with fields of
    other types and with items that are no objects."""
    event = F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    kind = F.expr("event_id div 4 % 5")
    criteria = F.when(kind == 2, F.concat(F.lit('"Names '), k, F.lit('"'))).otherwise(F.concat(F.lit('["Names '), k, F.lit('", "Is short"]')))
    weight = (k.cast("int") % 3 + 1).cast("string")
    weight = F.when(kind == 1, F.concat(F.lit('"'), weight, F.lit('"'))).when(kind == 4, F.concat(weight, F.lit(".5"))).otherwise(weight)
    item = F.concat(
        F.lit('[{"id": "E-'), event, F.lit('", "category": "'), F.col("event_type"), F.lit('", "question": "What about '), k,
        F.lit('?", "criteria": '), criteria, F.lit(', "weight": '), weight,
        F.lit(', "context": "Fact '), k, F.lit('"}, {"id": "F-'), event, F.lit('", "question": "Again?"}'),
        F.when(kind == 3, F.lit(', 5, "loose text"]')).otherwise(F.lit("]")))
    shape = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("text_id"), F.col("event_type").alias("role_slug"),
        F.when(shape == 0, item)
        .when(shape == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here are the cases: "), item, F.lit(" I hope they help.")))
        .when(F.col("event_id") % 8 == 7, F.concat(item, F.lit(', "extra": [1]')))
        .otherwise(F.substring(item, 1, 60)).alias("raw"),
    )


define("model_texts", """SELECT event_id AS text_id, event_type AS role_slug, CASE WHEN event_id % 4 = 0 THEN item
  WHEN event_id % 4 = 1 THEN '```json' || chr(10) || item || chr(10) || '```' WHEN event_id % 4 = 2 THEN 'Here are the cases: ' || item || ' I hope they help.'
  WHEN event_id % 8 = 7 THEN item || ', "extra": [1]' ELSE substr(item, 1, 60) END AS raw FROM (SELECT *, '[{"id": "E-' || event_id || '", "category": "' || event_type
    || '", "question": "What about ' || k || '?", "criteria": ' || CASE WHEN kind = 2 THEN '"Names ' || k || '"' ELSE '["Names ' || k || '", "Is short"]' END
    || ', "weight": ' || CASE kind WHEN 1 THEN '"' || (k % 3 + 1) || '"' WHEN 4 THEN (k % 3 + 1) || '.5' ELSE CAST(k % 3 + 1 AS VARCHAR) END
    || ', "context": "Fact ' || k || '"}, {"id": "F-' || event_id || '", "question": "Again?"}' || CASE WHEN kind = 3 THEN ', 5, "loose text"]' ELSE ']' END AS item
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // 4 % 5 AS kind FROM events) e) i""")
define("cleaned", """SELECT *, trim(CASE WHEN raw LIKE '```%' THEN regexp_replace(split_part(raw, '```', 2), '^json', '') ELSE raw END, chr(10) || ' ') AS plain,
  CASE WHEN instr(raw, '[') > 0 AND instr(raw, ']') > 0 THEN
    substr(raw, instr(raw, '['), length(raw) - instr(reverse(raw), ']') + 1 - instr(raw, '[') + 1) END AS slice FROM model_texts""", "model_texts")
define("parsed", """SELECT text_id, role_slug, raw, CASE how WHEN 'fence' THEN plain WHEN 'slice' THEN slice END AS items,
  how AS parsed_by FROM (SELECT *, CASE WHEN json_valid(plain) AND plain LIKE '[%' THEN 'fence' WHEN coalesce(json_valid(slice), false) THEN 'slice' ELSE 'rejected' END AS how FROM cleaned) c""", "cleaned")
