"""Registered queries: test suites, roles, context, model output, and model calls by stubs."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import fixed_values as fv, text
from ..operators import apply, context, ingest, model_output, queue, recommend, roles
from ..session import shared_dir
from ..sources import documents, json_arrays, tables
from . import bindings as b, stubs
from .bindings import sql_round, with_tables
from .queries_scoring import IMPROVEMENT_PARTS, improvement_inputs_of
from .store import Store

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


def joined(name):
    return F.array_join(name, "|").alias(name)


def sql_joined(name: str) -> str:
    return f"array_to_string({name}, '|') AS {name}"


# --- suites --------------------------------------------------------------------------

def _suite_roles(spark, d):
    part = b.table(spark, d, "part")
    return part.select(F.col("p_type").alias("role_slug")).distinct().union(part.select("p_brand").distinct())


NAME = "coalesce(test_id, CAST(test_seq AS VARCHAR))"
BLANKS = "list_filter(list_transform(range(1, len(criteria) + 1), lambda i: CASE WHEN trim(criteria[i]) = '' THEN i END), lambda x: x IS NOT NULL)"
MISSING = "list_filter([CASE WHEN test_id IS NULL THEN 'id' END, CASE WHEN question IS NULL THEN 'question' END, CASE WHEN criteria IS NULL THEN 'criteria' END], lambda x: x IS NOT NULL)"


@query("suite_violations", with_tables("raw_cases") + f"""
  SELECT role_slug, test_seq, test_id, 'error' AS severity, 'missing_field' AS rule,
    'Test case #' || test_seq || ': missing required fields: ' || array_to_string({MISSING}, ', ') AS message FROM raw_cases WHERE len({MISSING}) > 0
  UNION ALL SELECT role_slug, test_seq, test_id, 'error', 'blank_question', 'Test case ''' || {NAME} || ''': question must be a non-empty string'
    FROM raw_cases WHERE trim(question) = ''
  UNION ALL SELECT role_slug, test_seq, test_id, 'error', 'empty_criteria', 'Test case ''' || {NAME} || ''': criteria must be a non-empty list'
    FROM raw_cases WHERE len(criteria) = 0
  UNION ALL SELECT role_slug, test_seq, test_id, 'error', 'blank_criterion', 'Test ''' || {NAME} || ''': criterion #' || array_to_string({BLANKS}, ', #')
    || ' must be a non-empty string' FROM raw_cases WHERE len({BLANKS}) > 0
  UNION ALL SELECT DISTINCT p_brand, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'error', 'empty_suite', 'Test suite is empty — no test cases to evaluate.'
    FROM part WHERE p_brand NOT IN (SELECT p_type FROM part)""")
def suite_violations(spark, d):
    return ingest.suite_violations(b.raw_cases(spark, d), _suite_roles(spark, d))


@query("suite_warnings", with_tables("raw_cases") + f"""
  SELECT role_slug, test_seq, test_id, 'warning' AS severity, 'no_category' AS rule,
    'Test ''' || {NAME} || ''': no category — will be grouped as ''General''' AS message FROM raw_cases WHERE category IS NULL
  UNION ALL SELECT role_slug, test_seq, test_id, 'warning', 'no_weight', 'Test ''' || {NAME} || ''': no weight — defaulting to 2' FROM raw_cases WHERE weight IS NULL
  UNION ALL SELECT role_slug, test_seq, test_id, 'warning', 'many_criteria', 'Test ''' || {NAME} || ''': ' || len(criteria) || ' criteria (max recommended: 5)'
    FROM raw_cases WHERE len(criteria) > 5""")
def suite_warnings(spark, d):
    return ingest.suite_warnings(b.raw_cases(spark, d))


@query("apply_defaults", with_tables("raw_cases") + """SELECT role_slug, test_seq, coalesce(category, 'General') AS category,
  coalesce(weight, 2) AS weight FROM raw_cases""")
def apply_defaults(spark, d):
    return ingest.apply_defaults(b.raw_cases(spark, d)).select("role_slug", "test_seq", "category", "weight")


@query("normalize_generated", with_tables("raw_cases") + f"""SELECT role_slug, test_seq, true AS generated, true AS needs_review,
  array_to_string(coalesce(criteria, ['{fv.REVIEW_PLACEHOLDER}']), '|') AS criteria, coalesce(weight, 2) AS weight FROM raw_cases""")
def normalize_generated(spark, d):
    return ingest.normalize_generated(b.raw_cases(spark, d)).select(
        "role_slug", "test_seq", "generated", "needs_review", joined("criteria"), "weight")


@query("import_clean", with_tables("raw_cases") + """SELECT role_slug, test_seq, coalesce(test_id, printf('GEN-%02d', test_seq)) AS test_id,
  coalesce(category, 'General') AS category, coalesce(question, '') AS question,
  array_to_string(coalesce(criteria, [])[1:5], '|') AS criteria, coalesce(weight, 2) AS weight,
  CASE WHEN len(context) > 0 THEN array_to_string(context, '|') END AS context FROM raw_cases""")
def import_clean(spark, d):
    return ingest.import_clean(b.raw_cases(spark, d)).select(
        "role_slug", "test_seq", "test_id", "category", "question", joined("criteria"), "weight", joined("context"))


MERGED = """SELECT role_slug, test_seq, test_id, category, question, false AS added FROM existing
  UNION ALL SELECT role_slug, test_seq, test_id, category, question, true FROM (SELECT *, row_number() OVER (PARTITION BY role_slug, test_id ORDER BY test_seq) AS copy FROM (
    SELECT role_slug, test_seq, coalesce(test_id, printf('GEN-%02d', test_seq)) AS test_id, coalesce(category, 'General') AS category,
      coalesce(question, '') AS question
    FROM (SELECT i.* REPLACE (coalesce(l.last, 0) + i.test_seq AS test_seq) FROM incoming i LEFT JOIN
      (SELECT role_slug, max(test_seq) AS last FROM existing GROUP BY role_slug) l ON l.role_slug = i.role_slug) s) c) n
  WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.role_slug = n.role_slug AND e.test_id = n.test_id)"""


def _merged(spark, d):
    return ingest.merge_suite(b.existing_cases(spark, d), b.incoming_cases(spark, d))


@query("merge_suite", with_tables("existing", "incoming") + MERGED)
def merge_suite(spark, d):
    return _merged(spark, d).select("role_slug", "test_seq", "test_id", "category", "question", "added")


@query("merge_counts", with_tables("existing", "incoming")
       + f"SELECT role_slug, count(*) FILTER (added) AS added, count(*) AS total FROM ({MERGED}) m GROUP BY role_slug")
def merge_counts(spark, d):
    return ingest.merge_counts(_merged(spark, d))


@query("suite_diff", with_tables("existing", "incoming") + """SELECT DISTINCT i.role_slug, i.test_id,
  CASE WHEN e.test_id IS NULL THEN 'new' ELSE 'known' END AS status FROM incoming i
  LEFT JOIN existing e ON e.role_slug = i.role_slug AND e.test_id = i.test_id""")
def suite_diff(spark, d):
    return ingest.suite_diff(b.existing_cases(spark, d), b.incoming_cases(spark, d))


@query("explode_criteria", with_tables("raw_cases") + """SELECT role_slug, test_seq, unnest(range(len(criteria))) AS criterion_seq,
  unnest(criteria) AS criterion FROM raw_cases""")
def explode_criteria(spark, d):
    return ingest.explode_criteria(b.raw_cases(spark, d)).select("role_slug", "test_seq", "criterion_seq", "criterion")


@query("suite_profile", with_tables("raw_cases") + """SELECT role_slug, count(*) AS num_tests, CAST(coalesce(sum(len(criteria)), 0) AS BIGINT) AS num_criteria,
  array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), '|') AS categories,
  count(*) FILTER (weight = 1) AS weight_1, count(*) FILTER (weight = 2) AS weight_2, count(*) FILTER (weight = 3) AS weight_3
  FROM raw_cases GROUP BY role_slug""")
def suite_profile(spark, d):
    return ingest.suite_profile(b.raw_cases(spark, d)).withColumn("categories", F.array_join("categories", "|"))


@query("normalize_slug", """SELECT p_partkey, replace(replace(lower(trim('  ' || upper(p_name) || '-V ')), ' ', '_'), '-', '_') AS slug FROM part""")
def normalize_slug(spark, d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("-V "))
    return b.table(spark, d, "part").select("p_partkey", text.normalize_slug(raw).alias("slug"))


@query("manual_lines_to_array", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> '')[1:5], '|') AS criteria FROM documents""")
def manual_lines_to_array(spark, d):
    boxes = b.table(spark, d, "documents").select("doc_id", F.col("text").alias("criteria_text"), F.col("lang").alias("context_text"))
    return ingest.manual_case(boxes).select("doc_id", joined("criteria"))


@query("first_wins_dedup", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def first_wins_dedup(spark, d):
    return ingest.first_wins(b.table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])


@query("missing_fields", with_tables("raw_cases") + f"SELECT test_seq, array_to_string({MISSING}, '|') AS missing FROM raw_cases")
def missing_fields(spark, d):
    fields = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in [("test_id", "id"), ("question", "question"), ("criteria", "criteria")]]))
    return b.raw_cases(spark, d).withColumn("fields", fields).select(
        "test_seq", F.array_join(ingest.missing_fields("fields"), "|").alias("missing"))


@query("save_suite_json", with_tables("raw_cases") + f"""SELECT role_slug, test_seq, test_id, category, question, {sql_joined('criteria')}, weight,
  {sql_joined('context')} FROM raw_cases""")
def save_suite_json(spark, d):
    """Written as JSON and read back with the suite reader."""
    path = shared_dir(spark, "suite")
    tables.save_suite_json(b.raw_cases(spark, d), path)
    return tables.read_test_suite(spark, path).select(
        "role_slug", "test_seq", "test_id", "category", "question", joined("criteria"), "weight", joined("context"))


@query("read_test_suite", with_tables("raw_cases") + "SELECT role_slug || '_v1_weak' AS role_slug, count(*) AS num_tests, min(test_seq) AS first_seq, max(length(question)) AS longest FROM raw_cases GROUP BY role_slug")
def read_test_suite(spark, d):
    """Suites written as JSON, read with the reader, and found for weak variants, which share the suite of their base role."""
    path = shared_dir(spark, "suite")
    tables.save_suite_json(b.raw_cases(spark, d), path)
    cases = tables.read_test_suite(spark, path)
    weak = cases.select(F.concat("role_slug", F.lit(fv.WEAK_SUFFIX)).alias("variant")).distinct()
    return (weak.withColumn("role_slug", text.base_slug("variant")).join(cases, "role_slug").groupBy(F.col("variant").alias("role_slug"))
            .agg(F.count(F.lit(1)).alias("num_tests"), F.min("test_seq").alias("first_seq"), F.max(F.length("question")).alias("longest")))


@query("read_generated_json", with_tables("raw_cases") + f"""SELECT test_id, category, {sql_joined('criteria')}, coalesce(weight, 2) AS weight
  FROM (SELECT * REPLACE (coalesce(criteria, ['{fv.REVIEW_PLACEHOLDER}']) AS criteria) FROM raw_cases) r""")
def read_generated_json(spark, d):
    """Cases written as JSON arrays of up to a hundred (their numbers are unique), then read
    the way generated output is read."""
    path = shared_dir(spark, "generated")
    fields = F.struct(F.col("test_id").alias("id"), "category", "question", "criteria", "weight")
    lines = b.raw_cases(spark, d).select(F.expr("test_seq div 100").alias("_array"), F.to_json(fields).alias("_case"))
    arrays = lines.groupBy("_array").agg(F.concat(F.lit("["), F.array_join(F.collect_list("_case"), ", "), F.lit("]")).alias("value"))
    arrays.select("value").write.text(path)
    cases, _ = tables.read_generated_json(spark, path, per_line=True)
    return cases.select("test_id", "category", joined("criteria"), "weight")


@query("read_generated_arrays", with_tables("raw_cases") + f"""SELECT role_slug, CAST(row_number() OVER (PARTITION BY role_slug ORDER BY r.test_seq) AS BIGINT) AS test_seq, test_id, category,
  {sql_joined('criteria')}, coalesce(weight, 2) AS weight
  FROM (SELECT * REPLACE (coalesce(criteria, ['{fv.REVIEW_PLACEHOLDER}']) AS criteria) FROM raw_cases) r""")
def read_generated_arrays(spark, d):
    """Cases written as one JSON array for each role, and read back by ranges of 4 KB: most arrays are cut many times."""
    root = shared_dir(spark, "generated-arrays")
    fields = F.struct(F.col("test_id").alias("id"), "category", "question", "criteria", "weight")
    lines = b.raw_cases(spark, d).select("role_slug", "test_seq", F.to_json(fields).alias("item"))
    ordered = F.array_sort(F.collect_list(F.struct("test_seq", "item")))["item"]
    arrays = lines.groupBy("role_slug").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("content"))
    documents.write_files(arrays.withColumn("path", F.concat(F.replace("role_slug", F.lit(" "), F.lit("_")), F.lit(".json"))), root)
    cases, _ = json_arrays.read_arrays(spark, root, range_bytes=4096)
    slug = F.replace(F.regexp_extract("path", r"([^/]+)\.json$", 1), F.lit("_"), F.lit(" "))
    return cases.select(slug.alias("role_slug"), "test_seq", "test_id", "category", joined("criteria"), "weight")


# --- roles and run requests ----------------------------------------------------------

def _roles(spark, d):
    """Types are roles, half of them with a weak variant; brands lack metadata."""
    part = b.table(spark, d, "part")
    base = part.select(F.col("p_type").alias("role_slug")).distinct()
    weak = base.filter(F.length("role_slug") % 2 == 1).select(F.concat("role_slug", F.lit(fv.WEAK_SUFFIX)).alias("role_slug"))
    named = base.unionByName(weak).select(
        "role_slug", F.concat(F.lit("Role "), "role_slug").alias("name"), F.lit("1.0").alias("version"),
        F.lit(None).cast("string").alias("domain"), F.lit("You are a role.").alias("system_prompt"))
    brands = part.select(F.col("p_brand").alias("role_slug")).distinct().withColumn("system_prompt", F.lit("You are a brand."))
    return named.unionByName(brands, allowMissingColumns=True)


define_roles = """WITH base AS (SELECT DISTINCT p_type AS role_slug FROM part),
  named AS (SELECT role_slug FROM base UNION ALL SELECT role_slug || '_v1_weak' FROM base WHERE length(role_slug) % 2 = 1)
"""


@query("list_roles", define_roles + "SELECT role_slug FROM base ORDER BY role_slug")
def list_roles(spark, d):
    return roles.list_roles(_roles(spark, d))


@query("role_info", define_roles + """SELECT role_slug, 'Role ' || role_slug AS name, '1.0' AS version, '?' AS domain,
  role_slug IN (SELECT role_slug FROM base) AS has_tests, role_slug || '_v1_weak' IN (SELECT role_slug FROM named) AS has_weak_variant FROM named
  UNION ALL SELECT DISTINCT p_brand, p_brand, '?', '?', false, false FROM part""")
def role_info(spark, d):
    return roles.role_info(_roles(spark, d), b.cases(spark, d))


PROMPT_SOURCE = """CASE doc_id % 6 WHEN 0 THEN 'local' WHEN 1 THEN 'none' WHEN 2 THEN 'custom:' || text
  WHEN 3 THEN 'file:/prompts/' || source || '.txt' WHEN 4 THEN 'weak' ELSE 'file:/missing/' || source END"""


@query("resolve_prompt", f"""SELECT doc_id, prompt_source LIKE 'file:/missing%' AS missing_file, CASE doc_id % 6 WHEN 1 THEN '' WHEN 2 THEN text
  WHEN 3 THEN 'Prompt of ' || source WHEN 5 THEN NULL ELSE 'Local ' || doc_id END AS resolved_prompt
  FROM (SELECT *, {PROMPT_SOURCE} AS prompt_source FROM documents) s""")
def resolve_prompt(spark, d):
    docs = b.table(spark, d, "documents")
    requests = docs.select("doc_id", F.expr(PROMPT_SOURCE).alias("prompt_source"),
                           F.concat(F.lit("Local "), F.col("doc_id").cast("string")).alias("local_prompt"))
    files = docs.select("source").distinct().select(
        F.concat(F.lit("/prompts/"), "source", F.lit(".txt")).alias("file_path"),
        F.concat(F.lit("\n Prompt of "), "source", F.lit(" \n")).alias("content"))
    return roles.resolve_prompt(requests, files).select("doc_id", "missing_file", "resolved_prompt")


@query("resolve_run_config", """SELECT c_custkey,
  CASE WHEN c_custkey % 2 = 0 THEN 'judge_p' ELSE 'target_p' END AS judge_provider,
  CASE WHEN c_custkey % 3 = 0 THEN 'judge_m' ELSE 'target_m' END AS judge_model,
  CASE WHEN c_custkey % 5 = 0 THEN 'target_d' ELSE 'target_m' END AS target_deployment,
  CASE WHEN c_custkey % 7 = 0 THEN 'judge_d' WHEN c_custkey % 3 = 0 THEN 'judge_m' WHEN c_custkey % 5 = 0 THEN 'target_d' ELSE 'target_m' END AS judge_deployment,
  CASE WHEN c_custkey % 2 = 0 THEN 'gpt-x' ELSE 'target_m (target_p)' END || ' / local' AS run_label, 'target_m (target_p)' AS display_name FROM customer""")
def resolve_run_config(spark, d):
    key = F.col("c_custkey")
    configs = b.table(spark, d, "customer").select(
        "c_custkey", F.lit("target_p").alias("target_provider"), F.lit("target_m").alias("target_model"),
        F.when(key % 5 == 0, "target_d").otherwise("").alias("target_deployment"),
        F.when(key % 2 == 0, "judge_p").otherwise("").alias("judge_provider"),
        F.when(key % 3 == 0, "judge_m").alias("judge_model"), F.when(key % 7 == 0, "judge_d").otherwise("").alias("judge_deployment"),
        F.when(key % 2 == 0, "gpt-x").otherwise("").alias("model"), F.lit("target_p").alias("provider"),
        F.lit("target_m").alias("default_model"), F.lit("local").alias("prompt_source"))
    return roles.resolve_run_config(configs).select(
        "c_custkey", "judge_provider", "judge_model", "target_deployment", "judge_deployment",
        roles.run_label().alias("run_label"), roles.model_display_name("target_model", "target_provider").alias("display_name"))


@query("model_display_name", "SELECT c_custkey, c_mktsegment || ' (provider_' || (c_custkey % 3) || ')' AS display_name FROM customer")
def model_display_name(spark, d):
    provider = F.concat(F.lit("provider_"), (F.col("c_custkey") % 3).cast("string")).alias("provider")
    return b.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"), provider).select(
        "c_custkey", roles.model_display_name().alias("display_name"))


def _work(spark, d):
    """Suppliers are run requests; ten neighbouring parts are the suite of a role."""
    key = F.col("s_suppkey")
    slug = F.concat(F.lit("role_"), key.cast("string"), F.when(key % 4 == 0, fv.WEAK_SUFFIX).otherwise(""))
    specs = b.table(spark, d, "supplier").select(key.alias("run_id"), slug.alias("role_slug"), (key % 3 + 1).cast("int").alias("repeat"))
    suites = b.table(spark, d, "part").select(
        F.concat(F.lit("role_"), F.expr("p_partkey div 10").cast("string")).alias("role_slug"), F.col("p_partkey").alias("test_id"))
    return roles.expand_run_specs(specs, suites)


WORK = """SELECT s.s_suppkey AS run_id, 'role_' || s.s_suppkey || CASE WHEN s.s_suppkey % 4 = 0 THEN '_v1_weak' ELSE '' END AS role_slug,
  CAST(r.n AS INTEGER) AS repeat, p.p_partkey AS test_id FROM supplier s
  JOIN (SELECT * FROM range(1, 4) r(n)) r ON r.n <= s.s_suppkey % 3 + 1 JOIN part p ON p.p_partkey // 10 = s.s_suppkey"""


@query("expand_run_specs", WORK)
def expand_run_specs(spark, d):
    return _work(spark, d)


@query("run_totals", f"SELECT run_id, count(*) AS total FROM ({WORK}) w GROUP BY run_id")
def run_totals(spark, d):
    return roles.run_totals(_work(spark, d))


# --- context -------------------------------------------------------------------------

#: A byte that is not UTF-8, and what stands for it once read.
BAD_BYTE, SQL_REPLACED = "ff", "chr(65533)"


def _doc_files(spark, d):
    """Every document as a file in the folder of its source, ending in a byte that cannot be decoded."""
    docs = b.reference_docs(spark, d)
    return docs.select(F.concat("role_slug", F.lit("/"), "file_name").alias("path"), F.concat(F.coalesce("content", F.lit("")).cast("binary"), F.unhex(F.lit(BAD_BYTE))).alias("content"))


@query("read_reference_docs", with_tables("docs") + f"""SELECT role_slug, file_name, coalesce(content, '') || {SQL_REPLACED} AS content FROM docs
  UNION ALL SELECT r.role_slug, s.role_slug || '_notes.md', 'for ' || s.role_slug FROM (SELECT DISTINCT role_slug FROM docs) r
  JOIN (SELECT DISTINCT role_slug FROM docs) s ON starts_with(s.role_slug, r.role_slug)""")
def read_reference_docs(spark, d):
    """Written as files and found again: a folder for each role, and notes for each role in the root; files with other suffixes are no documents."""
    root = shared_dir(spark, "docs")
    roles = b.reference_docs(spark, d).select("role_slug").distinct()
    notes = roles.select(F.concat("role_slug", F.lit("_notes.md")).alias("path"), F.concat(F.lit("for "), "role_slug").cast("binary").alias("content"))
    others = roles.select(F.concat("role_slug", F.lit("/table.csv")).alias("path"), F.lit(b"no").alias("content"))
    documents.write_files(_doc_files(spark, d).union(notes).union(others), root)
    return tables.read_reference_docs(spark, root, roles)


def _requests(spark, d):
    """Each language asks for its documents by path, twice, and for paths that do not exist."""
    root = shared_dir(spark, "docs")
    documents.write_files(_doc_files(spark, d), root)
    path = F.concat(F.lit(f"{root}/"), "source", F.format_string("/doc_%09d.md", "doc_id"))
    return b.table(spark, d, "documents").select(F.col("lang").alias("role_slug"), F.array(path, F.concat(path, F.lit(".gone")), path).alias("paths"))


@query("read_source_docs", f"SELECT lang AS role_slug, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS file_name, coalesce(text, '') || {SQL_REPLACED} AS content FROM documents")
def read_source_docs(spark, d):
    return tables.read_requested_docs(_requests(spark, d))[0]


@query("read_source_errors", "SELECT lang AS role_slug, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md.gone' AS file_name, 'not found' AS error FROM documents")
def read_source_errors(spark, d):
    """What was asked for and could not be read, as rows."""
    errors = tables.read_requested_docs(_requests(spark, d))[1]
    return errors.select("role_slug", F.element_at(F.split("path", "/"), -1).alias("file_name"), "error")


@query("build_context", with_tables("docs") + "SELECT role_slug, file_name, '### ' || file_name || chr(10) || content AS part_text FROM docs")
def build_context(spark, d):
    return context.context_parts(b.reference_docs(spark, d))


JUDGE_CONTEXT = "SELECT role_slug, substr(string_agg('### ' || file_name || chr(10) || content, chr(10) || chr(10) ORDER BY file_name), 1, 6000) AS context_text FROM docs GROUP BY role_slug"


@query("judge_context", with_tables("docs") + JUDGE_CONTEXT)
def judge_context(spark, d):
    return context.judge_context(b.reference_docs(spark, d))


@query("context_info", with_tables("docs", "doc_roles") + """SELECT r.role_slug, c.n IS NOT NULL AS loaded, coalesce(c.n, 0) AS doc_count,
  coalesce(c.chars, 0) AS total_chars FROM doc_roles r LEFT JOIN (SELECT role_slug, count(*) AS n,
  CAST(length(string_agg('### ' || file_name || chr(10) || content, chr(10) || chr(10))) AS BIGINT) AS chars FROM docs GROUP BY role_slug) c ON c.role_slug = r.role_slug""")
def context_info(spark, d):
    return context.context_info(b.doc_roles(spark, d), b.reference_docs(spark, d))


@query("context_files", with_tables("docs") + """SELECT role_slug, file_name, CAST(length(content) AS BIGINT) AS chars FROM docs""")
def context_files(spark, d):
    return context.context_files(b.reference_docs(spark, d))


@query("build_generation_source", with_tables("docs", "doc_roles") + f"""SELECT r.role_slug, substr(coalesce(c.t || chr(10) || chr(10) || '{fv.SYSTEM_PROMPT_HEADING}' || chr(10), '')
  || r.system_prompt, 1, 8000) AS source_text FROM doc_roles r LEFT JOIN (SELECT role_slug,
  string_agg('--- ' || file_name || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY file_name) AS t FROM docs GROUP BY role_slug) c ON c.role_slug = r.role_slug""")
def build_generation_source(spark, d):
    return context.generation_source(b.doc_roles(spark, d), b.reference_docs(spark, d))


def _sql_lines(*lines: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)


PROMPT_SQL = (f"'You are an expert evaluator for a ' || p.domain || ' AI assistant.' || chr(10) || chr(10) || {_sql_lines(*context.SCORING_RUBRIC.split(chr(10)))} || chr(10) || "
              f"coalesce(chr(10) || {_sql_lines(context.PROMPT_REFERENCE, '---')} || chr(10) || c.context_text || chr(10) || '---' || chr(10) || chr(10), '') || "
              f"'CRITERION TO EVALUATE: ' || p.criterion || chr(10) || {_sql_lines(*context.PROMPT_CLOSING)}")


@query("build_judge_prompt", with_tables("docs") + f""", contexts AS ({JUDGE_CONTEXT})
  SELECT p.id, md5({PROMPT_SQL}) AS prompt_md5, length({PROMPT_SQL}) AS prompt_chars FROM (
  SELECT doc_id * 2 + side AS id, CASE WHEN side = 0 THEN source ELSE lang END AS role_slug, lang AS domain, text AS criterion
  FROM documents, (VALUES (0), (1)) s(side)) p LEFT JOIN contexts c ON c.role_slug = p.role_slug""")
def build_judge_prompt(spark, d):
    """Every text as a criterion, once for a role with documents and once for one without."""
    docs = b.table(spark, d, "documents")
    rows = docs.select(F.explode(F.array(
        F.struct((F.col("doc_id") * 2).alias("id"), F.col("source").alias("role_slug")),
        F.struct((F.col("doc_id") * 2 + 1).alias("id"), F.col("lang").alias("role_slug")))).alias("_r"),
        F.col("lang").alias("domain"), F.col("text").alias("criterion")).select("_r.*", "domain", "criterion")
    prompts = context.build_judge_prompts(rows, context.judge_context(b.reference_docs(spark, d)))
    return prompts.select("id", F.md5("judge_prompt").alias("prompt_md5"), F.length("judge_prompt").cast("bigint").alias("prompt_chars"))


# --- model output --------------------------------------------------------------------

def _parsed(spark, d):
    return model_output.parse_json_array(b.model_texts(spark, d), "raw")


@query("parse_json_array", with_tables("parsed") + "SELECT text_id, parsed_by, CAST(json_array_length(items) AS BIGINT) AS num_items FROM parsed")
def parse_json_array(spark, d):
    size = F.when(F.col("items").isNotNull(), F.size("items")).cast("bigint")
    return _parsed(spark, d).select("text_id", "parsed_by", size.alias("num_items"))


@query("parse_json_rejects", with_tables("parsed") + "SELECT text_id, role_slug, raw FROM parsed WHERE parsed_by = 'rejected'")
def parse_json_rejects(spark, d):
    return model_output.rejects(_parsed(spark, d)).select("text_id", "role_slug", "raw")


SQL_ITEMS = """SELECT text_id, test_seq, item FROM (SELECT text_id, unnest(range(1, len(l) + 1)) AS test_seq, unnest(l) AS item FROM (
  SELECT text_id, CAST(CAST(items AS JSON) AS JSON[]) AS l FROM parsed WHERE items IS NOT NULL) p) u"""


@query("parse_item_rejects", with_tables("parsed") + f"SELECT text_id, test_seq, CAST(item AS VARCHAR) AS item FROM ({SQL_ITEMS}) i WHERE json_type(item) <> 'OBJECT'")
def parse_item_rejects(spark, d):
    return model_output.item_rejects(_parsed(spark, d)).select("text_id", "test_seq", "item")


@query("cases_from_output", with_tables("parsed") + f"""SELECT text_id, test_seq, item->>'id' AS test_id, item->>'category' AS category, item->>'question' AS question,
  CASE json_type(item->'criteria') WHEN 'ARRAY' THEN array_to_string(CAST(item->'criteria' AS VARCHAR[]), '|') WHEN 'VARCHAR' THEN item->>'criteria'
    ELSE '{fv.REVIEW_PLACEHOLDER}' END AS criteria,
  coalesce(CAST(floor(CAST(item->>'weight' AS DOUBLE)) AS INTEGER), 2) AS weight, item->>'context' AS context FROM ({SQL_ITEMS}) i WHERE json_type(item) = 'OBJECT'""")
def cases_from_output(spark, d):
    return model_output.cases_from_output(_parsed(spark, d)).select(
        "text_id", "test_seq", "test_id", "category", "question", joined("criteria"), "weight", joined("context"))


@query("gold_from_items", """SELECT 'team_' || source AS role_slug, printf('GEN-GOLD-%02d-', doc_id + 1) || t.ending AS id, t.quality,
  'Team ' || upper(source[1]) || substr(source, 2) AS domain, 'Question ' || doc_id AS question,
  CASE t.ending WHEN 'EX' THEN text WHEN 'AD' THEN lang WHEN 'PR' THEN '' ELSE source END AS response, 'Covers ' || doc_id AS criterion, t.expected
  FROM documents, (VALUES ('EX', 'excellent', CAST(0.95 AS DOUBLE)), ('AD', 'adequate', 0.35), ('PR', 'poor', 0.0), ('ML', 'misleading', 0.0)) t(ending, quality, expected)""")
def gold_from_items(spark, d):
    number = F.col("doc_id").cast("string")
    items = b.table(spark, d, "documents").select(
        F.concat(F.lit("team_"), "source").alias("role_slug"), (F.col("doc_id") + 1).alias("item_seq"),
        F.concat(F.lit("Question "), number).alias("question"), F.concat(F.lit("Covers "), number).alias("criterion"),
        F.col("text").alias("excellent_response"), F.col("lang").alias("adequate_response"),
        F.lit(None).cast("string").alias("poor_response"), F.col("source").alias("misleading_response"))
    return model_output.gold_from_items(items).select(
        "role_slug", "id", "quality", "domain", "question", "response", F.col("criteria")[0].alias("criterion"),
        F.col("expected_scores")[0].alias("expected"))


@query("all_goldens", with_tables("gold") + """SELECT quality, count(*) AS n FROM (SELECT quality FROM gold
  UNION ALL SELECT t.quality FROM documents, (VALUES ('excellent'), ('adequate'), ('poor'), ('misleading')) t(quality)) g GROUP BY quality""")
def all_goldens(spark, d):
    from ..operators.calibrate import all_goldens as union
    built_in = b.gold_rows(spark, d).select(F.col("test_id").cast("string").alias("id"), "quality", F.array("criterion").alias("criteria"),
                                            F.array("expected").alias("expected_scores"))
    items = b.table(spark, d, "documents").select(
        F.col("source").alias("role_slug"), (F.col("doc_id") + 1).alias("item_seq"), F.col("lang").alias("question"), F.col("lang").alias("criterion"),
        *[F.col("lang").alias(field) for _, field, *_ in fv.GOLD_TIERS])
    return union(built_in, model_output.gold_from_items(items)).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


# --- model calls, by stubs whose results are formulas --------------------------------

def _no_wait(_seconds):
    return None


def _questions(spark, d):
    turns = b.table(spark, d, "conversations")
    system = turns.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system_prompt"))
    asked = turns.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("test_id"), F.col("text").alias("question"))
    return asked.join(system, "conv_id", "left").withColumnRenamed("conv_id", "run_id")


@query("generate_responses", f"""SELECT run_id, test_id, CASE WHEN error IS NULL THEN 'Answer: ' || question ELSE '[ERROR: Target model failed — ' || error || ']' END AS response,
  error, CASE WHEN error IS NULL THEN CAST(n % 40 AS DOUBLE) / 4.0 ELSE 0.0 END AS latency_seconds,
  CASE WHEN error IS NULL THEN s + n ELSE 0 END AS input_tokens, CASE WHEN error IS NULL THEN n ELSE 0 END AS output_tokens,
  CASE WHEN error IS NULL THEN s + n + n ELSE 0 END AS total_tokens,
  CASE WHEN error IS NULL THEN 'gpt-4o-mini-stub' ELSE 'error' END AS model_id, CASE WHEN n % 17 = 0 THEN 3 ELSE 1 END AS attempt,
  CASE WHEN error IS NULL THEN n + 8 ELSE 0 END AS response_chars,
  CASE WHEN error IS NULL THEN len(list_filter(regexp_split_to_array('Answer: ' || question, '\\s+'), lambda w: w <> '')) ELSE 0 END AS response_words,
  CASE WHEN error IS NULL THEN ((s + n) * CAST(0.15 AS DOUBLE) + n * CAST(0.6 AS DOUBLE)) / 1000000.0 ELSE 0.0 END AS estimated_cost_usd
  FROM (SELECT *, CASE WHEN n % 17 = 0 THEN '429 rate limit reached' WHEN n % 13 = 0 THEN 'invalid request' END AS error FROM (
  SELECT u.conv_id AS run_id, u.turn AS test_id, u.text AS question, length(u.text) AS n, coalesce(length(p.text), 0) AS s
  FROM conversations u LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) p
  ON p.conv_id = u.conv_id WHERE u.role = 'user') q) e""")
def generate_responses(spark, d):
    return apply.generate_responses(_questions(spark, d), stubs.responder, sleep=_no_wait)


DOMAIN = "Languages"
CRITERIA_TEXTS = ["Answers the question", "Names a source", "Keeps to the language of the question"]


def _criterion_work(spark, d):
    return b.answers(spark, d).select(
        "*", F.posexplode(F.array(*[F.lit(c) for c in CRITERIA_TEXTS])).alias("criterion_seq", "criterion"),
    ).withColumn("judge_prompt", F.concat(F.lit("Judge: "), "criterion"))


SQL_CRITERIA = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CRITERIA_TEXTS)) + ") c(criterion_seq, criterion)"
SQL_JUDGED = f"""SELECT run_id, test_id, criterion_seq, CASE WHEN bad THEN 0.0 ELSE {sql_round('CAST((length(response) + 7 * length(criterion)) % 101 AS DOUBLE) / 100.0', 2)} END AS score,
  CASE WHEN bad THEN 'GEval error: judge gave no answer' ELSE 'Read ' || length(response) || ' characters' END AS explanation, bad AS errored
  FROM (SELECT *, length(response) % 19 = 0 AS bad FROM answers, {SQL_CRITERIA}) j"""


@query("judge_criteria", with_tables("answers") + SQL_JUDGED)
def judge_criteria(spark, d):
    return apply.judge_criteria(_criterion_work(spark, d), stubs.judge)


def _sql_dimension(name: str) -> str:
    frame = len(fv.DIMENSION_QUESTIONS[name].format(criterion="", domain=DOMAIN))
    passed = f"(length(response) + {frame} + length(criterion)) % 3 <> 0"
    return f"({passed} AND length(response) % 11 <> 0)" if name == "Accuracy" else f"({passed})"


@query("judge_dimensions", with_tables("answers") + "SELECT run_id, test_id, criterion_seq, " + ", ".join(
    f"{_sql_dimension(n)} AS {n.lower()}" for n in fv.DIMENSION_WEIGHTS) + ", " + sql_round(
    "CAST(" + " + ".join(f"CASE WHEN {_sql_dimension(n)} THEN {w} ELSE 0 END" for n, w in fv.DIMENSION_WEIGHTS.items()) + " AS DOUBLE) / 10.0", 2)
       + f" AS dag_score FROM answers, {SQL_CRITERIA}")
def judge_dimensions(spark, d):
    judged = apply.judge_dimensions(_criterion_work(spark, d).withColumn("domain", F.lit(DOMAIN)), stubs.dimension_judge)
    return judged.select("run_id", "test_id", "criterion_seq",
                         *[F.col("dag_dimensions")[n]["passed"].alias(n.lower()) for n in fv.DIMENSION_WEIGHTS], "dag_score")


SQL_RAW_SAFETY = ("CAST((length(response) * 3 + length(metric) + CASE WHEN metric = 'hallucination' THEN length(question) ELSE 0 END) % 1000 AS DOUBLE) "
                  "/ 1000.0")


@query("judge_safety", with_tables("answers") + f"""SELECT run_id, test_id, metric, CASE WHEN NOT bad THEN {sql_round(SQL_RAW_SAFETY, 2)} END AS score,
  NOT bad AND {SQL_RAW_SAFETY} <= 0.5 AS passed, CASE WHEN bad THEN 'Error: judge gave no answer' ELSE '' END AS reason
  FROM (SELECT *, (length(response) + length(metric)) % 23 = 0 AS bad FROM answers, (VALUES ('bias'), ('toxicity'), ('pii_leakage'), ('hallucination')) m(metric)
  WHERE metric <> 'hallucination' OR test_id % 4 = 0) j""")
def judge_safety(spark, d):
    work = b.answers(spark, d).withColumn("context", F.when(F.col("test_id") % 4 == 0, F.array("question")))
    return apply.judge_safety(apply.safety_work(work), stubs.safety_judge)


@query("align_verdicts", with_tables("answers") + f"""SELECT c.run_id, c.test_id, c.criterion_seq, coalesce(j.score, 0.0) AS score, coalesce(j.explanation, 'Not evaluated') AS explanation
  FROM (SELECT * FROM answers, {SQL_CRITERIA}) c LEFT JOIN ({SQL_JUDGED}) j ON j.run_id = c.run_id AND j.test_id = c.test_id AND j.criterion_seq = c.criterion_seq AND c.criterion_seq < 2""")
def align_verdicts(spark, d):
    work = _criterion_work(spark, d)
    judged = apply.judge_criteria(work.filter(F.col("criterion_seq") < 2), stubs.judge)
    return apply.align_verdicts(work.select("run_id", "test_id", "criterion_seq"), judged).drop("errored")


@query("retry_queue", with_tables("answers") + """SELECT run_id, test_id, CASE WHEN length(question) % 13 = 0 THEN 1 ELSE least(test_id % 4 + 1, 3) END AS attempt,
  CASE WHEN length(question) % 13 = 0 THEN 'invalid request' WHEN test_id % 4 = 3 THEN '429 rate limit reached' END AS error,
  CASE WHEN length(question) % 13 <> 0 AND test_id % 4 < 3 THEN 'Answer ' || (test_id % 4 + 1) || ': ' || question END AS response FROM answers""")
def retry_queue(spark, d):
    """Calls of which some are refused up to three times: each waits in the log until it is due again."""
    store, outputs = Store(spark, shared_dir(spark, "queue")), T.StructType([T.StructField("response", T.StringType())])
    work = b.answers(spark, d).select("run_id", "test_id", "question")
    done = queue.drain(store, "attempts", work, stubs.busy_responder, apply.CALL_KEY, ("test_id", "question"), outputs, per_second=100_000, first_wait=0.1)
    return done.select("run_id", "test_id", "attempt", "error", "response")


@query("pending_slices", with_tables("answers") + f"""SELECT run_id, test_id, criterion_seq, length(response) AS chars FROM answers, {SQL_CRITERIA}""")
def pending_slices(spark, d):
    """Work done in four slices after a first job did only the first criterion of each: nothing is done twice."""
    store, work = Store(spark, shared_dir(spark, "slices")), _criterion_work(spark, d)
    made = lambda pending: pending.select(*apply.CRITERION_KEY, F.length("response").cast("long").alias("chars"))
    store.append_slices("made", work.filter("criterion_seq = 0"), apply.CRITERION_KEY, made, 4)
    return store.append_slices("made", work, apply.CRITERION_KEY, made, 4)


@query("pending_work", with_tables("answers") + f"""SELECT run_id, test_id, criterion_seq, criterion FROM answers, {SQL_CRITERIA}
  WHERE NOT (length(response) % 2 = 0 AND criterion_seq = 0)""")
def pending_work(spark, d):
    work = _criterion_work(spark, d)
    done = work.filter((F.length("response") % 2 == 0) & (F.col("criterion_seq") == 0)).select(*apply.CRITERION_KEY)
    return apply.pending_work(work.select(*apply.CRITERION_KEY, "criterion"), done)


@query("retry_policy", with_tables("calls") + """SELECT run_id, test_id, attempt, transient, retry, CASE WHEN retry THEN CAST(2 * pow(2, attempt - 1) AS BIGINT) END AS delay_seconds
  FROM (SELECT *, transient AND attempt < 3 AS retry FROM (SELECT *, coalesce(regexp_matches(lower(error),
  'rate limit|429|timeout|connection|502|503|504|server error|overloaded|capacity|retry'), false) AS transient FROM calls) t) r""")
def retry_policy(spark, d):
    return apply.retry_policy(b.calls(spark, d)).select("run_id", "test_id", "attempt", "transient", "retry", "delay_seconds")


@query("retry_worklist", with_tables("calls") + """SELECT run_id, k, attempt, error, CAST(2 * pow(2, attempt - 1) AS BIGINT) AS delay_seconds FROM (
  SELECT c.run_id, c.k, c.attempt, max(c.error) AS error FROM calls c JOIN (SELECT run_id, k, max(attempt) AS attempt FROM calls GROUP BY run_id, k) m
  ON m.run_id = c.run_id AND m.k = c.k AND m.attempt = c.attempt GROUP BY c.run_id, c.k, c.attempt) l
  WHERE attempt < 3 AND regexp_matches(lower(error), 'rate limit|429|timeout|connection|502|503|504|server error|overloaded|capacity|retry')""")
def retry_worklist(spark, d):
    return apply.retry_worklist(b.calls(spark, d), keys=("run_id", "k"))


_FRAME = len(fv.SUMMARY_PROMPT.format(original="", improved=""))


@query("improve_prompts", with_tables("category_scores", "run_scores") + f"""SELECT run_id, original_score, original_grade, improved_prompt,
  'Changes in ' || ({_FRAME} + length('Prompt of run ' || run_id) + length(improved_prompt)) || ' characters' AS changes_summary FROM (
  SELECT s.run_id, s.overall_pct AS original_score, s.grade AS original_grade, 'Improved from ' || length(prompt) || ' characters' AS improved_prompt
  FROM run_scores s JOIN (SELECT run_id, string_agg(s, '' ORDER BY section) AS prompt FROM (
    SELECT run_id, section, string_agg(text, chr(10) ORDER BY part_no) AS s FROM ({IMPROVEMENT_PARTS}) l GROUP BY run_id, section) g GROUP BY run_id) p ON p.run_id = s.run_id) i""")
def improve_prompts(spark, d):
    return recommend.improve_prompts(improvement_inputs_of(spark, d), stubs.improver, stubs.summarizer).drop("error")
