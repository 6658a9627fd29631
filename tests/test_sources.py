"""File readers and sinks."""

import json

from pyspark.sql import functions as F

from gradeloom.operators import context, history, ingest
from gradeloom.sources import tables


def test_reference_docs(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "eng").mkdir(parents=True)
    (root / "eng" / "a.md").write_text("in folder")
    (root / "eng" / "bad.txt").write_bytes(b"ok \xff end")
    (root / "eng" / "skip.pdf").write_text("no")
    (root / "eng_extra.md").write_text("root file")
    (root / "other.md").write_text("not a role")
    roles = spark.createDataFrame([("eng",), ("eng_extra",), ("none",)], "role_slug string")
    docs = tables.read_reference_docs(spark, str(root), roles)
    got = {(r.role_slug, r.file_name): r.content for r in docs.collect()}
    assert got == {("eng", "a.md"): "in folder", ("eng", "bad.txt"): "ok � end", ("eng", "eng_extra.md"): "root file",
                   ("eng_extra", "eng_extra.md"): "root file"}
    text = {r.role_slug: r.context_text for r in context.judge_context(docs).collect()}["eng"]
    assert text == "### a.md\nin folder\n\n### bad.txt\nok � end\n\n### eng_extra.md\nroot file"


def test_folder_wins_over_root(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "eng").mkdir(parents=True)
    (root / "eng" / "eng.md").write_text("folder")
    (root / "eng.md").write_text("root")
    docs = tables.read_reference_docs(spark, str(root), spark.createDataFrame([("eng",)], "role_slug string"))
    assert [r.content for r in docs.collect()] == ["folder"]


def test_source_docs_skip_missing(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    docs = tables.read_source_docs(spark, [str(tmp_path / "a.md"), str(tmp_path / "gone.md"), str(tmp_path / "a.md")], "eng")
    assert [(r.file_name, r.content) for r in docs.collect()] == [("a.md", "one\ntwo")]
    assert tables.read_source_docs(spark, [str(tmp_path / "gone.md")], "eng").count() == 0
    source = context.generation_source(spark.createDataFrame([("eng", "PROMPT"), ("new", "ALONE")], "role_slug string, system_prompt string"), docs)
    got = {r.role_slug: r.source_text for r in source.collect()}
    assert got["new"] == "ALONE" and got["eng"].startswith("--- a.md ---\none\ntwo\n\n--- SYSTEM PROMPT") and got["eng"].endswith("\nPROMPT")


def test_generated_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"id": "a", "question": "q", "context": "c"}, {"question": "r", "criteria": list("abcdefg")}], indent=2))
    (tmp_path / "object.json").write_text('{"id": "a"}')
    (tmp_path / "prose.json").write_text('see [{"id": "x"}]')
    cases, rejected = tables.read_generated_json(spark, str(tmp_path / "*.json"))
    assert {r.path.rsplit("/", 1)[1] for r in rejected.collect()} == {"object.json", "prose.json"}
    cleaned = ingest.import_clean(cases.withColumn("role_slug", F.lit("r")))
    assert {(r.test_id, r.test_seq, len(r.criteria), r.category) for r in cleaned.collect()} == {("a", 1, 1, "General"), ("GEN-02", 2, 5, "General")}


def test_suite_roundtrip_and_weak_variant(spark, tmp_path):
    cases = spark.createDataFrame([("eng", 1, "a", ["x"])], "role_slug string, test_seq long, test_id string, criteria array<string>")
    tables.save_suite_json(cases, str(tmp_path / "suite"))
    back = tables.read_test_suite(spark, str(tmp_path / "suite"), "eng_v1_weak").collect()
    assert [(r.test_id, r.criteria, r.weight) for r in back] == [("a", ["x"], None)]


def test_history_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "history")
    for kind in ("evaluation", "red_team"):
        tables.append_rows(spark.range(3).withColumn("run_type", F.lit(kind)), path, "run_type")
    runs = tables.read_history(spark, path)
    assert runs.count() == 6 and "consolidated_grade" in runs.columns
    plan = history.split_by_run_type(runs, "red_team")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_type" in plan


def test_prompt_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" hi \n")
    row = tables.prompt_files(spark, str(tmp_path / "*.txt")).collect()[0]
    assert (row.file_path, row.content) == (str(tmp_path / "p.txt"), " hi \n")


def test_newest_runs_read_the_newest_periods_only(spark, tmp_path):
    path = str(tmp_path / "by_period")
    runs = spark.range(40).selectExpr("id", "timestamp'2024-03-01' + make_dt_interval(cast(id div 4 as int), cast(id % 4 as int)) AS timestamp", "if(id % 2 = 0, 'eng', 'ops') AS role")
    late = spark.createDataFrame([(99, None, "eng")], "id long, timestamp timestamp, role string")
    for rows in (runs.union(late), runs.filter("id > 30")):  # some periods again
        tables.append_by_period(rows, path, "yyyy-MM-dd")
    newest = tables.read_newest(spark, path, 3)
    assert [r.id for r in newest.collect()] == [39, 38, 37]
    assert len(newest.inputFiles()) == 1
    assert [r.id for r in tables.read_newest(spark, path, 5, "eng").collect()] == [38, 36, 34, 32, 30]
    assert [r.id for r in tables.read_newest(spark, path, 100).collect()] == [*range(39, -1, -1), 99]
