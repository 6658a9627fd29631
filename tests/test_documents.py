"""The documents data source: three ways of naming files, errors as rows, tasks that read a manifest by ranges."""

import json

import pytest

from pyspark.sql import functions as F

from gradeloom.sources import documents, tables


@pytest.fixture
def root(tmp_path):
    (tmp_path / "docs" / "eng").mkdir(parents=True)
    (tmp_path / "docs" / "eng" / "deeper").mkdir()
    (tmp_path / "docs" / "eng" / "a.md").write_text("in folder")
    (tmp_path / "docs" / "eng" / "bad.txt").write_bytes(b"ok \xff\xc3 end")
    (tmp_path / "docs" / "eng" / "skip.pdf").write_text("no")
    (tmp_path / "docs" / "eng" / "deeper" / "b.md").write_text("not read")
    (tmp_path / "docs" / "empty.md").write_text("")
    return tmp_path / "docs"


def rows_of(df):
    return {r.path.rsplit("/", 1)[1]: (r.folder, r.content, r.size, r.error) for r in df.collect()}


def test_files_below_a_root(spark, root):
    got = rows_of(documents.read_files(spark, root=f"{root}/", suffixes=".md,.txt"))
    assert got == {"a.md": ("eng", "in folder", 9, None), "bad.txt": ("eng", "ok �� end", 9, None), "empty.md": (None, "", 0, None)}
    assert documents.read_files(spark, root=f"{root}/nowhere").count() == 0


def test_errors_are_rows(spark, root):
    paths = [f"{root}/eng/a.md", f"{root}/eng", f"{root}/gone.md", f"file://{root}/empty.md", "odd://host/x.md"]
    got = rows_of(documents.read_files(spark, paths=json.dumps(paths)))
    assert {k: (v[1], v[3] and v[3].split(":")[0]) for k, v in got.items()} == {
        "a.md": ("in folder", None), "eng": (None, "not a file"), "gone.md": (None, "not found"), "empty.md": ("", None), "x.md": (None, "ArrowInvalid")}
    assert documents.read_files(spark, paths="[]").count() == 0
    names = documents.read_files(spark, paths=json.dumps(paths[:1]), content="false").first()
    assert (names.content, names.size) == (None, 9)
    with pytest.raises(Exception, match="name the files"):
        documents.read_files(spark, paths="[]", root="x").count()


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_ranges_of_a_manifest_hold_every_line_once(tmp_path, step):
    lines = ["a", "", "b" * 50, "é漢字.md", "c" * 200, "d"]
    for end in ("", "\n"):
        (tmp_path / "m.txt").write_bytes(("\n".join(lines) + end).encode())
        reader = documents.DocumentReader({"manifest": str(tmp_path / "m.txt"), "manifestBytes": str(step)})
        got = [path for part in reader.partitions() for path, _ in reader._named(part)]
        assert got == [x for x in lines if x]


def test_many_paths_in_one_plan(spark, tmp_path):
    """100,000 paths, two of which exist, from a manifest that only tasks read."""
    (tmp_path / "f").mkdir()
    for k in (0, 99_999):
        (tmp_path / "f" / f"{k}.md").write_text(f"text {k}")
    asked = spark.range(100_000).select(F.concat(F.lit(f"{tmp_path}/f/"), "id", F.lit(".md")).alias("path"))
    documents.write_manifest(asked, str(tmp_path / "manifest"))
    reader = documents.DocumentReader({"manifest": str(tmp_path / "manifest")})
    assert 4 < len(reader.partitions()) < 200
    files = documents.read_files(spark, manifest=str(tmp_path / "manifest"))
    got = {(r.error, r.n, r.content) for r in files.groupBy("error").agg(F.count("*").alias("n"), F.max("content").alias("content")).collect()}
    assert got == {("not found", 99_998, None), (None, 2, "text 99999")}


def test_written_files_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("r/a.md", "one"), ("b.md", None), ("r/a b.md", "é" * 10)], "path string, content string")
    for _ in range(2):  # a repeated write leaves the same files
        documents.write_files(rows.repartition(3), str(tmp_path / "out"))
    got = {k: v[:2] for k, v in rows_of(documents.read_files(spark, root=str(tmp_path / "out"))).items()}
    assert got == {"a.md": ("r", "one"), "b.md": (None, ""), "a b.md": ("r", "é" * 10)}
    with pytest.raises(Exception, match="not a path below the root"):
        documents.write_files(rows.select(F.lit("../x").alias("path"), "content"), str(tmp_path / "out"))


def test_requests_of_many_roles(spark, root):
    asked = [("eng", [f"{root}/eng/a.md", f"{root}/gone.md", f"{root}/eng/a.md"]), ("ops", [f"{root}/eng/a.md", "with\nbreak"]), ("none", None)]
    found, errors = tables.read_requested_docs(spark.createDataFrame(asked, "role_slug string, paths array<string>"))
    assert sorted((r.role_slug, r.file_name, r.content) for r in found.collect()) == [("eng", "a.md", "in folder"), ("ops", "a.md", "in folder")]
    assert [(r.role_slug, r.error) for r in errors.collect()] == [("eng", "not found")]
