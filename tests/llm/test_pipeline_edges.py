"""Each stage of the pipeline: nulls in any column, repeated and missing ids, empty tables, columns with clashing names."""

import random

import pytest

import corpus_pipeline

R = random.Random(12)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(3, 8))) for _ in range(500)]
CLASHING = ["_row", "_id", "sig", "qr_kept", "qr_foo", "key", "place", "other", "kept", "keep_0", "n_words", "own_5", "block", "item_ids"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(200, 1)
ROWS = [
    (1, BASE), (2, BASE + " tail"), (5, prose(150, 2)), (5, prose(150, 3)), (5, prose(150, 4)), (6, prose(150, 5)), (6, prose(150, 5)), (None, prose(150, 6)), (None, prose(150, 6)),
    (None, prose(150, 7)), (None, BASE + " other"), (9, None), (10, ""), (11, "few words"), (12, prose(30, 8)), (13, prose(20_000, 9)),
]
BENCHMARK = ROWS[14][1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(d, t, None if k % 3 else "en", None if k % 4 else "web", None if t is None else len(t), *(f"{c} of {k}" for c in CLASHING)) for k, (d, t) in enumerate(ROWS)]
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, BENCHMARK), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def after(spark, tables, upto, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:upto]):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    return docs


def test_every_row_and_column_is_kept(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = after(spark, tables, 1, tmp_path / "a")
    assert good.schema == docs.schema
    # Judged by their words alone: the empty and the short texts go, all other rows stay as they were.
    want = [r for r in docs.collect() if r.text and len(r.text.split()) >= 10]
    assert sorted(map(repr, good.collect())) == sorted(map(repr, want))
    single = after(spark, tables, 2, tmp_path / "b")
    assert single.schema == docs.schema
    texts = [(r.doc_id, r.text) for r in single.collect()]
    # Of the near copies of BASE the smallest id stays; three texts share id 5; equal rows of id 6 and of none count once.
    assert sorted(texts, key=repr) == sorted({(1, BASE), *((5, prose(150, k)) for k in (2, 3, 4)), (6, prose(150, 5)), (None, prose(150, 6)), (None, prose(150, 7)), (12, prose(30, 8)), (13, prose(20_000, 9))}, key=repr)
    own = {tuple(r)[1]: tuple(r) for r in docs.collect()}
    assert all(tuple(r)[5:] in {tuple(x)[5:] for x in docs.collect() if x.text == r.text} for r in single.collect()) and own
    whole = after(spark, tables, 3, tmp_path / "c")
    assert whole.schema == docs.schema and whole.count() == single.count()
    clean = after(spark, tables, 4, tmp_path / "d")
    assert clean.schema == docs.schema
    assert sorted((repr(r) for r in clean.collect())) == sorted(repr(r) for r in whole.collect() if r.doc_id != 12)
    pieces = corpus_pipeline.packed(spark, clean, tables).collect()
    assert {r.doc_id for r in pieces} == {1, 5, 6, None, 13}


def test_stages_of_an_empty_table(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "empty"))
    docs = spark.read.parquet(str(tmp_path / "empty"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_unique_ids_are_their_own_keys(spark, tables):
    docs = spark.createDataFrame([(3, "a"), (4, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.key) for r in corpus_pipeline._keyed(spark, docs).collect()} == {(3, 3), (4, 4)}
    docs = spark.createDataFrame([(3, "a"), (3, "b"), (4, "b"), (None, "b"), (None, "b")], "doc_id long, text string")
    keys = [(r.doc_id, r.key) for r in corpus_pipeline._keyed(spark, docs).collect()]
    assert len(keys) == 5 and len(set(keys)) == 4 and dict(keys)[4] == 4 and all(k >= 1 << 62 for d, k in keys if d != 4)
