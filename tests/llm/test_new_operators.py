"""Prefix trie, collocations and token files against plain Python: nulls, ties, repeats, long texts, empty tables, clashing names."""

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from gradeloom.llm import collocations, packing, prefix_trie, token_files  # noqa: E402
from gradeloom.session import shared_dir  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


# --- prefix trie ---------------------------------------------------------------------

def random_turns(n_convs, seed):
    r, rows = random.Random(seed), []
    for c in range(-3, n_convs):
        if r.random() < 0.1:
            continue
        turns = [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "bé", "", None])) for t in range(r.choice([1, 2, 3, 9, 40]))]
        r.shuffle(turns)
        rows += turns
    long = [(500, t, "user", str(t % 3)) for t in range(300)]
    rows += long + [(501, t, a, b) for _, t, a, b in long] + [(502, t, a, b) for _, t, a, b in long[:257]]
    rows += [(600, None, "user", "tie"), (600, None, "bot", "tie"), (600, None, "bot", "tie"), (600, 1, None, "x"), (None, 1, "user", "no id")]
    return rows


@pytest.mark.parametrize("band", [2, 16])
def test_trie_equals_plain_python(spark, band, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = random_turns(60, 5)
    names = ["depth", "k1", "range", "conv", "n", "above", "size", "row"]
    frame = spark.createDataFrame([(*r, *range(8)) for r in rows], f"conv_id long, turn long, role string, text string, {', '.join(f'{c} int' for c in names)}")
    folder = shared_dir(spark, "trie")
    turns = prefix_trie._written(prefix_trie.numbered_turns(frame.repartition(5), folder), folder, "turns")
    conv = F.col("conv")
    built = prefix_trie.rebuilt(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8, folder)
    got = [tuple(r) for r in prefix_trie.trie(*built, folder, band).collect()]
    assert sorted(got, key=repr) == sorted(brute.trie(brute.rebuilt_turns(rows)), key=repr)


def test_trie_of_nothing(spark):
    folder = shared_dir(spark, "trie")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = prefix_trie._written(prefix_trie.numbered_turns(empty, folder), folder, "turns")
    rows = prefix_trie.trie(turns, turns.groupBy("conv").agg(F.count("*").alias("n")), folder).collect()
    assert [tuple(r) for r in rows] == [(None, 0, None, 0, 0, 1, 0, prefix_trie.NOTHING)]


# --- collocations --------------------------------------------------------------------

def phrase_docs():
    r = random.Random(3)
    words = ["Straße", "a", "b-c", "d\x00e", "漢字", "x" * 300, "New", "york", "É", "é"]
    weighted = [w for k, w in enumerate(words) for _ in range(12 - k)]
    rows = [(k, " ".join(r.choice(weighted) + r.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(r.choice([0, 1, 5, 80]))), r.choice(["en", "de", None, "und"])) for k in range(120)]
    return [*rows, (1, None, "en"), (None, "only once here", "xx"), (None, "", None), (7, "new york " * 2000, "en"), (7, "new york " * 2000, "en"), (8, "one.two " * 900, "fr")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_plain_python(spark, small, monkeypatch):
    rows = phrase_docs()
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, block int, id int, f int").coalesce(3)
    if small:
        monkeypatch.setattr(collocations, "TILE", 4)
        monkeypatch.setattr(collocations, "DENSE", 1)
    sizes = {"block_bytes": 600, "bucket_words": 1500} if small else {}
    for max_words in (3, 4) if small else (3,):
        found, totals = collocations.phrases(frame, shared_dir(spark, "phrases"), max_words=max_words, **sizes)
        got = [tuple(r) for r in collocations.collocations(found, totals).collect()]
        assert sorted(got) == sorted(brute.collocations([(lang, t) for _, t, lang in rows], max_words=max_words))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(*collocations.phrases(empty, shared_dir(spark, "phrases"))).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    big = [(10**12 - 1, 10**12, 10**12 + 7), (3 * 10**9, 4 * 10**9, 9 * 10**9), (10, 10, 10), (10, 10**13, 10**13)]
    frame = spark.createDataFrame(big, "a long, l long, r long")
    got = frame.select("a", "l", "r", collocations.pair_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert {(r.a, r.l, r.r): r.s for r in got} == {(a, l, r): 10**6 * a * a // (l * r) for a, l, r in big}


def test_tiles_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 8)
    r = np.random.default_rng(2)
    a, b = (r.zipf(1.4, 20_000) % 500 for _ in range(2))
    codes, counts = collocations.tile_counts(a, b)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == Counter(((a << collocations.WORD_BITS) | b).tolist())


# --- token files ---------------------------------------------------------------------

TEXTS = [
    (5, None), (4, ""), (3, "Hello, World! don't"), (3, "another text of id 3"), (3, "another text of id 3"), (None, "no id"), (-7, "first"), (9, "word " * 30_000),
    (10, "x" * 20_000), (2, " \n\t "), (11, "\x00 <|endoftext|> İstanbul ÀÉ ẞ 漢字 …"),
]


def expected(texts, tokenizer, end=2):
    return {(d, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for d, t in texts}


@pytest.mark.parametrize("file_name, sizes", [
    (packing.TOKENIZER, {}), (packing.TOKENIZER, {"range_bytes": 30_000, "file_ids": 50, "part_bytes": 3000}), ("byte_bpe_50k.json", {"range_bytes": 30_000, "file_ids": 50, "part_bytes": 3000}),
])
def test_token_files_round_trip(spark, file_name, sizes):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file_name)
    want = expected(TEXTS, Tokenizer.from_file(path))
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in TEXTS], "doc_id long, text string, start int, row int, sig int").repartition(4)
    folder = shared_dir(spark, "ids")
    index = token_files.write_ids(frame, folder, path, **sizes)
    rows = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == sorted((str(d), want[d, t].tobytes()) for d, t in TEXTS)
    at = 0
    for r in rows:
        assert (r.start, 4 * r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert index.agg(F.sum("n_docs"), F.sum("n_ids")).first()[:] == (len(TEXTS), at)


def test_token_files_of_nothing(spark):
    folder = shared_dir(spark, "ids")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write_ids(empty, folder, packing.default_tokenizer()).count() == 0
    assert token_files.read_ids(spark, folder).count() == 0


def test_blocks_keep_every_id():
    r = np.random.default_rng(4)
    for n in (1, 1023, 1024, 1025, 600_000):
        for top in (1, 2, 300, 49_408, 2**32 - 1):
            ids = np.where(r.random(n) < 0.01, 2**32 - 1, r.integers(0, top, n)).astype(np.uint32)
            body, starts = token_files.packed(ids)
            assert (token_files.unpacked(np.frombuffer(body, np.uint8), starts)[:n] == ids).all()
    ids = np.where(r.random(50_000) < 0.005, 49_000, r.integers(100, 164, 50_000)).astype(np.uint32)
    assert len(token_files.packed(ids)[0]) < 1.1 * 50_000 * 6 / 8  # rare ids do not widen the others


def test_any_span_of_a_file_is_read_alone():
    r = np.random.default_rng(6)
    sizes = [0, 1, 5000, 3, 1024, 0, 2048]
    ids = r.integers(0, 49_408, sum(sizes), dtype=np.uint32)
    held = token_files.TokenFile(token_files.file_bytes([None, *range(6)], np.concatenate([[0], np.cumsum(sizes)]), ids))
    assert held.doc_ids.to_pylist() == [None, *range(6)]
    for k in range(len(sizes)):
        assert (held.document(k) == ids[held.bounds[k] : held.bounds[k + 1]]).all()
    for a, b in r.integers(0, len(ids), (200, 2)):
        assert (held.span(int(min(a, b)), int(max(a, b))) == ids[min(a, b) : max(a, b)]).all()
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else" * 10)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_token_file_query(spark):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
    want, at = expected(docs, Tokenizer.from_file(packing.default_tokenizer())), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.query(spark, SF_DIR).collect()}
    for doc_id, text in docs:
        ids = want[doc_id, text]
        assert got[doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
