"""Nulls, empty and long texts, ties, repeated rows, empty tables, and other columns with clashing names."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from gradeloom.llm import chat_format, decontaminate, elias_fano, exchange, license_scan, native_words, near_dup, ngram_lm, packing, quality_rules, substring_dedup, suffix_dedup, text_blocks, toxicity  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

CLASHING = "n_words bucket block body open marks sig words at word qr_kept label key part keep_0 rep class_id start length items held_out score kept".split()
RANDOM = random.Random(7)
VOCABULARY = ["".join(RANDOM.choice("abcdeéß漢") for _ in range(RANDOM.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 1)
LONG = prose(30_000, 2)
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three."), (5, "One two three."), (6, PASSAGE), (7, f"{prose(30, 3)} {PASSAGE} {prose(20, 4)}"),
    (7, f"{prose(30, 3)} {PASSAGE} {prose(20, 4)}"), (8, PASSAGE + " " + PASSAGE), (9, LONG), (10, LONG.replace("abc", "x")), (None, PASSAGE), (None, "MIT License. Gnu general public License"),
    (11, "\x00\x1c\x85 <|endoftext|> don't I'M İstanbul Straße ÀÉ ẞ — …" + prose(20, 5)), (12, "a" * 5000), (13, prose(12, 6).upper()),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(2)
    return frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = {}
    for r in packing.pack(docs, packing.default_tokenizer(), capacity=256, block_sequences=4).collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for doc_id, text in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        parts = sorted(pieces[doc_id, len(ids) // 4])
        assert ids in b"".join(dict(parts).values()) and all(part == ids[4 * s : 4 * s + len(part)] for s, part in parts)
    assert packing.pack(nothing, packing.default_tokenizer()).count() == 0


def test_packing_takes_little_memory_beside_the_texts(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Task:
        get = partitionId = staticmethod(lambda: Task if Task.first() else 0)
        first = staticmethod(iter([True, False]).__next__)

    monkeypatch.setattr(packing, "TaskContext", Task)
    r = random.Random(3)
    known = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(known, k=900)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in packing._pack(iter([batch]), packing.default_tokenizer(), 4096, 2, 64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 1200 and batch.nbytes > 6_000_000 and peak < 110_000_000, peak


def test_a_worker_takes_a_bounded_multiple_of_a_chunk(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Task:
        get = partitionId = staticmethod(lambda: Task if Task.first() else 0)
        first = staticmethod(iter([True, False]).__next__)

    monkeypatch.setattr(packing, "TaskContext", Task)
    r = random.Random(4)
    known = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array([" ".join(r.choices(known, k=900)) for _ in range(1200)])], names=["doc_id", "text"])
    body = exchange.encode(np.sort(np.array([r.getrandbits(64) for _ in range(3000)], np.uint64)))
    pairs = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(range(6000)), *[pa.array([body] * 6000)] * 2], names=["u", "v", "body_a", "body_b"])
    packing._tokenizer(packing.default_tokenizer())
    peaks = {}
    for name, work, limit in (
        ("packing", lambda: packing._pack(iter([batch]), packing.default_tokenizer(), 4096, 2, 64), 60e6), ("signatures", lambda: near_dup._signatures(iter([batch])), 60e6),
        ("sets", lambda: near_dup._sets(iter([batch])), 60e6), ("similarity", lambda: near_dup._similarity(iter([pairs])), 60e6),
    ):
        text_blocks.worker_state().pop("powers", None)  # the tables that a worker keeps count as well
        tracemalloc.start()
        n = sum(b.num_rows for b in work())
        peaks[name] = (tracemalloc.get_traced_memory()[1] / 1e6, limit / 1e6)
        tracemalloc.stop()
        assert n >= 1200
    assert batch.nbytes > 6_000_000 and all(peak < limit for peak, limit in peaks.values()), peaks


def test_rows_of_two_sizes_of_steps_are_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    sets = [np.unique(np.array([r.randrange(400) for _ in range(300)], np.uint64)) for _ in range(40)]
    left = [sets[k // 7] for k in range(40)]
    columns = [pa.array(range(40)), pa.array(range(40)), pa.array([exchange.encode(x) for x in left]), pa.array([exchange.encode(x) for x in sets])]
    batch = pa.RecordBatch.from_arrays(columns, names=["u", "v", "body_a", "body_b"])
    want = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(left, sets, strict=True)]
    for step in (3, 7, 512):
        monkeypatch.setattr(near_dup, "STEP_ROWS", step)
        rows = pa.Table.from_batches(near_dup._similarity(iter([batch])))
        assert rows["similarity"].to_pylist() == want and rows["v"].to_pylist() == list(range(40))


def test_packing_balances_cost():
    lengths = np.array([900, 800, 700, 600, 500, 400, 100, 96])
    pieces, cost = packing.assign(lengths, 1024)
    assert sum(p[2] for p in pieces) == lengths.sum() and len(cost) == 4 and cost.max() < 1.6 * cost.min()


def test_suffix_dedup(spark, docs, nothing):
    got = suffix_dedup.dedup(docs, length=40, period=16).withColumn("sha", F.sha2("kept", 256))
    assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.suffix_dedup(ROWS, 40), key=repr)
    assert suffix_dedup.dedup(nothing).count() == 0
    for period in (1, 2, 7, 64):
        cover = suffix_dedup.difference_cover(period)
        assert len({(a - b) % period for a in cover for b in cover}) == period


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(1, 14)] + [(4, None, 0), (None, 1, 1)], "doc_id long, toxic int, part int")
    model, lexicon = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, model, lexicon).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scores(nothing, *toxicity.learn(nothing, labels.limit(0))).count() == 0


def test_toxicity_calibration_rises():
    margin = np.array([0.0, 1, 2, 3, 4, 5])
    knots, values = toxicity.isotonic(margin, np.array([0, 0, 1, 0, 1, 1.0]))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 14)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rules.judged(docs, labels)
    names = [quality_rules.PREFIX + c for c in [*quality_rules.BASE, "base_failed"]]
    assert listed(got, "doc_id", *names) == sorted(((d, *brute.quality_base(t)) for d, t in ROWS), key=repr)
    assert quality_rules.judged(nothing, labels).count() == 0 and quality_rules.judged(docs, labels.limit(0)).count() == len(ROWS)


def test_labelled_ids_count_once(spark):
    """Copies of labelled rows, and labels given twice, change neither what is learned nor how much reaches the driver."""
    r = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary, 30)) + (" you idiot " + " ".join(f"#{k}!" for k in r.integers(0, 99, 20)) if i % 3 == 0 else "")) for i in range(240)]
    labels = [(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(240)]
    once = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    twice = spark.createDataFrame(rows + rows[:5] * 40, "doc_id long, text string"), spark.createDataFrame(labels + labels[:50], "doc_id long, toxic int, quality int")
    model, lexicon = toxicity.learn(*once)
    again, lexicon_again = toxicity.learn(*twice)
    assert (lexicon.keys == lexicon_again.keys).all() and (model.leaf == again.leaf).all() and (model.threshold == again.threshold).all()

    def rules(docs, labels):
        return quality_rules.learn_rules(quality_rules.text_statistics(docs, "text"), labels)

    assert rules(*once) == rules(*twice) != []


def test_decision_list_finds_a_conjunction():
    r = np.random.default_rng(0)
    x = {"a": r.random(600), "b": r.random(600), "c": r.random(600)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality_rules.decision_list(x, bad)
    caught = np.zeros(600, bool)
    for rule in rules:
        caught |= quality_rules._cover(rule, x, 600)
    assert rules and (caught == bad).mean() > 0.97


def test_near_dup(spark, docs, nothing):
    got = near_dup.classes(docs)
    want = brute.near_classes([(d, t) for d, t in dict(ROWS).items() if d is not None])
    assert {r.doc_id: r.class_id for r in got.collect()} == want and got.count() == len(want)
    assert near_dup.classes(nothing).count() == 0


def test_near_dup_chain_of_neighbours(spark):
    """Texts that are near their neighbours only: a bucket's centre is far from most of them."""
    words = prose(400, 9).split()
    rows = []
    for k in range(40):
        text = list(words)
        for j in range(k + 1):
            text[10 * j] = f"new{j}"
        rows.append((k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()} == brute.near_classes(rows)


def test_near_dup_with_repeated_own_lines(spark):
    """Pairs just above the threshold; each text has a line of its own many times over."""
    rows = []
    for k in range(0, 100, 2):
        shared = " ".join(f"s{k}x{j}" for j in range(118))
        rows += [(k + i, shared + "".join(f" o{k + i}x{j}" for j in range(10)) * 80) for i in range(2)]
    want = brute.near_classes(rows)
    assert all(want[d] == d - d % 2 for d, _ in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.classes(frame).collect()} == want


def test_prob_min_hash_estimates_similarity():
    keys = np.random.default_rng(1).integers(1, 2**63, 600, dtype=np.uint64)
    a, b = np.arange(0, 450), np.arange(150, 600)
    docs, k = np.repeat([0, 1], 450), np.concatenate([keys[a], keys[b]])
    kept = near_dup.prob_min_hash(k, np.ones(900), docs, 2, 4096)
    assert abs((kept[0] == kept[1]).mean() - 0.5) < 0.04


def test_license_scan(spark, docs, nothing):
    got = license_scan.scan(docs)
    rows = [(r.doc_id, r.n_words, len(r.base_spans), sorted(s.start for s in r.base_spans)) for r in got.collect()]
    want = []
    for d, t in ROWS:
        n, places, first, last, _ = brute.phrase_places(t, license_scan.BASE_PHRASES)
        want.append((d, n, places, sorted({first, last} - {None})))
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert license_scan.scan(nothing).count() == 0
    notice = license_scan.NOTICES[0][1].replace("modify, ", "").replace("furnished", "given")
    found = license_scan.scan(spark.createDataFrame([(1, f"x y {notice} z")], "doc_id long, text string")).first().notice_spans
    assert [s.label for s in found] == ["mit"] and found[0].coverage > 0.8


def test_license_scan_of_edited_notices(spark):
    """Every notice with a word dropped and words put in; the BSD one with clause numbers and another verb."""
    rows, labels = [], {}
    for k, (label, text) in enumerate(license_scan.NOTICES):
        words = text.split()
        third = len(words) // 3
        rows.append((k, " ".join(["Some", "code.", *words[:third], "1.", *words[third : 2 * third], *words[2 * third + 1 :], "The", "end."])))
        labels[k] = [label]
    bsd = dict(license_scan.NOTICES)["bsd"].replace("are met: ", "are met: 1. ").replace("disclaimer. Redist", "disclaimer. 2. Redist").replace("are permitted", "is permitted")
    once = "the above copyright notice this list of conditions and " * 12
    rows += [(100, bsd), (101, once)]
    labels |= {100: ["bsd"], 101: []}
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [s.label for s in r.notice_spans] for r in found} == labels


@pytest.mark.parametrize("limit", [license_scan.MAX_BROADCAST, 0])
def test_license_scan_with_clauses_put_in(spark, monkeypatch, limit):
    """1, 8 and 30 words put in at one or two places of every notice; the pieces of a notice in another order are none."""
    monkeypatch.setattr(license_scan, "MAX_BROADCAST", limit)
    rows, labels = [], {}
    for label, text in license_scan.NOTICES:
        words = text.split()
        for n in (1, 8, 30):
            for places in ([2], [3], [4], [2, 4]):
                own = list(words)
                for p in sorted(places, reverse=True):
                    at = p * len(words) // 6
                    own[at:at] = [f"own{n}x{k}" for k in range(n)]
                labels[len(rows)] = [label]
                rows.append((len(rows), " ".join(own)))
        labels[len(rows)] = []
        sixth = len(words) // 6
        rows.append((len(rows), " ".join(w for k in (5, 4, 3, 2, 1, 0) for w in [f"x{k}" for _ in range(9)] + words[k * sixth : (k + 1) * sixth])))
    rows += [(1000, rows[0][1])] * 3
    labels[1000] = labels[0]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: [s.label for s in r.notice_spans] for r in found} == labels


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 9), (3, 4)], "a long, n long")
    assert sorted(r.a for r in native_words.repeated(rows, "n", step=4).collect()) == [1] + [2] * 9 + [3] * 4


def test_decontaminate(spark, docs, nothing):
    items = [(1, PASSAGE), (2, "two three"), (3, None), (4, ""), (5, "one two three"), (6, "one two three"), (7, "never seen words"), (8, LONG[:400])]
    frame = spark.createDataFrame([*items, (None, "One")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, frame).collect()]
    assert sorted(got, key=repr) == sorted(brute.contamination(ROWS, items), key=repr)
    assert decontaminate.contamination(nothing, frame).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, frame.limit(0)).collect())


def test_decontaminate_without_broadcast(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, "two three")], "item_id long, text string")
    want = listed(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "item_ids")
    monkeypatch.setattr(decontaminate, "bounded", lambda df, chars, limit=0: df)
    assert listed(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "item_ids") == want


def test_suffix_dedup_asks_for_names_at_the_price_of_a_sort():
    """Masks equal plain loops; answers to a block's names cost a few sorts, not a hash table and a search for each."""
    import time

    from gradeloom.llm import text_blocks

    r = np.random.default_rng(5)
    for n_docs, top, period in ((0, 1, 4), (1, 9, 4), (30, 40, 16), (200, 7, 1)):
        offsets = np.concatenate([[0], np.cumsum(r.integers(0, top, n_docs))]).astype(np.int64)
        found = np.flatnonzero(r.random(offsets[-1]) < 0.1)
        want = np.zeros(offsets[-1], bool)
        for f in found:
            want[max(f - period + 1, offsets[offsets <= f].max()) : f + 1] = True
        assert (suffix_dedup._reached(found, offsets, period) == want).all()
        covered = np.zeros(offsets[-1], bool)
        for f in found:
            covered[f : f + period] = True
        assert (text_blocks.covered(r.permutation(np.repeat(found, 2)), period, int(offsets[-1])) == covered).all()
    keys = r.choice(r.integers(0, 2**63, 900_000, dtype=np.uint64), 1_000_000)
    names = np.unique(keys)
    yes = r.random(len(names)) < 0.5
    bounds = exchange.cut(names, 7)
    answers = {k: [exchange.packed_bits(yes[bounds[k] : bounds[k + 1]])] for k in range(7)}
    assert (suffix_dedup._in_answers(keys, answers, 7) == yes[np.searchsorted(names, keys)]).all()
    spent = []
    for run in (lambda: np.argsort(keys), lambda: suffix_dedup._in_answers(keys, answers, 7)):
        times = []
        for _ in range(3):
            t = time.process_time()
            run()
            times.append(time.process_time() - t)
        spent.append(min(times))
    assert spent[1] < 4 * spent[0]


def test_names_are_sent_without_their_zero_bits():
    r = np.random.default_rng(6)
    short = np.sort(r.integers(0, 2**39, 9000, dtype=np.uint64))
    for keys in (short << np.uint64(25), short, np.zeros(3, np.uint64), np.array([0, 1 << 63], np.uint64), np.zeros(0, np.uint64)):
        back = exchange.decode(exchange.encode(keys, np.arange(len(keys))))
        assert (back[0] == keys).all() and (back[1] == np.arange(len(keys))).all()
    assert len(exchange.encode(short << np.uint64(25))) == len(exchange.encode(short))


def test_planes_of_sent_names_have_codes_of_their_own():
    """Differences of 35.8 random bits take 36 bits each; with one code for all planes they took 38.7."""
    r = np.random.default_rng(7)
    keys = np.sort(r.integers(0, 2**63, 13_000, dtype=np.uint64) * np.uint64(2) >> np.uint64(16))
    assert len(exchange.encode(keys)) < 4.6 * len(keys)
    for n in (1, exchange.APART - 1, exchange.APART, 13_000):
        for arrays in ((keys[:n],), (keys[:n], r.integers(-5, 2**40, n)), (np.zeros(n, np.uint64), keys[:n][::-1], np.arange(n))):
            back = exchange.decode(exchange.encode(*arrays))
            assert len(back) == len(arrays) and all((b == a.astype(np.uint64)).all() for a, b in zip(arrays, back, strict=True))


def test_proximity(spark):
    texts = [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "gamma beta alpha"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(9, "Beta, alpha gamma!")], "item_id long, text string")
    assert listed(decontaminate.proximity_matches(docs, items, within=8), "doc_id", "item_id") == [(1, 9), (3, 9)]


def test_language_model(spark, docs, nothing):
    got = ngram_lm.scores(docs, F.col("doc_id") == 6).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.n_tokens for r in got) == sorted(len(brute.plain(t)) + 1 for _, t in ROWS)
    assert all(r.score <= 0 and np.isfinite(r.score) for r in got)
    assert ngram_lm.scores(nothing, F.lit(False)).count() == 0
    assert all(r.n_known == 0 for r in ngram_lm.scores(docs, F.lit(True)).collect())


def test_language_model_keeps_whole_hashes_and_small_counts():
    """Pairs that differ in the last bits only are different; a byte is near every count of a bucket with a very large one."""
    import pyarrow as pa

    one = np.uint64(1)
    context, word = np.array([5 << 40], np.uint64), np.array([9 << 40], np.uint64)
    bodies = [exchange.encode(context, word, np.array([3])), exchange.encode(context + one, word, np.array([0])), exchange.encode(context, word + one, np.array([0]))]
    table = pa.table({"bucket": pa.array([1] * 3, pa.int32()), "block": [7, 8, 9], "body": pa.array(bodies, pa.binary())})
    rows = ngram_lm._bucket(1)(table).to_pylist()
    assert {r["block"]: exchange.decode(r["body"])[1].tolist() for r in rows if r["kind"] == ngram_lm.ANSWER} == {7: [3, 3], 8: [0, 3], 9: [0, 3]}
    for top in (1, 255, 256, 10**9):
        counts = np.unique(np.geomspace(1, top, 5000).astype(np.int64))
        near = np.abs(np.log10(ngram_lm._counts(ngram_lm._codes(counts, top), top) / counts))
        assert near.max() < 0.02 and (near[counts <= ngram_lm.EXACT] == 0).all()


def test_language_model_of_higher_order(spark):
    """Scores by the formula written out, with contexts of up to three tokens."""
    import math
    from collections import Counter

    texts = ["a b c a b d", "a b c a b d", "a b c", "b c a", "", None, "A", "x a b c", "a b z", "q q q q"]
    rows = [(k % 7, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    held = {3, 6}
    for order in (2, 3, 4):
        grams = [Counter() for _ in range(order + 1)]
        tokens = [brute.plain((t or "").translate(brute.LOWER)) + [None] for _, t in rows]
        for (d, _), t in zip(rows, tokens, strict=True):
            if d not in held:
                for i, w in enumerate(t):
                    grams[1][w,] += 1
                    for k in range(2, min(order, i + 2) + 1):
                        grams[k][tuple([0, *t][i + 2 - k : i + 2])] += 1
        n, v = sum(grams[1].values()), len(grams[1])
        want = []
        for d, t in zip(rows, tokens, strict=True):
            score = 0.0
            for i, w in enumerate(t):
                p = (grams[1][w,] + 1) / (n + v + 1)
                for k in range(2, min(order, i + 2) + 1):
                    gram = tuple([0, *t][i + 2 - k : i + 2])
                    after = {g: c for g, c in grams[k].items() if g[:-1] == gram[:-1]}
                    once, twice = (sum(c == x for c in grams[k].values()) for x in (1, 2))
                    discount = min(0.95, once / (once + 2 * twice))
                    if after:
                        p = (max(grams[k][gram] - discount, 0) + discount * len(after) * p) / sum(after.values())
                score += math.log10(p)
            want.append((d[0], len(t), round(score, 9)))
        got = [(r.doc_id, r.n_tokens, round(r.score, 9)) for r in ngram_lm.scores(docs, F.col("doc_id").isin(*held), order=order).collect()]
        assert sorted(got) == sorted(want)


def test_language_model_spreads_a_frequent_context():
    words = np.sort(np.random.default_rng(8).integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2))
    place = np.arange(20_000)
    contexts, successors, cuts, at = ngram_lm._pairs(words, place, np.full(20_000, 77), 16)
    assert (contexts == words[77]).all() and (successors[at] == words[place]).all()
    assert np.diff(cuts).max() < 1.2 * 20_000 / 16


def test_language_model_query_goes_beyond_pairs(spark, tmp_path):
    """The query's model has n-grams of three tokens: its scores of both orders by the formula written out."""
    import math
    from collections import Counter

    texts = ["a b c a b d", "a b c a b d", "a b c", "b c a", "", None, "A", "x a b c", "a b z", "q q q q", "c a b c"] * 3
    rows = [(k * 17, f"{t} w{k % 4}" if t and k % 2 else t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in ngram_lm.query(spark, str(tmp_path)).collect()}
    tokens = {d: [0, *brute.plain((t or "").translate(brute.LOWER)), None] for d, t in rows}
    assert {d for d, r in got.items() if r.held_out} == {d for d in tokens if brute.fold(d, 7) == 2} and any(r.held_out for r in got.values())
    grams = {k: Counter(tuple(t[i - k + 1 : i + 1]) for d, t in tokens.items() if not got[d].held_out for i in range(max(1, k - 1), len(t))) for k in (1, 2, 3)}
    n, v = sum(grams[1].values()), len(grams[1])
    for d, t in tokens.items():
        want = {2: 0.0, 3: 0.0}
        for i in range(1, len(t)):
            p = (grams[1][t[i],] + 1) / (n + v + 1)
            for k in (2, 3):
                if k <= i + 1:
                    gram = tuple(t[i - k + 1 : i + 1])
                    after = [c for g, c in grams[k].items() if g[:-1] == gram[:-1]]
                    once, twice = (sum(c == x for c in grams[k].values()) for x in (1, 2))
                    discount = min(0.95, once / (once + 2 * twice)) if once else 0.5
                    if after:
                        p = (max(grams[k][gram] - discount, 0) + discount * len(after) * p) / sum(after)
                want[k] += math.log10(p)
        assert math.isclose(got[d].score, want[2], abs_tol=1e-9) and math.isclose(got[d].score_3, want[3], abs_tol=1e-9)


def test_ordered_and_distinct_numbers():
    r = np.random.default_rng(9)
    for top in (1, 50, 1 << 40, 1 << 62):
        values = r.integers(0, top, 3000).astype(np.uint64)
        want, at = np.unique(values, return_inverse=True)
        ranked, stood = ngram_lm._ordered(values)
        assert (ranked == np.sort(values)).all() and (stood == np.argsort(values, kind="stable")).all()
        for distinct in (ngram_lm._distinct, ngram_lm._distinct_numbers):
            found, place = distinct(values)
            assert (found == want).all() and (place == at).all()
    none = np.zeros(0, np.uint64)
    assert all(len(x) == 0 for f in (ngram_lm._ordered, ngram_lm._distinct, ngram_lm._distinct_numbers) for x in f(none))


def test_elias_fano_and_trie():
    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (10, 3), (1000, 1 << 40), (5000, 3000)):
        values = np.sort(r.integers(0, top, n).astype(np.uint64))
        packed, wanted = elias_fano.EliasFano(values), r.integers(0, top + 5, 500).astype(np.uint64)
        assert (packed[np.arange(n)] == values).all() and (packed.successor(wanted) == np.searchsorted(values, wanted)).all()
    keys = np.unique(r.integers(0, 50, 800, dtype=np.uint64) << np.uint64(32) | r.integers(0, 90, 800, dtype=np.uint64))
    trie = elias_fano.NgramTrie(keys, np.arange(len(keys)), np.arange(50)).mapped()
    queries = np.unique(np.concatenate([keys, r.integers(0, 60, 300, dtype=np.uint64) << np.uint64(32) | r.integers(0, 99, 300, dtype=np.uint64)]))
    at = np.searchsorted(keys, queries)
    want = np.where(np.append(keys, 0)[at] == queries, at, -1)
    assert (trie.find(queries)[1] == want).all()


def test_substring_dedup(spark, docs, nothing):
    got = [(r.doc_id, r.n_words, r.n_removed, substring_dedup.joined_words(r.kept), r.keep_0) for r in substring_dedup.dedup(docs, keep=["marks"]).collect()]
    assert sorted(got, key=repr) == sorted(((*r, CLASHING.index("marks")) for r in brute.substring_dedup(ROWS)), key=repr)
    assert substring_dedup.dedup(nothing).count() == 0


def test_small_blocks_give_the_same(spark, docs, monkeypatch):
    want = listed(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed", "kept")
    monkeypatch.setattr(exchange, "bucket_count", lambda *a: 37)
    assert listed(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed", "kept") == want


def test_blocks_of_other_texts_have_other_numbers():
    import pyarrow as pa

    texts = ["same size", "size same", "same size"]
    batches = [pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([t])], names=["doc_id", "text"]) for t in texts]
    a, b, c = (number for *_, number in exchange.blocks_of(iter(batches), 100))
    assert a != b and a == c


def test_encoding_is_lossless():
    r = np.random.default_rng(5)
    keys, other = np.sort(r.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)), r.integers(-5, 5, 1000)
    back = exchange.decode(exchange.encode(keys, other))
    assert (back[0] == keys).all() and (back[1].view(np.int64) == other).all()
    mask = r.random(1000) > 0.5
    assert (exchange.answered(keys, {0: [exchange.packed_bits(mask)]}, 1) == mask).all()


def test_chat_format(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, ""), (1, 3, None, ""), (2, None, "ann", "alone"), (3, 0, "system", "only"), (None, 1, "a\nb", "x")]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "conv_id long, turn long, role string, text string, view int, start int")
    for width in (1, 256):
        got = chat_format.rotated(frame, range_turns=width).collect()
        views = {}
        for r in sorted(got, key=lambda r: (str(r.conv_id), r.view, r.position)):
            views.setdefault((r.conv_id, r.view), []).append(r)
        assert {k: len(v) for k, v in views.items()} == {(1, "ann"): 5, (1, "bob"): 5, (1, "unknown"): 5, (2, "ann"): 1, (None, "a b"): 1}
        for (_, view), turns in views.items():
            text = "".join(r.rendered for r in turns)
            for r in turns:
                assert text[r.start : r.start + r.n_chars] == r.rendered and "<|im_end|>" not in r.rendered[:-11]
                assert (r.mask_start is not None) == (r.message_role == "assistant")
                if r.mask_start is not None:
                    assert text[r.mask_start : r.mask_end].endswith("<|im_end|>")
            assert view not in {r.message_name for r in turns}
    assert chat_format.rotated(frame.limit(0)).count() == 0
