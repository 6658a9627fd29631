"""The operators' queries on the smallest tables: against their SQL, or against plain Python versions."""

import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.join(os.path.dirname(__file__), "..", "..", "tools")]
import brute  # noqa: E402
import check_oracle  # noqa: E402

from gradeloom.llm import license_scan, packing, quality_rules  # noqa: E402
from gradeloom.llm.catalog import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF_DIR)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def rows_of(spark, name):
    return QUERIES[name][0](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, con, name):
    fn, sql = QUERIES[name]
    assert check_oracle.compare(fn(spark, SF_DIR), con, sql) is None


def test_decontamination_is_native(spark):
    plan = QUERIES["op7_decontaminate"][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_packing_is_an_exact_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op1_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * total


def test_quality_base(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op4_quality_rules")}
    for doc_id, text in docs:
        r = got[doc_id]
        assert tuple(r[c] for c in quality_rules.BASE) + (r.base_failed,) == brute.quality_base(text)
        assert not (r.kept and r.base_failed)


def test_license_base_equals_sql(spark, con):
    assert check_oracle.compare(QUERIES["op6_license_scan"][0](spark, SF_DIR).drop("labels", "score"), con, license_scan.BASE_SQL) is None


def test_language_model_equals_its_formula(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op8_ngram_lm")}
    tokens = {d: brute.plain((t or "").translate(brute.LOWER)) + [None] for d, t in docs}
    words, pairs = Counter(), Counter()
    for d, t in tokens.items():
        if brute.fold(d, 7) != 2:
            words.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
    n, v = sum(words.values()), len(words)
    before, kinds = Counter(), Counter()
    for (a, _), c in pairs.items():
        before[a] += c
        kinds[a] += 1
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    discount = min(0.95, once / (once + 2 * twice))
    for d, t in tokens.items():
        r = got[d]
        plain = [(words[w] + 1) / (n + v + 1) for w in t]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.fold(d, 7) == 2, len(t), sum(words[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(map(math.log10, plain)), rel_tol=1e-9)
        model = 0.0
        for a, b, p in zip([0, *t[:-1]], t, plain, strict=True):
            model += math.log10(max(pairs[a, b] - discount, 0) / before[a] + discount * kinds[a] / before[a] * p if before[a] else p)
        assert abs(model - r.score) <= 0.02 * len(t)  # one step of a byte is 1 / 32


def test_toxicity_on_held_out_rows(spark):
    # The smallest tables have too few labels to learn from.
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"][0](spark, sf_dir).filter("held_out").collect()
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p, _ in rows)
    caught = [y for _, p, y in rows if p]
    assert sum(caught) / len(caught) > 0.95 and sum(caught) / sum(y for *_, y in rows) > 0.75


def test_pipeline_stages_against_plain_python(spark, docs, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    stages, before = dict(corpus_pipeline.STAGES), table
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}")
        assert before.schema.names == table.schema.names
        seen[name] = {r.doc_id: r.text for r in before.collect()}
    good = seen["quality rules"]
    assert not any(brute.quality_base(t)[-1] for t in good.values())
    classes = brute.near_classes(list(good.items()))
    assert seen["near duplicates"] == {d: t for d, t in good.items() if classes[d] == d}
    cut = {d: (kept, n, gone) for d, n, gone, kept in brute.substring_dedup(list(seen["near duplicates"].items()))}
    assert {d: " ".join(brute.plain(t)) for d, t in seen["substring dedup"].items()} == {d: k for d, (k, n, gone) in cut.items() if gone < n or not n}
    clean = {d for d, _, hit, _ in brute.contamination(list(seen["substring dedup"].items()), items) if not hit}
    assert set(seen["decontamination"]) == clean
    assert {r.doc_id for r in stages["packing"](spark, before, SF_DIR).collect()} == clean
