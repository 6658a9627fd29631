"""Ordered helpers against brute force, on one hot group and several small ones."""

import random

from pyspark.sql import functions as F

from gradeloom.operators import spread


def _rows(seed):
    rng = random.Random(seed)
    rows = [("hot", i, rng.random() < 0.2) for i in sorted(rng.sample(range(1, 400), 120))]
    for k in range(12):
        rows += [(f"k{k}", i, rng.random() < 0.5) for i in sorted(rng.sample(range(1, 400), rng.randint(1, 9)))]
    rng.shuffle(rows)
    return rows


def _groups(rows):
    out = {}
    for key, seq, given in sorted(rows):
        out.setdefault(key, []).append((seq, given))
    return out


def test_numbered(spark):
    rows = _rows(1)
    got = spread.numbered(spark.createDataFrame(rows, "k string, seq long, g boolean"), ["k"], ["seq"], "n", width=16)
    expected = {(k, s, i) for k, items in _groups(rows).items() for i, (s, _) in enumerate(items, 1)}
    assert {(r.k, r.seq, r.n) for r in got.collect()} == expected
    assert got.count() == len(rows)


def test_previous(spark):
    rows = _rows(2)
    got = spread.with_previous(spark.createDataFrame(rows, "k string, seq long, g boolean"), ["k"], "seq", "p", width=16)
    expected = {(k, s, items[i - 1][0] if i else None) for k, items in _groups(rows).items() for i, (s, _) in enumerate(items)}
    assert {(r.k, r.seq, r.p) for r in got.collect()} == expected


def test_latest_set(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "k string, seq long, g boolean")
    got = spread.with_latest_set(df, ["k"], "seq", F.col("g"), "at", width=16)
    expected = set()
    for k, items in _groups(rows).items():
        last = None
        for s, given in items:
            last = s if given else last
            expected.add((k, s, last))
    assert {(r.k, r.seq, r.at) for r in got.collect()} == expected


def test_smallest_n(spark):
    rows = _rows(4)
    got = spread.smallest_n(spark.createDataFrame(rows, "k string, seq long, g boolean"), ["k"], ["seq"], 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    expected = {(k, s) for k, items in _groups(rows).items() for s, _ in items[:3]}
    assert {(r.k, r.seq) for r in got.collect()} == expected
