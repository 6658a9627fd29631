"""The retry queue: rate limit over all tasks, waits outside of tasks, resumption; and work in slices."""

import random
import time

import pytest

from pyspark.sql import functions as F, types as T

from gradeloom.operators import queue
from gradeloom.plans.store import Store

OUT = T.StructType([T.StructField("answer", T.StringType())])


def most_in_a_second(times):
    times = sorted(times)
    first, most = 0, 0
    for k, t in enumerate(times):
        while t - times[first] >= 1.0:
            first += 1
        most = max(most, k - first + 1)
    return most


@pytest.mark.parametrize("limit, tasks", [(1, 8), (1.5, 3), (2, 8), (7, 8), (40, 8), (1000, 4), (0.25, 2)])
def test_no_second_sees_more_than_the_limit(limit, tasks):
    """Any number of tasks at once, each as fast as its pace lets it, from any moment on."""
    tasks, apart = queue.spacing(limit, tasks)
    r = random.Random(1)
    for _ in range(20):
        starts = []
        for _ in range(tasks):
            now = [r.random()]
            pace = queue.Pace(apart, 0.0, clock=lambda now=now: now[0], sleep=lambda s, now=now: now.__setitem__(0, now[0] + s))
            for _ in range(60):
                pace.wait()
                starts.append(now[0])
                now[0] += r.choice([0, 0, 0.3 * apart, 2 * apart])
        assert most_in_a_second(starts) <= max(1, limit)


def test_calls_of_all_tasks_keep_the_limit(spark, tmp_path):
    def call(k, attempt):
        return (str(k),)

    work = spark.range(60).withColumnRenamed("id", "k")
    done = queue.drain(Store(spark, str(tmp_path)), "log", work, call, ["k"], ["k"], OUT, per_second=20, tasks=4)
    times = [r.finished_us / 1e6 for r in done.collect()]
    assert len(times) == 60 and most_in_a_second(times) <= 20 + 4  # ends of calls, not starts, are known here
    assert max(times) - min(times) > 2


def test_waits_are_outside_of_tasks_and_a_log_is_gone_on_with(spark, tmp_path):
    def call(k, attempt):
        if k == 9:
            raise ValueError("no such model")
        if attempt <= k:
            raise RuntimeError("429 too many")
        return (f"{k}@{attempt}",)

    store, clock, waits = Store(spark, str(tmp_path)), [time.time() + 1], []

    def sleep(seconds):
        waits.append(round(seconds))
        clock[0] += seconds

    work = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,), (None,)], "k long").filter("k IS NOT NULL")
    done = queue.drain(store, "log", work, call, ["k"], ["k"], OUT, per_second=1000, clock=lambda: clock[0], sleep=sleep, first_wait=1000)
    got = {r.k: (r.attempt, r.answer, r.error) for r in done.collect()}
    assert got == {0: (1, "0@1", None), 1: (2, "1@2", None), 2: (3, "2@3", None), 3: (3, None, "429 too many"), 9: (1, None, "no such model")}
    assert 2 <= len(waits) <= 4 and 1990 <= sum(waits) <= 2100
    before = store.read("log").count()
    queue.drain(store, "log", work, call, ["k"], ["k"], OUT, per_second=1000, clock=lambda: clock[0], sleep=sleep)
    assert store.read("log").count() == before == 1 + 2 + 3 + 3 + 1
    more = queue.drain(store, "log", work.union(spark.createDataFrame([(0,), (0,)], "k long").select(F.col("k") - 7)), call, ["k"], ["k"], OUT, per_second=1000)
    assert {r.k for r in more.collect()} == {0, 1, 2, 3, 9, -7}
    nothing = queue.drain(store, "none", work.limit(0), call, ["k"], ["k"], OUT, per_second=1000)
    assert nothing.count() == 0


def test_null_keys_are_done_once(spark, tmp_path):
    work = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n long")
    done = queue.drain(Store(spark, str(tmp_path)), "log", work, lambda n, attempt: (str(n),), ["k"], ["n"], OUT, per_second=1000)
    assert sorted((str(r.k), r.answer) for r in done.collect()) == [("None", "1"), ("a", "2")]


def test_slices_read_their_own_folders(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "store")), []

    def make(pending):
        plan = pending._jdf.queryExecution().executedPlan().toString()
        seen.append((pending.count(), plan.count("PartitionFilters: [isnotnull(slice_of_4")))
        return pending.withColumn("v", F.col("k") * 2)

    work = spark.range(100).withColumnRenamed("id", "k")
    rows = store.append_slices("t", work.filter("k < 50"), ["k"], make, 4)
    assert rows.columns == ["k", "v"] and rows.count() == 50 and sum(n for n, _ in seen) == 50
    seen.clear()
    rows = store.append_slices("t", work, ["k"], make, 8)  # keeps its four slices
    assert rows.agg(F.count("*"), F.count_distinct("k"), F.sum("v")).first()[:] == (100, 100, 9900)
    assert [n for _, n in seen] == [2] * 4 and sum(n for n, _ in seen) == 50
    seen.clear()
    assert store.append_slices("plain", work, ["k"], lambda p: p, 1).count() == 100
    assert store.append_slices("plain", work.union(spark.range(100, 103)), ["k"], lambda p: p, 4).count() == 103
