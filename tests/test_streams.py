"""Run tracking with state that ends, batch tables that are merged, and keyed tables that take repeats."""

import datetime as dt
import glob
import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

from gradeloom.sources import keyed, tables
from gradeloom.streaming import batches, finished_runs, progress, tracker

START = dt.datetime(2024, 1, 1)
EVENTS = "run_id string, test_id string, total long, at timestamp"


def minutes(n):
    return START + dt.timedelta(minutes=n)


class Feed:
    """A stream fed by one file per batch."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.root, self.options, self.n = spark.newSession(), tmp_path, options, 0
        for name, value in tracker.STATE_STORE.items():
            self.spark.conf.set(name, value)
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")

    def give(self, rows):
        """The updates of these rows' batch, and the rows in the state after it."""
        path = f"{self.root}/in/{self.n:03d}"
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(path)
        events = self.spark.readStream.schema(EVENTS).parquet(f"{self.root}/in/*")
        known = set(batches.folders(self.spark, f"{self.root}/out"))
        tracked = tracker.tracked_runs(events, delay="0 seconds", **self.options)
        query = progress.write_progress(tracked, f"{self.root}/out", f"{self.root}/checkpoint", available_now=True, merge_every=1000)
        query.awaitTermination()
        self.n += 1
        new = [f"{self.root}/out/{n}" for n in set(batches.folders(self.spark, f"{self.root}/out")) - known]
        found = [(r.run_id, r.done, r.total, r.last_test, r.status) for p in new for r in self.spark.read.parquet(p).collect()]
        sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return sorted(found), sizes[-1]


def test_a_run_from_start_to_end(spark, tmp_path):
    feed = Feed(spark, tmp_path, stall_after_ms=10 * 60_000, forget_after_ms=60 * 60_000)
    got, _ = feed.give([("a", None, 3, minutes(0)), ("a", "t1", None, minutes(1)), ("a", "t1", None, minutes(1)), ("b", "u", None, minutes(1)), ("z", None, 0, minutes(0)), ("n", "x", None, None)])
    assert got == [("a", 1, 3, "t1", "running"), ("b", 1, None, "u", "running"), ("z", 0, 0, None, "done")]
    got, _ = feed.give([("a", "t1", None, minutes(2)), ("c", "v", None, minutes(13))])
    assert ("a", 1, 3, "t1", "running") in got and ("c", 1, None, "v", "running") in got
    assert ("a", 1, 3, "t1", "stalled") in got and ("b", 1, None, "u", "stalled") in got  # silent for ten minutes
    got, _ = feed.give([("a", "t2", None, minutes(14)), ("a", "t3", None, minutes(14))])
    assert got == [("a", 3, 3, "t3", "done")]
    got, _ = feed.give([("a", "t3", None, minutes(15))])
    assert got == []  # a repeated call of a finished run
    got, rows = feed.give([("d", "w", None, minutes(300))])
    assert ("b", 1, None, "u", "abandoned") in got and ("c", 1, None, "v", "stalled") in got
    latest = {r.run_id: r.status for r in progress.latest_progress(batches.read_batches(spark, f"{tmp_path}/out")).collect()}
    assert latest == {"a": "done", "b": "abandoned", "c": "stalled", "d": "running", "z": "done"}


def test_state_holds_the_last_runs_only(spark, tmp_path):
    feed, sizes = Feed(spark, tmp_path, stall_after_ms=60_000, forget_after_ms=60_000), []
    for k in range(6):
        at = minutes(10 * k)
        finished = [(f"f{k}-{i}", t, n, at) for i in range(20) for t, n in ((None, 2), ("x", None), ("y", None))]
        sizes.append(feed.give([*finished, *((f"s{k}-{i}", "x", 9, at) for i in range(20))])[1])
    assert max(sizes[2:]) <= max(sizes[:2]) + 20, sizes
    assert sizes[-1] < 6 * sizes[0]


class Counted:
    """State of one run in memory that counts how often it is asked or changed."""

    def __init__(self):
        self.value, self.lists, self.n = None, {}, 0

    def getValueState(self, *_):
        return Variable(self, lambda: self.value, lambda v: setattr(self, "value", v))

    def getMapState(self, *_):
        return Variable(self, self.lists.get, self.lists.__setitem__)

    def registerTimer(self, at):
        self.n += 1

    deleteTimer = registerTimer


class Variable:
    def __init__(self, state, get, put):
        self.state, self._get, self._put = state, get, put

    def _count(self, x):
        self.state.n += 1
        return x

    def get(self):
        return self._count(self._get())

    def exists(self):
        return self.get() is not None

    def getValue(self, key):
        return self._count(self._get(key))

    def containsKey(self, key):
        return self.getValue(key) is not None

    def update(self, value):
        self._count(self._put(value))

    def updateValue(self, key, value):
        self._count(self._put(key, value))

    def clear(self):
        self._count(self.state.lists.clear())


def tracked_batch(run, tests, total=None):
    rows = pd.DataFrame({"total": pd.Series([total] + [None] * len(tests), dtype="float64"), "test_id": [None, *tests], "at_us": range(len(tests) + 1), "list": [hash(t) % 64 for t in ["", *tests]]})
    return next(iter(run.handleInputRows(("r",), iter([rows[:9], rows[9:]]), None)))


def test_a_run_takes_few_accesses_to_the_state():
    state, run = Counted(), tracker.RunTracker("run_id", 1, 1)
    run.init(state)
    for k in range(3):  # the second batch has half of the first again
        state.n = 0
        got = tracked_batch(run, [f"t{i}" for i in range(30 * k, 30 * k + 60)], 500)
        assert (got["done"][0], got["status"][0]) == (60 + 30 * k, "running") and state.n <= 8, state.n


@pytest.mark.parametrize("held", [50, 1 << 16])
def test_tests_of_a_long_run_are_counted_once(monkeypatch, held):
    monkeypatch.setattr(tracker, "HELD", held)
    state, run, seen = Counted(), tracker.RunTracker("run_id", 1, 1), set()
    run.init(state)
    for k in range(7):
        tests = [f"t{i}" for i in range(90 * k, 90 * k + 180)]
        seen |= set(tests)
        got = tracked_batch(run, tests + tests[:5], 720)
        assert (got["done"][0], got["status"][0]) == (len(seen), "done" if len(seen) == 720 else "running")
        if k < 6:
            assert sum(len(x[0]) for x in state.lists.values()) == len(seen) and max(len(x[0]) for x in state.lists.values()) <= tracker.FIRST
    assert not state.lists


def test_batches_are_merged(spark, tmp_path):
    table = str(tmp_path / "table")
    newest = finished_runs._newest
    for k in range(9):
        batch = spark.createDataFrame([("same", k, k), (f"r{k}", k, 10 - k)], "run_id string, n long, timestamp long")
        for _ in range(2):  # Spark repeats a batch
            batches.write_batch(batch, k, table, lambda rows: newest(rows, "run_id", "timestamp"), merge_every=3)
    assert len(batches.folders(spark, table)) <= 4
    got = {r.run_id: r.n for r in finished_runs.read_history_stream(spark, table).collect()}
    assert got == {"same": 8, **{f"r{k}": k for k in range(9)}}
    # A merge that broke off before the old folders went is made again.
    batches.merge(spark, table, 7, lambda rows: newest(rows, "run_id", "timestamp"))
    extra = spark.read.parquet(f"{table}/{max(batches.folders(spark, table), key=len)}")
    extra.write.parquet(f"{table}/batch_id=5")
    batches.merge(spark, table, 7, lambda rows: newest(rows, "run_id", "timestamp"))
    assert {r.run_id: r.n for r in finished_runs.read_history_stream(spark, table).collect()} == got
    assert len(batches.folders(spark, table)) == 2


def rows_at(spark, path):
    return [tuple(r) for r in keyed.read_keyed(spark, path).select("run_id", "n", "kind").collect()]


@pytest.mark.parametrize("partition_by", [None, "kind"])
def test_repeated_appends_change_nothing(spark, tmp_path, partition_by):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "y"), (None, 4, "x")], "run_id string, n long, kind string")
    for _ in range(3):
        keyed.put_rows(first, path, ["run_id"], partition_by)
    before = rows_at(spark, path)
    assert len(before) == 4
    more = spark.createDataFrame([("a", 9, "x"), ("c", 5, "y")], "run_id string, n long, kind string")
    for _ in range(2):
        keyed.put_rows(more, path, ["run_id"], partition_by)
    assert {(r.run_id, r.n) for r in keyed.read_keyed(spark, path).collect()} == {("a", 9), ("b", 3), ("c", 5), (None, 4)}


def test_files_are_bounded_by_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(8):
        keyed.put_rows(spark.range(40 * k, 40 * k + 40).withColumnRenamed("id", "run_id"), path, ["run_id"], buckets=4)
    assert len(glob.glob(f"{path}/*/*.parquet")) == 4 and spark.read.parquet(path).count() == 320


def test_newest_row_of_a_key_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([("a", 5)], [("a", 3), ("b", 1)], [("b", 2), ("b", 1)]):
        keyed.put_rows(spark.createDataFrame(rows, "run_id string, n long"), path, ["run_id"], newest=[F.desc("n")])
    assert {(r.run_id, r.n) for r in keyed.read_keyed(spark, path).collect()} == {("a", 5), ("b", 2)}


def test_sinks_take_repeats_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "history")
    old = spark.createDataFrame([("r1", "evaluation", 50.0)], "run_id string, run_type string, overall_pct double").withColumn("category_scores", F.create_map(F.lit("c"), F.lit(1.0)))
    new = old.withColumns({"run_id": F.lit("r2"), "dag_pct": F.lit(7.0)})
    for rows in (old, new, old, new):
        tables.append_eval_runs(rows, path)
    got = {r.run_id: (r.overall_pct, r.dag_pct, r.category_scores, r.report_path) for r in tables.read_history(spark, path).collect()}
    assert got == {"r1": (50.0, None, '{"c":1.0}', None), "r2": (50.0, 7.0, '{"c":1.0}', None)}
    assert os.path.isdir(f"{path}/run_type=evaluation")
    runs, issues = str(tmp_path / "runs"), str(tmp_path / "issues")
    run, lines = spark.createDataFrame([("r1", 1)], "run_id string, n int"), spark.createDataFrame([("r1", "x"), ("r1", "y")], "run_id string, issue string")
    for _ in range(2):
        tables.append_calibration_run(run, lines, runs, issues)
    assert (keyed.read_keyed(spark, runs).count(), keyed.read_keyed(spark, issues).count()) == (1, 2)
    other = run.withColumn("run_id", F.lit("r2"))
    tables.append_calibration_run(other, lines.withColumn("run_id", F.lit("r2")).limit(1), runs, issues)
    tables.append_calibration_run(run, lines.limit(0), runs, issues)  # calibrated again, without issues
    assert (keyed.read_keyed(spark, runs).count(), [r.run_id for r in keyed.read_keyed(spark, issues).collect()]) == (2, ["r2"])
    versions = spark.createDataFrame([("eng", 1, "p", "", "")], "role_slug string, id long, prompt_text string, test_cases string, context_text string")
    for _ in range(2):
        tables.append_role_version(versions, str(tmp_path / "versions"))
    assert keyed.read_keyed(spark, str(tmp_path / "versions")).count() == 1
