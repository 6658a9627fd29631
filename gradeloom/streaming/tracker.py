"""Status of live runs, from a stream of their starts and calls, with state that ends.

A run is `running` until all its tests were called, then `done`. One that is silent for `stall_after` of event time
becomes `stalled` (a later call sets it running again), and `abandoned` after `forget_after` more. A finished run keeps a
mark for `forget_after`, so that repeated calls do not begin it anew; then, as after `abandoned`, nothing is left. So the state
holds the runs of the last while and not all there ever were.

Needs the RocksDB state store: `STATE_STORE` in the session that starts the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import gradeloom

# Ship this package with the processor, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(gradeloom)

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RUNNING, DONE, STALLED, ABANDONED = "running", "done", "stalled", "abandoned"
UPDATE = "{key} {kind}, done long, total long, last_test string, last_us long, status string"
#: A run's first tests are kept in one list, as many as FIRST; those beyond in LISTS others, of which a batch reads and
#: writes those that it touches. So a run of few tests takes one access to the state, whatever its tests.
LISTS, FIRST_LIST, FIRST = 64, -1, 256
#: Tests of one run that a batch holds before it puts them into the lists.
HELD = 1 << 16


class RunTracker(StatefulProcessor):
    def __init__(self, key: str, stall_ms: int, forget_ms: int):
        self.key, self.stall_ms, self.forget_ms = key, stall_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "total long, done long, last_test string, last_us long, status string, timer long")
        self.tests = handle.getMapState("tests", "list int", "tests array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.run.get()
        total, done, last_test, last_us, status, timer = before or (None, 0, None, None, RUNNING, None)
        if status == DONE:  # calls that came again
            return
        held = self.tests.getValue((FIRST_LIST,)) if done else None
        first, pending, n_pending = set(held[0]) if held else set(), {}, 0
        stored = done > 0
        for part in rows:
            most = part["total"].max()
            if most == most:
                total = max(int(most), total or 0)
            last_us = max(int(part["at_us"].max()), last_us if last_us is not None else -(1 << 62))
            calls = [c for c in zip(part["at_us"].tolist(), part["test_id"].tolist(), part["list"].tolist()) if isinstance(c[1], str)]
            if not calls:
                continue
            newest = max(calls)
            if last_test is None or newest[0] >= last_us:
                last_test = newest[1]
            for _, test, number in calls:
                pending.setdefault(number, set()).add(test)
            n_pending += len(calls)
            if n_pending >= HELD:
                n, lists = self._added(pending, first, done)
                self._put(lists)
                done, stored, pending, n_pending = done + n, True, {}, 0
        n, lists = self._added(pending, first, done)
        done += n
        status = DONE if total is not None and done >= total else RUNNING
        if status != DONE:
            self._put(lists)
        elif stored:
            self.tests.clear()
        wake = last_us // 1000 + (self.forget_ms if status == DONE else self.stall_ms)
        self._wake(timer, wake)
        self.run.update((total, done, last_test, last_us, status, wake))
        yield self._row(key, total, done, last_test, last_us, status)

    def _added(self, pending: dict[int, set[str]], first: set[str], done: int) -> tuple[int, dict[int, set[str]]]:
        """How many of the pending tests are new to a run of `done` tests, and the lists with them."""
        new = {number: tests - first for number, tests in pending.items()}
        n = sum(map(len, new.values()))
        if done == len(first) and done + n <= FIRST:
            first.update(*new.values())
            return n, {FIRST_LIST: first} if n else {}
        n, lists = 0, {}
        for number, tests in new.items():
            held = self.tests.getValue((number,)) if tests else None
            seen = set(held[0]) if held else set()
            if not tests <= seen:
                n, lists[number] = n + len(tests - seen), seen | tests
        return n, lists

    def _put(self, lists: dict[int, set[str]]) -> None:
        for number, tests in lists.items():
            self.tests.updateValue((number,), (sorted(tests),))

    def _wake(self, before: int | None, at: int) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)

    def _row(self, key, total, done, last_test, last_us, status) -> pd.DataFrame:
        return pd.DataFrame({
            self.key: [key[0]], "done": [done], "total": pd.array([total], "Int64"), "last_test": [last_test], "last_us": [last_us], "status": [status],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, done, last_test, last_us, status, timer = self.run.get()
        if status == RUNNING:
            wake = expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms
            self.handle.registerTimer(wake)
            self.run.update((total, done, last_test, last_us, STALLED, wake))
            yield self._row(key, total, done, last_test, last_us, STALLED)
            return
        self.run.clear()
        self.tests.clear()
        if status == STALLED:
            yield self._row(key, total, done, last_test, last_us, ABANDONED)

    def close(self) -> None:
        pass


def run_events(starts: DataFrame, calls: DataFrame, keys=("run_id", "test_id"), at: str = "started_at") -> DataFrame:
    """One stream of starts (run, total, at) and calls (run, test, at), for `tracked_runs`."""
    run, test = keys
    started = starts.select(run, F.lit(None).cast("string").alias("test_id"), F.col("total").cast("long").alias("total"), F.col(at).cast("timestamp").alias("at"))
    called = calls.select(run, F.col(test).cast("string").alias("test_id"), F.lit(None).cast("long").alias("total"), F.col(at).cast("timestamp").alias("at"))
    return started.unionByName(called)


def tracked_runs(events: DataFrame, key: str = "run_id", delay: str = "1 hour", stall_after_ms: int = 3_600_000, forget_after_ms: int = 86_400_000) -> DataFrame:
    """Updates of each run: done, total, last_test, last_us (microseconds), status. Rows without time are left out, as are those later than the delay."""
    kind = events.schema[key].dataType.simpleString()
    rows = (
        events.filter("at IS NOT NULL").withWatermark("at", delay)
        .withColumns({"at_us": F.unix_micros("at"), "list": F.pmod(F.xxhash64("test_id"), F.lit(LISTS)).cast("int")})
    )
    return rows.groupBy(key).transformWithStateInPandas(
        RunTracker(key, stall_after_ms, forget_after_ms), UPDATE.format(key=key, kind=kind), "update", "EventTime")
