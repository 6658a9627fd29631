"""Calls with a shared rate limit and retries that wait in a table, not in a task.

Every attempt is a row of a log: keys, attempt, error, what the call returned, and when it ended. What is to be
done next follows from the work and its log: a key without a row is due at once, one whose newest
attempt failed for a passing reason is due when its wait is over, any other is finished. So a row that must
wait holds no task, and a job that breaks off goes on where the log ends.

The limit holds for all tasks of a job together: work goes to a fixed number of tasks, and each
keeps a distance between the starts of its calls such that no second sees more than the limit, whatever
the number of tasks that run at the same time. Speculative tasks must be off, as the session's settings have it.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed_values as fv
from .apply import CALLS_AT_ONCE, retry_policy
from .spread import null_safe_join

ATTEMPT = T.StructType([T.StructField("attempt", T.LongType()), T.StructField("error", T.StringType()), T.StructField("finished_us", T.LongType())])


def spacing(per_second: float, tasks: int) -> tuple[int, float]:
    """(tasks, seconds between the starts of a task's calls) so that no second sees more than `per_second` calls.

    A task that starts calls every s seconds starts at most 1 / s + 1 in any second."""
    if per_second <= 0:
        raise ValueError("the limit must be positive")
    if per_second < 2:
        return 1, 1.001 * max(1.0, 1 / per_second)  # two calls exactly a second apart may seem nearer
    tasks = max(1, min(tasks, int(per_second // 2)))
    return tasks, 1.001 * tasks / (per_second - tasks)


class Pace:
    """Lets callers go one after the other, `seconds` apart."""

    def __init__(self, seconds: float, first_after: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self.next, self.lock = clock() + first_after, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            at = max(self.next, self.clock())
            self.next = at + self.seconds
            while (left := at - self.clock()) > 0:
                self.sleep(left)


def due_work(work: DataFrame, log: DataFrame | None, keys, now_us: int | None = None, first_wait: float = fv.FIRST_WAIT_SECONDS) -> DataFrame:
    """Work that is not finished: its columns, attempt (the number of the next one) and due_us. With `now_us`, only what is due.

    Of a key that stands in the work twice, both rows are asked for; their attempts count together."""
    if log is None:
        waiting = work.withColumns({"attempt": F.lit(1).cast("long"), "due_us": F.lit(0).cast("long")})
    else:
        newest = log.groupBy(*keys).agg(F.max(F.struct("attempt", "finished_us", "error")).alias("_l")).select(*keys, "_l.*")
        policy = retry_policy(newest)
        wait_us = (F.pow(F.lit(2.0), F.col("attempt") - 1) * first_wait * 1_000_000).cast("long")
        state = policy.select(*keys, "retry", (F.col("attempt") + 1).alias("attempt"), (F.col("finished_us") + wait_us).alias("due_us"))
        waiting = (
            null_safe_join(work, state, list(keys), "left").filter(F.coalesce("retry", F.lit(True))).drop("retry")
            .withColumns({"attempt": F.coalesce("attempt", F.lit(1)), "due_us": F.coalesce("due_us", F.lit(0))})
        )
    return waiting if now_us is None else waiting.filter(F.col("due_us") <= now_us)


def attempted(
    due: DataFrame, call: Callable, keys, inputs, outputs: T.StructType, per_second: float, tasks: int = 8, concurrency: int = 4,
) -> DataFrame:
    """One attempt for each row: keys, attempt, error, finished_us and the outputs. `call(*inputs, attempt)` returns a tuple of the outputs."""
    keys, inputs = list(keys), list(inputs)
    rows = due.select(*keys, *[c for c in inputs if c not in keys], "attempt")
    tasks, apart = spacing(per_second, tasks)
    kinds = [to_arrow_type(f.dataType) for f in [*ATTEMPT, *outputs]]
    names = [f.name for f in [*ATTEMPT, *outputs]]

    def once(pace: Pace, values: tuple) -> tuple:
        pace.wait()
        try:
            made, error = tuple(call(*values)), None
        except Exception as exc:
            made, error = (None,) * len(outputs), str(exc)
        return values[-1], error, int(dt.datetime.now(dt.timezone.utc).timestamp() * 1_000_000), *made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is run again lets the second pass that its forerunner may have used.
        pace = Pace(apart, 1.0 if TaskContext.get().attemptNumber() else 0.0)
        with ThreadPoolExecutor(concurrency) as pool:
            for whole in batches:
                for start in range(0, whole.num_rows, CALLS_AT_ONCE * concurrency):
                    batch = whole.slice(start, CALLS_AT_ONCE * concurrency)
                    values = zip(*(batch.column(c).to_pylist() for c in [*inputs, "attempt"]), strict=True)
                    done = list(pool.map(lambda v: once(pace, v), values))
                    made = [pa.array([row[i] for row in done], type=kind) for i, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + made, names=keys + names)

    return rows.repartition(tasks, *keys).mapInArrow(run, T.StructType([rows.schema[k] for k in keys] + list(ATTEMPT) + list(outputs)))


def drain(
    store, name: str, work: DataFrame, call: Callable, keys, inputs, outputs: T.StructType, per_second: float, tasks: int = 8, concurrency: int = 4,
    first_wait: float = fv.FIRST_WAIT_SECONDS, round_calls: int | None = None, gather: float = 1.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Attempts until every row of the work is finished, written to the table `name` of the store; returns `finished_calls` of it.

    Each round asks for what is due then and writes its attempts; with `round_calls` for the first so many in due order, so that less is
    lost if a job breaks off. While nothing is due the driver waits for the first row that will be, and `gather` seconds for those soon
    after it; no task waits.
    """
    while True:
        log = store.read(name) if store.exists(name) else None
        waiting = due_work(work, log, keys, first_wait=first_wait)
        first = waiting.agg(F.min("due_us")).first()[0]
        if first is None:
            if log is None:  # no work: an empty log
                log = store.append(name, attempted(waiting, call, keys, inputs, outputs, per_second, tasks, concurrency))
            return finished_calls(log, keys)
        now = int(clock() * 1_000_000)
        if first > now:
            sleep((first - now) / 1_000_000 + gather)
            continue
        due = waiting.filter(F.col("due_us") <= now)
        if round_calls:
            due = due.orderBy("due_us", *keys).limit(round_calls)
        store.append(name, attempted(due, call, keys, inputs, outputs, per_second, tasks, concurrency))


def finished_calls(log: DataFrame, keys) -> DataFrame:
    """The newest attempt of each key, with its outputs or its last error."""
    values = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("attempt", "finished_us")).alias("_l"))
    return newest.select(*keys, "_l.*")
