"""Report tables that follow the results: only the runs that changed are made anew.

Results stand in keyed tables (by run) below one root. A writer puts the rows of some runs, whole runs at a
time; what it changed is the set of their ids, which `refresh` takes. It reads the partitions of these runs only, makes
their part of every report table, and replaces it. Both steps may be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import marts, scoring
from ..session import shared_dir
from ..sources import keyed

RUN = ["run_id"]
RESULTS = ("criteria", "calls", "verdicts")


def put_results(root: str, buckets: int = keyed.BUCKETS, **tables: DataFrame) -> DataFrame:
    """Writes criteria, calls and verdicts of some runs; returns the ids of these runs, written too."""
    changed = None
    for name, rows in tables.items():
        if name not in RESULTS:
            raise ValueError(f"unknown results {name!r}")
        keyed.put_rows(rows, f"{root}/{name}", RUN, buckets=buckets)
        ids = rows.select(*RUN).distinct()
        changed = ids if changed is None else changed.union(ids)
    path = shared_dir(changed.sparkSession, "changed")
    changed.distinct().write.parquet(path)
    return changed.sparkSession.read.parquet(path)


def refresh(spark: SparkSession, root: str, reports: str, cases: DataFrame, changed: DataFrame, on=("test_id",), buckets: int = keyed.BUCKETS) -> list[str]:
    """Brings all report tables below `reports` up to date for the changed runs and returns their names. A run that has no rows for a table any more leaves it."""
    parts = {name: keyed.rows_of(spark, f"{root}/{name}", changed, RUN, buckets) for name in RESULTS}
    path = shared_dir(spark, "tests")
    scoring.with_cases(scoring.test_scores(parts["criteria"]), cases, on).write.parquet(path)  # scored once for all tables
    tables = marts.mart_tables(spark.read.parquet(path), parts["calls"], parts["verdicts"])
    for name, mart in tables.items():
        keyed.put_rows(mart, f"{reports}/{name}", RUN, buckets=buckets, gone=changed)
    return list(tables)
