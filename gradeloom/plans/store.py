"""The written tables of an evaluation, one folder each under one root."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


#: Partition column of tables written in slices, with their number behind it.
SLICED = "slice_of_"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path(name))
        return rows.drop(*[c for c in rows.columns if c.startswith(SLICED)])

    def exists(self, name: str) -> bool:
        try:
            self.read(name)
        except AnalysisException as exc:
            if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True

    def append(self, name: str, rows: DataFrame, partition_by: str | None = None) -> DataFrame:
        writer = rows.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.read(name)

    def append_slices(self, name: str, work: DataFrame, keys, make: Callable[[DataFrame], DataFrame], slices: int) -> DataFrame:
        """Rows that `make` gives for the work not in the table yet, committed slice by slice: a job that
        breaks off keeps every slice written before.

        A slice is a hash class of the keys, and a folder: of the work, which is written once in slices, and of the
        table. So each slice reads its own part of both, and all of them together read each once. A table keeps the
        number of slices that it was begun with; one that was begun without slices stays one folder.
        """
        held = self._slices(name) if self.exists(name) else slices
        if held <= 1:
            self.append(name, make(self.pending(name, work, keys)))
            return self.read(name)
        column = f"{SLICED}{held}"
        staged = shared_dir(self.spark, "work")
        work.withColumn(column, F.pmod(F.xxhash64(*keys), F.lit(held)).cast("int")).write.partitionBy(column).parquet(staged)
        for k in range(held):
            make(self.pending_slice(name, self.spark.read.parquet(staged), keys, column, k)).write.mode("append").parquet(f"{self.path(name)}/{column}={k}")
        return self.read(name)

    def _slices(self, name: str) -> int:
        """Number of slices of a table; 1 where it has none."""
        return max([int(c.removeprefix(SLICED)) for c in self._columns(name) if c.startswith(SLICED)], default=1)

    def _columns(self, name: str) -> list[str]:
        return self.spark.read.parquet(self.path(name)).columns

    def pending_slice(self, name: str, staged: DataFrame, keys, column: str, k: int) -> DataFrame:
        """The work of one slice without a row in the table yet; both sides read the folders of this slice only."""
        mine = staged.filter(F.col(column) == k).drop(column)
        if not self.exists(name):
            return mine
        done = self.spark.read.parquet(self.path(name)).filter(F.col(column) == k)
        return mine.join(done.select(*keys), list(keys), "left_anti")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def pending(self, name: str, work: DataFrame, keys) -> DataFrame:
        """Work without a row in the table yet."""
        if not self.exists(name):
            return work
        return work.join(self.read(name).select(*keys), list(keys), "left_anti")
