"""JSON arrays larger than a task: one file on many tasks, split at the bounds of its items.

Whether a byte stands inside a string, and how deep, depends on all bytes before it. So:

1. `summaries`: every range of a file is read on its own, and told for both cases (it begins outside or
   inside a string) how the depth changes and how many commas stand at each relative depth. The parity
   of its quotes says where it ends. A backslash run that crosses the start is looked up backwards.
2. `entered`: running sums of these small rows, in order, give the state in which each range begins.
3. `items`: every range is read once more. An item belongs to the range of the bracket or comma before
   it, and is read on to its end, so a task holds one item beside its piece of the file.

Files are opened by Arrow, as in `documents`. Text that is not UTF-8 is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import model_output
from ..session import shared_dir
from .documents import read_files, store_of

#: Defaults: bytes of a range, bytes of the ranges of a task, bytes looked at together, bytes of items handed on together.
RANGE_BYTES, TASK_BYTES, PIECE, BATCH_BYTES = 8 << 20, 64 << 20, 1 << 20, 4_000_000
BLANK = b" \t\r\n\x0b\x0c"

_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[ord(",")] = True

_COUNTS = pa.map_(pa.int64(), pa.int64())
_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("odd", pa.int64()), ("delta_out", pa.int64()), ("delta_in", pa.int64()), ("commas_out", _COUNTS), ("commas_in", _COUNTS)])
_ITEM = pa.schema([("path", pa.string()), ("item_seq", pa.int64()), ("raw", pa.string()), ("note", pa.string())])
OPENED, STRAY = "opened", "stray"


def _quotes(data: np.ndarray, slashes: int) -> tuple[np.ndarray, int]:
    """Places of the quotes that no backslash escapes, and how many backslashes end the piece (`slashes` end the one before)."""
    at = np.flatnonzero(data == ord('"'))
    other = np.flatnonzero(data != ord("\\"))
    if len(other) == len(data) and not slashes:
        return at, 0
    last = np.searchsorted(other, at) - 1
    run = np.where(last >= 0, at - 1 - other[np.maximum(last, 0)], at + slashes) if len(at) else at
    return at[run % 2 == 0], len(data) - 1 - int(other[-1]) if len(other) else slashes + len(data)


def _slashes_before(f, start: int) -> int:
    """Length of the run of backslashes that ends right before `start`."""
    n = 0
    while start > n:
        size = min(4096, start - n)
        f.seek(start - n - size)
        data = f.read(size)
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n


def _depths(data: np.ndarray, quotes: np.ndarray, quoted: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets and commas outside strings, and the depth after each, from 0."""
    at = np.flatnonzero(_MARK[data])
    at = at[(np.searchsorted(quotes, at) + quoted) % 2 == 0]
    return at, np.cumsum(_STEP[data[at]])


def _summary(f, start: int, end: int) -> tuple:
    slashes, odd, depth, commas = _slashes_before(f, start), 0, [0, 0], [{}, {}]
    f.seek(start)
    while start < end and (piece := f.read(min(PIECE, end - start))):
        start += len(piece)
        data = np.frombuffer(piece, np.uint8)
        quotes, slashes = _quotes(data, slashes)
        for begun in (0, 1):
            at, after = _depths(data, quotes, begun ^ odd)
            for d, n in zip(*np.unique(after[data[at] == ord(",")] + depth[begun], return_counts=True), strict=True):
                commas[begun][int(d)] = commas[begun].get(int(d), 0) + int(n)
            depth[begun] += int(after[-1]) if len(after) else 0
        odd ^= len(quotes) % 2
    return odd, *depth, *(list(c.items()) for c in commas)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            store, own = store_of(r["path"])
            with store.open_input_file(own) as f:
                rows.append((r["path"], r["start"], *_summary(f, r["start"], r["end"])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)


def _range_items(f, start: int, end: int, size: int, quoted: int, depth: int, commas: int) -> Iterator[tuple[int | None, bytes | None, str | None]]:
    """(place in the array, text, note) of the items whose bracket or comma stands in the range. Rows with a note
    have no text: `opened` for an array, `stray` for what a file that is one array cannot hold."""
    at, slashes, seq, first = start, _slashes_before(f, start), commas + 1, False
    held: list[bytes] | None = None
    f.seek(at)
    while at < size and (at < end or held is not None):
        piece = f.read(min(PIECE, (end if at < end else size) - at))
        data = np.frombuffer(piece, np.uint8)
        quotes, slashes = _quotes(data, slashes)
        marks, after = _depths(data, quotes, quoted)
        after = after + depth
        before = after - _STEP[data[marks]]
        bounds = np.flatnonzero(((data[marks] == ord(",")) & (before == 1)) | (before <= 0) | (after <= 0))
        begun = 0
        for k in bounds:
            place, code = int(marks[k]), piece[marks[k] : marks[k] + 1]
            if before[k] >= 1:
                if held is not None:
                    text = b"".join([*held, piece[begun:place]])
                    if text.strip(BLANK) or not first or code == b",":
                        yield seq, text, None
                    held = None
                if at + place >= end:
                    return
                if code == b",":
                    seq, held, first = seq + 1, [], False
                elif code != b"]":
                    yield None, None, STRAY
            else:
                if piece[begun:place].strip(BLANK):
                    yield None, None, STRAY
                if code == b"[" and before[k] == 0:
                    yield None, None, OPENED
                    held, first = [], True
                else:
                    yield None, None, STRAY
            begun = place + 1
        quoted = (quoted + len(quotes)) % 2
        depth = int(after[-1]) if len(after) else depth
        if held is not None:
            held.append(piece[begun:])
        elif depth <= 0 and piece[begun:].strip(BLANK):
            yield None, None, STRAY
        at += len(piece)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ITEM, strict=True)], schema=_ITEM)

    rows, held = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            store, own = store_of(r["path"])
            with store.open_input_file(own) as f:
                for seq, text, note in _range_items(f, r["start"], r["end"], r["size"], r["quoted"], r["depth"], r["commas"]):
                    rows.append((r["path"], seq, None if text is None else text.decode("utf-8", errors="replace"), note))
                    held += 32 + len(text or b"")
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
    if rows:
        yield batch_of(rows)


def _spread(ranges: DataFrame, total: int, task_bytes: int) -> DataFrame:
    """Ranges over as many tasks as their bytes ask for, whatever the size of their rows."""
    return ranges.repartition(max(1, -(-total // task_bytes)), "path", "start")


def entered(summaries: DataFrame) -> DataFrame:
    """Adds the state at the start of each range: `quoted`, `depth`, `commas` (of depth 1 before it); and `delta`."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("quoted") == 1
    here = F.coalesce(F.try_element_at(F.when(inside, F.col("commas_in")).otherwise(F.col("commas_out")), 1 - F.col("depth")), F.lit(0))
    return (
        summaries.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
        .withColumn("delta", F.when(inside, F.col("delta_in")).otherwise(F.col("delta_out")))
        .withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
        .withColumn("_here", here).withColumn("commas", F.coalesce(F.sum("_here").over(before), F.lit(0)))
        .drop("_here", "commas_in", "commas_out")
    )


def read_arrays(spark: SparkSession, root: str, suffixes: str = ".json", range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected files) from the files below `root` that each hold one JSON array of cases, of any size.

    The place in the array becomes `test_seq`. A file that is no array, holds anything beside it, or has an item that
    is no JSON is rejected as a whole, with `reason` and the place of its first bad item. Items that are JSON but no
    objects are no cases. An empty array gives neither cases nor a rejected file; an empty file is rejected. Code
    fences are not looked for. Ranges, their states and the items are written once below the shared folder.
    """
    folder = shared_dir(spark, "json-arrays")
    read_files(spark, root=root, suffixes=suffixes, content="false").select("path", "size", "error").write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    total = files.agg(F.sum("size")).first()[0] or 0
    readable = files.filter("error IS NULL AND size > 0")
    starts = readable.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = starts.withColumn("end", F.least(F.col("start") + range_bytes, "size"))

    summary = "path string, start long, odd long, delta_out long, delta_in long, commas_out map<long,long>, commas_in map<long,long>"
    _spread(ranges, total, task_bytes).mapInArrow(_summaries, summary).write.parquet(f"{folder}/summaries")
    entered(spark.read.parquet(f"{folder}/summaries")).write.parquet(f"{folder}/states")
    states = spark.read.parquet(f"{folder}/states")

    work = _spread(ranges.join(states.select("path", "start", "quoted", "depth", "commas"), ["path", "start"]), total, task_bytes)
    found = work.mapInArrow(_items, "path string, item_seq long, raw string, note string")
    # An item is parsed inside brackets of its own: exactly one value has to come back.
    framed = model_output.parse_json_array(found.withColumn("_array", F.concat(F.lit("["), "raw", F.lit("]"))), "_array")
    good = (F.col("parsed_by") == "fence") & (F.size("items") == 1)
    framed.withColumn("good", F.col("note").isNull() & F.coalesce(good, F.lit(False))).select("path", "item_seq", "raw", "note", "good").write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")

    ends = states.groupBy("path").agg(F.sum("delta").alias("depth"), (F.sum("odd") % 2).alias("quoted"))
    marks = items.groupBy("path").agg(
        F.count_if(F.col("note") == OPENED).alias("opened"), F.count_if(F.col("note") == STRAY).alias("stray"),
        F.min(F.when(F.col("note").isNull() & ~F.col("good"), F.col("item_seq"))).alias("bad_item"),
    )
    judged = files.join(ends, "path", "left").join(marks, "path", "left").select(
        "path", "bad_item",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((F.coalesce("opened", F.lit(0)) != 1) | (F.col("stray") > 0), "not one array").when((F.col("depth") != 0) | (F.col("quoted") != 0), "cut off")
        .when(F.col("bad_item").isNotNull(), "bad item").alias("reason"),
    )
    rejected = judged.filter("reason IS NOT NULL")
    kept = items.filter("good").join(rejected.select("path"), "path", "left_anti")
    parsed = model_output.parse_json_array(kept.select("path", "item_seq", F.concat(F.lit("["), "raw", F.lit("]")).alias("raw")), "raw")
    cases = model_output.cases_from_output(parsed).drop("test_seq").withColumnRenamed("item_seq", "test_seq")
    return cases, rejected
