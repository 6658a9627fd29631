"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

Documents are dealt by ranges of id, sorted, tokenized and written, a few files for each range, so the files in the
order of their names hold the ids of all documents in ascending order of doc_id. Nothing but the texts is shuffled,
once. A file is written under another name and then renamed, and holds the same bytes whoever writes it, so a task that runs
again does no harm. A row for each file (`index`) tells how many ids stand before it.

A file, little-endian: magic, block size, documents, ids, blocks; then doc ids, a byte for each that is null, the
place of each document's first id and of the end, the start of each block and the end, and the blocks. A block takes
the minimum off its ids, packs the low bits of the rest at the width that a chosen share of them needs, and lists the
others by place and whole value. Any span of ids is read by way of the block starts, without the rest of the file.

Null ids come first; documents that share an id are in the order of their texts' hashes, equal rows in any. A null
text is empty and becomes its end id alone. A text of any length is tokenized in parts cut at white space. Other columns are left out, so no
name can clash. An empty table gives no file and no row. `doc_id` must be an integer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from . import packing, text_blocks as tb

MAGIC = b"pforids1"
BLOCK_IDS, LANES = 1024, 16
#: Share of a block's ids that its width must hold.
PERCENTILE = 0.98
#: Text of a range, ids of a file (a document is never cut), bytes tokenized at once.
RANGE_BYTES, FILE_IDS, PART_BYTES = 32_000_000, 4_000_000, 4_000_000
#: Ids unpacked at once, and handed on at once.
RUN_BLOCKS, BATCH_IDS = 512, 1_000_000
HEAD = np.dtype([("min", "<u4"), ("exceptions", "<u2"), ("width", "u1"), ("pad", "u1")])
INDEX = "file string, part long, number long, n_docs long, n_ids long"


# --- blocks --------------------------------------------------------------------------

def _lanes(width: int) -> Iterator[tuple[int, int, int, int]]:
    """For the 64 values of a lane: number, word, bits to its left in the word, and bits that go to the next word."""
    for k in range(64):
        word, shift = divmod(k * width, 64)
        yield k, word, shift, shift + width - 64


def packed(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks of ids, and the start of each and the end."""
    n_blocks = -(-len(ids) // BLOCK_IDS)
    starts, bodies = np.zeros(n_blocks + 1, np.uint64), []
    for first in range(0, n_blocks, RUN_BLOCKS):
        run = ids[first * BLOCK_IDS : (first + RUN_BLOCKS) * BLOCK_IDS]
        values = np.concatenate([run, np.full(-len(run) % BLOCK_IDS, run[-1], np.uint32)]).reshape(-1, BLOCK_IDS)
        least = values.min(1)
        rest = values - least[:, None]
        enough = np.partition(rest, int(percentile * (BLOCK_IDS - 1)), 1)[:, int(percentile * (BLOCK_IDS - 1))]
        widths = np.ceil(np.log2(enough.astype(np.float64) + 1)).astype(np.int64)
        beyond = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
        head = np.zeros(len(values), HEAD)
        head["min"], head["exceptions"], head["width"] = least, beyond.sum(1), widths
        words: list[bytes] = [b""] * len(values)
        for width in np.unique(widths[widths > 0]).tolist():
            of = np.flatnonzero(widths == width)
            lanes = (rest[of] & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(-1, 64, LANES)
            out = np.zeros((len(of), width, LANES), np.uint64)
            for k, word, shift, over in _lanes(width):
                out[:, word] |= lanes[:, k] << np.uint64(shift)
                if over > 0:
                    out[:, word + 1] |= lanes[:, k] >> np.uint64(width - over)
            for i, block in zip(of.tolist(), out.astype("<u8", copy=False), strict=True):
                words[i] = block.tobytes()
        for i in range(len(values)):
            places = np.flatnonzero(beyond[i])
            bodies.append(head[i].tobytes() + words[i] + places.astype("<u2").tobytes() + values[i][places].astype("<u4").tobytes())
    np.cumsum([len(b) for b in bodies], out=starts[1:])
    return b"".join(bodies), starts


def unpacked(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at `starts[:-1]` of `body`; the last block may have surplus ids at its end."""
    starts = starts.astype(np.int64)
    head = body[starts[:-1, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    out = np.empty((len(head), BLOCK_IDS), np.uint32)
    for width in np.unique(head["width"]).tolist():
        of = np.flatnonzero(head["width"] == width)
        lanes = np.zeros((len(of), 64, LANES), np.uint64)
        if width:
            at = starts[of, None] + HEAD.itemsize + np.arange(width * LANES * 8)
            words = body[at].reshape(-1).view("<u8").reshape(len(of), width, LANES)
            mask = np.uint64((1 << width) - 1)
            for k, word, shift, over in _lanes(width):
                lanes[:, k] = words[:, word] >> np.uint64(shift)
                if over > 0:
                    lanes[:, k] |= words[:, word + 1] << np.uint64(width - over)
                lanes[:, k] &= mask
        out[of] = lanes.reshape(-1, BLOCK_IDS).astype(np.uint32) + head["min"][of, None]
    for i in np.flatnonzero(head["exceptions"]).tolist():
        n, end = int(head["exceptions"][i]), int(starts[i + 1])
        out[i][body[end - 6 * n : end - 4 * n].view("<u2")] = np.frombuffer(body[end - 4 * n : end].tobytes(), "<u4")
    return out.reshape(-1)


# --- files ---------------------------------------------------------------------------

def file_bytes(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    body, starts = packed(ids, percentile)
    head = np.array([BLOCK_IDS, len(doc_ids), len(ids), len(starts) - 1], "<u8")
    numbers, nulls = np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), numbers.tobytes(), nulls.tobytes(), bounds.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), body])


class TokenFile:
    """A file's content (bytes or a memory map): documents and any span of ids."""

    def __init__(self, content):
        whole = np.frombuffer(content, np.uint8)
        if whole[:8].tobytes() != MAGIC:
            raise ValueError("not a file of token ids")
        size, self.n_docs, self.n_ids, n_blocks = (int(x) for x in whole[8:40].view("<u8"))
        if size != BLOCK_IDS:
            raise ValueError(f"blocks of {size} ids")
        at = 40

        def section(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(whole[at - n * np.dtype(kind).itemsize : at].tobytes(), kind)

        numbers, nulls = section("<i8", self.n_docs), section("u1", self.n_docs)
        self.doc_ids = pa.array(numbers, pa.int64(), mask=nulls.astype(bool))
        self.bounds, self.starts = section("<u8", self.n_docs + 1).astype(np.int64), section("<u8", n_blocks + 1)
        self.body = whole[at:]

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from `start` up to `end`; only their blocks are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
        parts = [unpacked(self.body, self.starts[k : min(k + RUN_BLOCKS, last + 1) + 1]) for k in range(first, last + 1, RUN_BLOCKS)]
        return np.concatenate(parts)[start - first * BLOCK_IDS : end - first * BLOCK_IDS]

    def document(self, number: int) -> np.ndarray:
        return self.span(int(self.bounds[number]), int(self.bounds[number + 1]))


# --- tokenizing ----------------------------------------------------------------------

def encoder(path: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Function from (bytes, offsets) of texts to (ids, where each text's begin and the end). Words are encoded once each
    where the file says that words are independent of each other; any other tokenizer gets whole texts."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    if described["model"].get("end_of_word_suffix") == "</w>":
        return packing._tokenizer(path).ids
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast([raw[i:j].decode() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    whole.needs_whole_texts = True  # type: ignore[attr-defined]
    return whole


def text_parts(buf: np.ndarray, offsets: np.ndarray, limit: int, cut_inside: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, offsets in the part, which pieces end a document) of parts of about `limit` bytes; longer texts are cut behind white space."""
    cuts, ends = [0], []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while cut_inside and end - start > limit:
            space = np.flatnonzero(~tb.PLAIN_WORD[buf[start + limit // 2 : start + limit]])
            if len(space):
                at = start + limit // 2 + int(space[-1]) + 1
            else:  # one long word
                space = np.flatnonzero(~tb.PLAIN_WORD[buf[start + limit : end]])
                at = start + limit + int(space[0]) + 1 if len(space) else end
            if at >= end:
                break
            cuts.append(at)
            ends.append(False)
            start = at
        cuts.append(end)
        ends.append(True)
    places, marks, i = np.array(cuts, np.int64), np.array(ends, bool), 0
    while i < len(marks):
        j = max(i + 1, int(np.searchsorted(places, places[i] + limit, "right")) - 1)
        yield int(places[i]), places[i : j + 1] - places[i], marks[i:j]
        i = j


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, file_ids: int, part_bytes: int, percentile: float) -> Iterator[pa.RecordBatch]:
    encode = None
    store, base = pafs.FileSystem.from_uri(folder)
    part, number = TaskContext.get().partitionId(), 0
    doc_ids, bounds, held, n_held, made = [], [0], [], 0, []

    def close() -> None:
        nonlocal doc_ids, bounds, held, n_held, number
        name, own = f"{part:09d}-{number:06d}.pfor", f"{base}/_{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(file_bytes(doc_ids, np.array(bounds), np.concatenate(held), percentile))
        if store.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
            store.move(own, f"{base}/{name}")
        else:  # another attempt of this task wrote the same bytes
            store.delete_file(own)
        made.append((name, part, number, len(doc_ids), n_held))
        doc_ids, bounds, held, n_held, number = [], [0], [], 0, number + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        encode = encode or encoder(path)
        buf, offsets = tb.buffers(batch.column(1))
        names, done = batch.column(0).to_pylist(), 0
        for first, inside, is_end in text_parts(buf, offsets, part_bytes, not getattr(encode, "needs_whole_texts", False)):
            ids, begin = encode(buf[first : first + int(inside[-1])], inside)
            after = begin[1:][is_end]
            ids = np.insert(ids, after, end_id).astype(np.uint32, copy=False)
            after = after + np.arange(1, len(after) + 1)
            # A file ends behind the first document that fills it.
            at = 0
            for end in after.tolist():
                doc_ids.append(names[done])
                done += 1
                bounds.append(n_held + end - at)
                if bounds[-1] >= file_ids:
                    held.append(ids[at:end])
                    n_held, at = bounds[-1], end
                    close()
            held.append(ids[at:])
            n_held += len(ids) - at
    if doc_ids:
        close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["file", "part", "number", "n_docs", "n_ids"])
    tb.give_back()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, so that Spark and the tasks' own writer mean the same place."""
    if "://" in folder:
        return folder
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_ids(
    docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = packing.END_ID,
    range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS, part_bytes: int = PART_BYTES, percentile: float = PERCENTILE,
) -> DataFrame:
    """Writes the files below `folder` and returns their index, written there too: file, start (ids before it), n_docs, n_ids."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/ids", recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), F.asc("sig"), F.asc("row")]
    keyed = rows.withColumns({"sig": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    sorted_rows = keyed.repartitionByRange(max(1, -(-total // range_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = sorted_rows.mapInArrow(lambda it: _write(it, f"{folder}/ids", tokenizer_path, end_id, file_ids, part_bytes, percentile), INDEX)
    made.write.parquet(f"{folder}/made")
    # Ids before each file: inside groups of files, and before each group.
    made = spark.read.parquet(f"{folder}/made").withColumn("group", F.floor(F.col("part") / 1024))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("group").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    groups = made.groupBy("group").agg(F.sum("n_ids").alias("sum")).select("group", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    start = F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    made.join(groups, "group").select("file", start.alias("start"), "n_docs", "n_ids").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file_start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = TokenFile(content.as_buffer())
            i = 0
            while i < held.n_docs:
                j = max(i + 1, int(np.searchsorted(held.bounds, held.bounds[i] + BATCH_IDS, "right")) - 1)
                bounds = held.bounds[i : j + 1]
                ids = held.span(int(bounds[0]), int(bounds[-1])).astype("<u4", copy=False)
                where = pa.py_buffer((4 * (bounds - bounds[0])).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [held.doc_ids.slice(i, j - i), pa.array(file_start + bounds[:-1]), pa.array(np.diff(bounds)),
                     pa.Array.from_buffers(pa.large_binary(), j - i, [None, where, pa.py_buffer(ids.tobytes())]).cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                i = j
    tb.give_back()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document in all files), n_tokens and ids (little-endian 32-bit) of every document."""
    folder = qualified(spark, folder)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pfor").load(f"{folder}/ids")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    index = spark.read.parquet(f"{folder}/index").select("file", "start")
    return files.join(index, "file").select("start", "content").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    folder = shared_dir(spark, "token_ids")
    write_ids(docs, folder, packing.default_tokenizer())
    return read_ids(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
