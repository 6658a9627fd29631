"""Fingerprints of many documents brought together in small sorted blocks.

A *block* is the documents of one Arrow batch. For every *bucket* (range of fingerprints) a block
sends one row: its distinct fingerprints in order, as differences in compressed byte planes. A
row per fingerprint would take several times the room. Buckets are ranges of hash values, as many
as keep a bucket's rows at a fixed size whatever the input's size; a fingerprint that a third of all
documents share is sent once per block. Answers go back to blocks by their number, where the same
documents are read again.

A block's number is made of its ids, sizes and bytes, so the two readings find each other if the rows of a
partition come in the same order both times. That is so for tables that are read from files; write
or checkpoint() anything else first. `matched` raises an error otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text_blocks as tb

#: Bytes of text for each bucket, and of each block.
BUCKET_BYTES, BLOCK_BYTES = 6_000_000, 12_000_000
#: From so many numbers on, each byte plane is compressed apart: random and nearly constant ones need codes of their own.
APART = 2048
#: Texts are packed once and rest on disk for the whole run.
TEXT_LEVEL = 7
SENT = "bucket int, block long, body binary"


def encode(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes; the first must be sorted and is held as differences, without the low bits that are zero in all."""
    parts, zeros = [], 0
    for k, a in enumerate(arrays):
        a = a.view(np.uint64) if a.dtype == np.int64 else a.astype(np.uint64)
        if k == 0 and len(a):
            used = int(np.bitwise_or.reduce(a))
            zeros = (used & -used).bit_length() - 1 if used else 0
            a = np.diff(a >> np.uint64(zeros), prepend=np.uint64(0))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T))
    n = len(arrays[0])
    apart = n >= APART
    head = np.array([len(arrays) | zeros << 8 | apart << 16, n], np.int64).tobytes()
    if not apart:
        return head + pa.compress(np.concatenate(parts).tobytes(), codec="zstd", asbytes=True) if n else head
    # A plane of zeros takes no room, one that does not get smaller stays as it is.
    planes = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) if p.any() else b"" for part in parts for p in part]
    planes = [z if len(z) < n else p.tobytes() for z, p in zip(planes, (p for part in parts for p in part), strict=True)]
    return b"".join([head, np.array([len(z) for z in planes], np.uint32).tobytes(), *planes])


def decode(body: bytes) -> list[np.ndarray]:
    k, n = (int(x) for x in np.frombuffer(body[:16], np.int64))
    k, zeros, apart = k & 255, k >> 8 & 255, k >> 16
    if not n:
        return [np.zeros(0, np.uint64) for _ in range(k)]
    if apart:
        raw, at = np.zeros((k, 8, n), np.uint8), 16 + 32 * k
        for plane, size in zip(raw.reshape(8 * k, n), np.frombuffer(body[16:at], np.uint32).tolist(), strict=True):
            if size:
                part = body[at : at + size]
                plane[:] = np.frombuffer(part if size == n else pa.decompress(part, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
                at += size
    else:
        raw = np.frombuffer(pa.decompress(body[16:], decompressed_size=k * n * 8, codec="zstd", asbytes=True), np.uint8).reshape(k, 8, n)
    out = [np.ascontiguousarray(part.T).reshape(-1).view(np.uint64) for part in raw]
    out[0] = np.cumsum(out[0], dtype=np.uint64) << np.uint64(zeros)
    return out


def bucket_count(docs: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for all texts: in proportion to their bytes."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def edges(n_buckets: int, whole_bits: int = 0) -> np.ndarray:
    """First fingerprint of each bucket but the first; keys that differ in the last `whole_bits` only are not parted."""
    return np.array([((k << 64) // n_buckets) >> whole_bits << whole_bits for k in range(1, n_buckets)], np.uint64)


def cut(keys: np.ndarray, n_buckets: int, whole_bits: int = 0) -> np.ndarray:
    """Bounds of the buckets in sorted keys."""
    return np.concatenate([[0], np.searchsorted(keys, edges(n_buckets, whole_bits)), [len(keys)]]).astype(np.int64)


def block_number(ids: pa.Array, offsets: np.ndarray, buf: np.ndarray) -> int:
    """Number of a block, from the ids (null as zero), sizes and bytes of its documents."""
    text = int.from_bytes(hashlib.blake2b(buf, digest_size=8).digest(), "little", signed=True)
    whole = np.concatenate([[len(offsets), text], pa_ints(ids), offsets]).astype(np.int64).view(np.uint64)
    return int(tb.item_windows(tb.mixed(whole + np.uint64(1)), len(whole)).view(np.int64)[0])


def pa_ints(ids: pa.Array) -> np.ndarray:
    """Ids as integers: of any other type by hash; null as 0 (see `null_ids`)."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, offsets = tb.buffers(ids.cast(pa.string()))
    return tb.span_hash(tb.byte_sums(buf), offsets[:-1], offsets[1:]).view(np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(documents, bytes, offsets, number) of blocks of about `limit` bytes of text; a longer text is a block of its own."""
    for batch in batches:
        _, sizes = tb.buffers(batch.column(1))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + limit, "right")) - 1)
            part = batch.slice(i, j - i)
            buf, offsets = tb.buffers(part.column(1))
            yield part, buf, offsets, block_number(part.column(0), offsets, buf)
            i = j


def send(docs: DataFrame, fingerprints: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], n_buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of `SENT`. `docs` has columns id and text first; `fingerprints(documents, bytes, offsets)` gives sorted distinct keys and arrays beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets, block in blocks_of(batches, block_bytes):
            arrays = fingerprints(batch, buf, offsets)
            bounds = cut(arrays[0], n_buckets)
            full = np.flatnonzero(np.diff(bounds))
            bodies = [encode(*(a[bounds[k] : bounds[k + 1]] for a in arrays)) for k in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block)), pa.array(bodies, pa.binary())], names=["bucket", "block", "body"]
            )
            del arrays, bodies
            tb.give_back()

    return docs.mapInArrow(run, SENT)


def packed_bits(mask: np.ndarray) -> np.ndarray:
    """A mask as 64-bit words, to be sent as an answer to sorted keys."""
    return np.packbits(np.concatenate([mask, np.zeros(-len(mask) % 64, bool)])).view(np.uint64)


def answered(keys: np.ndarray, answers: dict[int, list[np.ndarray]], n_buckets: int) -> np.ndarray:
    """Mask of a block's sorted keys, from the answers of `packed_bits`."""
    out, bounds = np.zeros(len(keys), bool), cut(keys, n_buckets)
    for k, arrays in answers.items():
        lo, hi = bounds[k], bounds[k + 1]
        out[lo:hi] = np.unpackbits(arrays[0].view(np.uint8), count=hi - lo)
    return out


def answer(sent: DataFrame, judge: Callable[[list[list[np.ndarray]]], list[tuple[np.ndarray, ...] | None]], n_buckets: int) -> DataFrame:
    """Rows (block, bucket, body) that `judge` gives back for the blocks of each bucket; none where it gives None or nothing."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blocks, bodies = table.column("block").to_numpy(), table.column("body").to_pylist()
        order = np.lexsort([[len(b) for b in bodies], blocks])  # the same whatever came first
        bucket = int(table.column("bucket")[0].as_py())
        back = judge([decode(bodies[k]) for k in order])
        rows = [(int(blocks[k]), encode(*x)) for k, x in zip(order, back, strict=True) if x is not None and len(x[0])]
        tb.give_back()
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary()),
        })

    spread = sent.repartition(max(n_buckets, 1), "bucket") if n_buckets > 1 else sent
    return spread.groupBy("bucket").applyInArrow(run, "block long, bucket int, body binary")


def packed_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, level: int = TEXT_LEVEL) -> DataFrame:
    """One row for each block: block, body (its documents as a compressed Arrow stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, block in blocks_of(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])
        tb.give_back()

    return docs.mapInArrow(run, "block long, body binary")


def matched(
    docs: DataFrame, answers: DataFrame, finish: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, dict[int, list[np.ndarray]]], pa.Table], schema: str,
    block_bytes: int = BLOCK_BYTES, level: int = TEXT_LEVEL,
) -> DataFrame:
    """Documents and the answers to their block, together: `finish(documents, bytes, offsets, answers by bucket)`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("rows came in another order when read again: write or checkpoint() the input first")
        # The same documents, word for word, may stand in two blocks; both get the same answers.
        by_bucket = {k: decode(b) for k, b in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True)}
        made = []
        for body in left.column("body").to_pylist():
            batch = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
            made.append(finish(batch, *tb.buffers(batch.column(1)), by_bucket))
        tb.give_back()
        return pa.concat_tables(made)

    return packed_texts(docs, block_bytes, level).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
