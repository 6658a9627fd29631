"""Texts of an Arrow batch as numpy arrays: bytes, word spans and rolling hashes.

All functions work on whole batches, so the cost of numpy calls is shared by many texts. A
document is cut out of the batch by `offsets`; nothing ever spans two documents.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time. The arrays beside them take up to a hundred times as much, and each worker keeps
#: tables of this length; two workers share an executor.
CHUNK_BYTES = 1 << 19

_ALL = np.arange(256)
#: Bytes of words `[^\x20\x09-\x0D]+`.
PLAIN_WORD = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z were lower-cased.
ALNUM_WORD = ~((_ALL <= 0x2F) | ((_ALL >= 0x3A) & (_ALL <= 0x60)) | ((_ALL >= 0x7B) & (_ALL <= 0x7F)))
#: A-Z to a-z, every other byte to itself.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_BYTE_BASE, _ITEM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def worker_state() -> dict:
    """A dictionary that lives as long as the process. Functions reach workers by value, with new globals for each
    task; what should outlast a task, or stay out of what is sent, is kept here."""
    return sys.modules.setdefault("gradeloom_worker_state", types.ModuleType("gradeloom_worker_state")).__dict__


def give_back() -> None:
    """Hands freed memory back to the system. Workers stay for later tasks, and would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more."""
    held = worker_state().setdefault("powers", {})
    have = held.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        have = (made[0], made[1])
        if size <= CHUNK_BYTES + 1:  # tables for a single huge text are not kept
            held[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each value spread over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of runs of documents of about CHUNK_BYTES; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and for each document the number of words before it (one more at the end)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any span."""
    up, _ = _power_table(_BYTE_BASE, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[buf] * up[: len(buf)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    _, down = _power_table(_BYTE_BASE, len(sums))
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xA0761D6478BD642F))


def byte_windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each position on."""
    if len(sums) <= width:
        return np.zeros(0, np.uint64)
    _, down = _power_table(_BYTE_BASE, len(sums))
    return mixed((sums[width:] - sums[:-width]) * down[: len(sums) - width])


def item_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` items (words) from each item on, also across documents: see `whole_windows`."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    up, down = _power_table(_ITEM_BASE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: len(hashes) - width + 1])


def owners(bounds: np.ndarray) -> np.ndarray:
    """Document of each item, from the number of items before each document."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def whole_windows(bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions whose window of `width` items lies in one document."""
    n = int(bounds[-1])
    if n < width:
        return np.zeros(0, np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    start = np.arange(n - width + 1)
    return start[start + width <= ends[: n - width + 1]]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n items: which lie in a window of `width` items from one of `starts` on."""
    begins = np.zeros(n, bool)
    begins[starts] = True
    edge = begins.astype(np.int32)
    edge[width:] -= begins[: max(0, n - width)]
    return np.cumsum(edge, dtype=np.int32) > 0


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the items' values in each document."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
