"""Monotone sequences in Elias-Fano form and a two-level n-gram trie made of them.

A sequence of n values below u is kept as n low parts of about log2(u / n) bits, packed, and a bit
vector with a one for each value at (high part + index). Successor search takes the run of values with
the wanted high part, found by two selects of zeros, and halves it by low parts. All functions take
arrays of queries.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_BITS_IN_BYTE = np.array([[j for j in range(8) if b >> j & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.int64)
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_PAIRS, _FOURS, _EIGHTS, _EACH, _TOPS = (np.uint64(0x0101010101010101 * b) for b in (0x55, 0x33, 0x0F, 0x01, 0x80))


class EliasFano:
    """n, the width of the low parts, low words, bytes of the high bits, and ones before each 64 bits."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        n_bits = (top >> self.width) + self.n + 2
        bits = np.zeros(-(-n_bits // 64) * 64, bool)
        bits[high + np.arange(self.n)] = True
        self.high = np.packbits(bits, bitorder="little")
        ones = _POPCOUNT[self.high].reshape(-1, 8).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        low_bits = np.zeros(self.n * self.width + 128, bool)
        if self.width:
            low = values & np.uint64((1 << self.width) - 1)
            low_bits[: self.n * self.width] = ((low[:, None] >> np.arange(self.width, dtype=np.uint64)) & np.uint64(1)).astype(bool).reshape(-1)
        self.low = np.packbits(low_bits[: len(low_bits) // 64 * 64], bitorder="little").view(np.uint64)

    ARRAYS = ("low", "high", "before")

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one (or zero), from 0."""
        before = self.before if ones else 64 * np.arange(len(self.before)) - self.before
        word = np.minimum(np.searchsorted(before, k, "right") - 1, len(self.before) - 2)
        bits = np.asarray(self.high).view(np.uint64)[word]
        if not ones:
            bits = ~bits
        # Ones in each byte, then in all bytes up to it: eight counts to a number. They are compared with k all at once.
        upto = bits - ((bits >> np.uint64(1)) & _PAIRS)
        upto = (upto & _FOURS) + ((upto >> np.uint64(2)) & _FOURS)
        upto = ((upto + (upto >> np.uint64(4))) & _EIGHTS) * _EACH
        left = (k - before[word]).astype(np.uint64)
        at = np.minimum(np.bitwise_count(((left * _EACH) | _TOPS) - upto & _TOPS), 7).astype(np.uint64) << np.uint64(3)
        left = left - (((upto << np.uint64(8)) >> at) & np.uint64(255))
        byte = ((bits >> at) & np.uint64(255)).astype(np.int64)
        return 64 * word + at.astype(np.int64) + _BITS_IN_BYTE[byte, np.minimum(left, np.uint64(7)).astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        place = i * self.width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = shift > 0
        value = np.where(over, value | (self.low[word + 1] << np.where(over, np.uint64(64) - shift, np.uint64(0))), value)
        return value & np.uint64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is x or more; n if there is none."""
        return self.search(x)[0]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, and whether that value is x."""
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        zeros = 64 * (len(self.before) - 1) - int(self.before[-1])
        inside = high < zeros
        h = np.where(inside, high, 0)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        hi = self._select(np.minimum(h, zeros - 1), False) - h
        lo, hi = np.where(inside, lo, self.n), np.where(inside, hi, self.n)
        wanted, ends = x & np.uint64((1 << self.width) - 1), hi.copy()
        on = np.flatnonzero(lo < hi)
        while len(on):
            mid = (lo[on] + hi[on]) >> 1
            smaller = self._low(mid) < wanted[on]
            lo[on] = np.where(smaller, mid + 1, lo[on])
            hi[on] = np.where(smaller, hi[on], mid)
            on = on[lo[on] < hi[on]]
        same = lo < ends  # the value found has the same high part
        same[same] = self._low(lo[same]) == wanted[same]
        return lo, same


class NgramTrie:
    """Contexts and their successors, each level in a memory-mapped file: ids, pointers and quantised values.

    `keys` are sorted distinct pairs (context id << 32 | successor id); `values` one byte each; `context_values`
    one byte for each distinct context. Successor ids are made monotone by adding the last one of the context before.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, context_values: np.ndarray):
        contexts = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ids = (keys & np.uint64(0xFFFFFFFF)) + np.uint64(1)
        ends = np.append(first[1:], len(keys))
        base = np.concatenate([[0], np.cumsum(ids[ends - 1])]).astype(np.uint64) if len(keys) else np.zeros(1, np.uint64)
        self.levels = {
            "contexts": EliasFano(contexts[first]), "pointers": EliasFano(np.append(first, len(keys)).astype(np.uint64)), "bases": EliasFano(base),
            "successors": EliasFano(ids + np.repeat(base[:-1], ends - first)),
        }
        self.values, self.context_values = values, context_values

    def mapped(self) -> "NgramTrie":
        """Puts every array into a file of this task and maps it. The file has no name left, so nothing stays behind."""
        holders = [(level, a) for level in self.levels.values() for a in EliasFano.ARRAYS] + [(self, "values"), (self, "context_values")]
        handle, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as out:
            places = []
            for holder, name in holders:
                a = np.ascontiguousarray(getattr(holder, name))
                out.write(b"\0" * (-out.tell() % 64))
                places.append((out.tell(), a.dtype, a.shape))
                out.write(a.tobytes())
        for (holder, name), (at, dtype, shape) in zip(holders, places, strict=True):
            if np.prod(shape):
                setattr(holder, name, np.memmap(path, dtype, "r", at, shape))
        os.unlink(path)
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted pairs: index of the context and of the pair; -1 where there is none."""
        wanted = keys >> np.uint64(32)
        first = np.concatenate([[True], wanted[1:] != wanted[:-1]]) if len(keys) else np.zeros(0, bool)
        distinct, which = wanted[first], np.cumsum(first) - 1
        n = self.levels["contexts"].n
        if not n or not len(keys):
            none = np.full(len(keys), -1, np.int64)
            return none, none
        c, known = self.levels["contexts"].search(distinct)
        c = np.where(known, c, -1)
        at = np.maximum(c, 0)
        lo, hi = (self.levels["pointers"][at + k].astype(np.int64) for k in (0, 1))
        base = self.levels["bases"][at]
        x = base[which] + (keys & np.uint64(0xFFFFFFFF)) + np.uint64(1)
        s, found = self.levels["successors"].search(x)
        return c[which], np.where(found & (c[which] >= 0) & (s >= lo[which]) & (s < hi[which]), s, -1)
