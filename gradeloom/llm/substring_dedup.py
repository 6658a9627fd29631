"""Substring dedup by fixed-block anchors.

Any run of `window` words holds a whole block of (window + 1) // 2 words that starts at a multiple of
that length. So the index takes those non-overlapping reference blocks, and every rolling window of a
block's length probes it. A block that stands in two documents anchors windows around it; these are
extended word by word as long as the whole window is one that starts in a document with a smaller id,
which gives maximal repeats. The first document keeps the words, later ones lose them.

Two exchanges (see `exchange`): short fingerprints of blocks and probes first, which leaves the few
texts with anchors; then 64-bit hashes of their windows with the smallest document that has them. A
window that thousands of documents share is sent once per block of documents; no pairs are made.

A null text has no words. Ids must be integers; a document without id never counts as the smaller
one, and loses nothing. Rows that share an id don't take words from each other. A table that isn't read from files must
be checkpointed first. An empty table gives no rows. Other columns are left out; no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.session import shared_dir

from . import exchange as ex, text_blocks as tb

WINDOW = 13
#: Bits of a probe's fingerprint besides those that name its bucket.
PROBE_BITS = 30
RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _hashes(buf: np.ndarray, offsets: np.ndarray):
    """Hash of each word and the number of words before each document."""
    parts, bounds, before = [], [np.zeros(1, np.int64)], 0
    for _, _, b, o in tb.chunks(buf, offsets):
        starts, ends, own = tb.word_spans(b, o, tb.PLAIN_WORD)
        parts.append(tb.span_hash(tb.byte_sums(b), starts, ends))
        bounds.append(own[1:] + before)
        before += len(starts)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(bounds)


def _short(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The leading bits that tell the bucket and PROBE_BITS more, still in the place of 64-bit keys."""
    drop = np.uint64(max(0, 64 - PROBE_BITS - n_buckets.bit_length()))
    return (keys >> drop) << drop


def _probes(hashes: np.ndarray, bounds: np.ndarray, width: int, n_buckets: int):
    """Fingerprint and place of every rolling window of a block's length, and whether it is a reference block."""
    at = tb.whole_windows(bounds, width)
    keys = _short(tb.item_windows(hashes, width)[at], n_buckets)
    return keys, at, (at - np.repeat(bounds[:-1], np.diff(bounds))[at]) % width == 0


def _sent_probes(width: int, n_buckets: int):
    def run(batch, buf, offsets):
        hashes, bounds = _hashes(buf, offsets)
        keys, at, is_block = _probes(hashes, bounds, width, n_buckets)
        own = tb.owners(bounds)[at]
        order = np.argsort(keys, kind="stable")
        keys, own, is_block = keys[order], own[order], is_block[order]
        if not len(keys):
            return keys, np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        indexed = np.maximum.reduceat(is_block, first)
        several = np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)
        return keys[first], indexed.astype(np.uint64) | (several.astype(np.uint64) << np.uint64(1))

    return run


def _anchors(blocks: list[list[np.ndarray]]):
    """For each block, which of its fingerprints stand in two documents and at least once in the index."""
    keys = np.concatenate([b[0] for b in blocks])
    flags = np.concatenate([b[1] for b in blocks])
    order = np.argsort(keys, kind="stable")
    ranked, flags = keys[order], flags[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    several = (np.diff(np.append(first, len(ranked))) > 1) | (np.maximum.reduceat(flags & np.uint64(2), first) > 0)
    hit = ranked[first][several & (np.bitwise_or.reduceat(flags, first) & np.uint64(1) > 0)]
    return [(ex.packed_bits(np.isin(b[0], hit, assume_unique=True)),) for b in blocks]


def _sent_windows(window: int):
    def run(batch, buf, offsets):
        hashes, bounds = _hashes(buf, offsets)
        at = tb.whole_windows(bounds, window)
        keys = tb.item_windows(hashes, window)[at]
        ids, known = _ids(batch)
        own = tb.owners(bounds)[at]
        keep = _near_anchor(batch, bounds, at, window) & known[own]
        keys, own = keys[keep], ids[own[keep]]
        order = np.lexsort([own, keys])
        keys, own = keys[order], own[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        return keys[first], own[first]

    return run


def _near_anchor(batch, bounds, at, window):
    """Windows that hold an anchor: their words' marks are kept with the text, one bit for each word."""
    marks = batch.column(2).to_pylist()
    sizes = np.diff(bounds)
    bits = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks, sizes, strict=True)]) if len(marks) else np.zeros(0, np.uint8)
    return bits[at] > 0


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    return ex.pa_ints(batch.column(0)), batch.column(0).is_valid().to_numpy(zero_copy_only=False)


def _smallest(blocks: list[list[np.ndarray]]):
    """Of each block, the windows that a smaller document outside has, and that document."""
    sizes = [len(b[0]) for b in blocks]
    keys, ids = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]).view(np.int64)
    order = np.lexsort([ids, keys])
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    least = np.empty(len(keys), np.int64)
    least[order] = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    ends = np.cumsum(sizes)
    out = []
    for b, lo, hi in zip(blocks, ends - sizes, ends, strict=True):
        smaller = least[lo:hi] < ids[lo:hi]
        out.append((b[0][smaller], least[lo:hi][smaller]))
    return out


def _removed(window: int):
    def run(batch, buf, offsets, answers):
        hashes, bounds = _hashes(buf, offsets)
        at = tb.whole_windows(bounds, window)
        keys = tb.item_windows(hashes, window)[at]
        ids, known = _ids(batch)
        own = tb.owners(bounds)[at]
        keep = _near_anchor(batch, bounds, at, window) & known[own]
        at, keys, own = at[keep], keys[keep], ids[own[keep]]
        gone = np.zeros(len(hashes), bool)
        if len(at):
            order = np.lexsort([own, keys])
            first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
            least = np.empty(len(keys), np.int64)
            least[order] = own[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            if answers:
                there, ids_there = np.concatenate([a[0] for a in answers.values()]), np.concatenate([a[1] for a in answers.values()]).view(np.int64)
                order = np.lexsort([ids_there, there])
                there, ids_there = there[order], ids_there[order]
                if len(there):
                    place = np.minimum(np.searchsorted(there, keys), len(there) - 1)
                    least = np.where(there[place] == keys, np.minimum(least, ids_there[place]), least)
            gone = tb.covered(at[least < own], window, len(hashes))
        kept = [_kept_words(t, gone[lo:hi]) if gone[lo:hi].any() else t for t, lo, hi in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True)]
        return pa.table({
            "doc_id": batch.column(0).cast(pa.int64()), "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(tb.per_document(gone, bounds)), "kept": pa.array(kept, pa.string()),
            **{name: batch.column(name) for name in batch.schema.names if name.startswith("keep_")},
        })

    return run


def _kept_words(text: str, gone: np.ndarray) -> str:
    words = joined_words(text).split(" ")
    return " ".join(w for w, g in zip(words, gone, strict=True) if not g)


_SPACES = str.maketrans("\t\n\v\f\r", "     ")


def joined_words(text: str | None) -> str:
    """The words of a text with one blank between them."""
    return " ".join(filter(None, (text or "").translate(_SPACES).split(" ")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text itself where nothing is removed, else the kept words with one blank
    between), and the columns `keep` of the document as `keep_0` and so on."""
    spark = docs.sparkSession
    extra = {f"keep_{k}": c for k, c in enumerate(keep or [])}
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in extra.items()))
    more = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in extra)
    width, n = (window + 1) // 2, ex.bucket_count(docs, "text")
    folder, schema = shared_dir(spark, "anchored-texts"), f"doc_id long, text string, marks binary, n_words long, open boolean{more}"
    probes = ex.answer(ex.send(docs.select("doc_id", "text"), _sent_probes(width, n), n), _anchors, n)
    ex.matched(docs, probes, _marked(window, width, n), schema).write.option("compression", "zstd").partitionBy("open").parquet(folder)
    read = spark.read.schema(schema).parquet(folder)
    anchored = read.filter("open").select("doc_id", "text", "marks", *extra)
    least = ex.answer(ex.send(anchored.select("doc_id", "text", "marks"), _sent_windows(window), n), _smallest, n)
    later = ex.matched(anchored, least, _removed(window), RESULT + more)
    done = read.filter("NOT open").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"), *extra)
    return later.unionByName(done)


def _marked(window: int, width: int, n_buckets: int):
    """Texts with a bit for each word from which a window with an anchor in it may start; `open` if there is any."""

    def run(batch, buf, offsets, answers):
        hashes, bounds = _hashes(buf, offsets)
        keys, at, _ = _probes(hashes, bounds, width, n_buckets)
        sent, place = np.unique(keys, return_inverse=True)
        found = at[ex.answered(sent, answers, n_buckets)[place]]
        back = window - width
        starts = np.maximum(found - back, np.repeat(bounds[:-1], np.diff(bounds))[found])
        edge = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, found + 1, -1)
        bits = np.cumsum(edge[:-1]) > 0
        some = tb.per_document(bits, bounds) > 0
        marks = [np.packbits(bits[lo:hi]).tobytes() if s else b"" for s, lo, hi in zip(some, bounds[:-1], bounds[1:], strict=True)]
        return pa.table({
            "doc_id": batch.column(0).cast(pa.int64()), "text": batch.column(1).cast(pa.string()), "marks": pa.array(marks, pa.binary()), "n_words": pa.array(np.diff(bounds)), "open": pa.array(some),
            **{name: batch.column(name) for name in batch.schema.names if name.startswith("keep_")},
        })

    return run


def _digests(batches):
    for batch in batches:
        texts = batch.column(3).to_pylist()
        sums = [hashlib.sha256(joined_words(t).encode()).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", "kept").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING count(*) > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS wd FROM g JOIN f USING (h) WHERE least < doc_id),
x AS (SELECT doc_id, list(wd) AS gone FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda t: NOT list_contains(gone, t[2])), lambda t: t[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
