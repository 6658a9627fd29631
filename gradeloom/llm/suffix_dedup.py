"""Suffix-array dedup with a difference-cover sample, one suffix bucket at a time.

Wanted: the bytes covered by a string of `length` bytes that starts at two places. Sorted suffixes
would show them as neighbours that agree that far. All suffixes of a large corpus are too many to
sort, so:

1. *Cover sample.* Positions whose remainder by `period` lies in a difference cover. Any two suffixes
   i, j have a shift d < period that takes both to sample positions, so two suffixes that agree for
   `length` bytes hold two equal sample strings of length - period + 1 bytes. The samples' names
   (fingerprints, in order) are sorted bucket by bucket, and each sample learns whether its name is
   tied. A suffix without a tied sample in reach can have no partner: it is resolved without sorting.
2. *Buckets of suffixes.* The suffixes that the sample leaves are sorted one bucket at a time by the
   name of their first `length` bytes, which takes the place of comparing letters: only equality to
   that depth matters, and the depth beyond which the sample decides is bounded by the period.
   Neighbours with one name are repeats.

Buckets are ranges of names, as many as keep each at a fixed size, so a task's memory does not grow
with the corpus. A block of documents sends each of its names once, with a mark if it has it twice;
a passage that a third of all documents share costs one name per block and no pairs arise.

Null text: empty. Matches never cross documents; repeated rows are copies of each other whatever
their ids, and null ids are ids like any other. A text shorter than `length` loses nothing. A table
that isn't read from files must be checkpointed first. An empty table gives no rows. Other columns
are left out, so no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.session import shared_dir

from . import exchange as ex, text_blocks as tb

LENGTH, PERIOD = 200, 64
#: Bits of a name besides those that tell its bucket, in steps 1 and 2. A false tie of samples only costs work. With
#: buckets of a fixed size, two different suffixes of a bucket share a name with a chance of about 1e-4 per bucket.
SAMPLE_BITS, SUFFIX_BITS = 31, 50
BLOCK_BYTES = 12_000_000
RESULT = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept binary"


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences give every residue; each step adds the one with the most new differences."""
    cover, have = [0], np.zeros(period, bool)
    have[0] = True
    residues = np.arange(period)
    while not have.all():
        c = np.array(cover)
        new = np.concatenate([(residues[:, None] - c) % period, (c - residues[:, None]) % period], 1)
        gain = [np.count_nonzero(~have[np.unique(row)]) for row in new]
        best = int(np.argmax(gain))
        have[new[best]] = True
        cover.append(best)
    return np.array(sorted(cover))


def _names(buf: np.ndarray, offsets: np.ndarray, width: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of `width` bytes that lie in one document, and their positions; only where `mask` holds."""
    keys, places = [], []
    for i, _, b, o in tb.chunks(buf, offsets):
        at = tb.whole_windows(o, width)
        if mask is not None:
            at = at[mask[at + offsets[i]]]
        keys.append(tb.byte_windows(tb.byte_sums(b), width)[at])
        places.append(at + offsets[i])
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _cover_names(buf: np.ndarray, offsets: np.ndarray, length: int, period: int, n_buckets: int):
    in_cover = np.zeros(period, bool)
    in_cover[difference_cover(period)] = True
    sampled = in_cover[(np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))) % period]
    keys, at = _names(buf, offsets, length - period + 1, sampled)
    return _short(keys, SAMPLE_BITS, n_buckets), at


def _short(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """The leading bits that tell the bucket and `bits` more, still in the place of 64-bit keys."""
    drop = np.uint64(max(0, 64 - bits - n_buckets.bit_length()))
    return (keys >> drop) << drop


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where in it each distinct one begins."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)


def _in_answers(keys: np.ndarray, answers: dict[int, list[np.ndarray]], n_buckets: int) -> np.ndarray:
    """Mask of a block's keys that were answered with yes."""
    order, first = _runs(keys)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(ex.answered(keys[order[first]], answers, n_buckets), np.diff(np.append(first, len(keys))))
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and 1 for those that come more than once."""
    ranked = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[first], (np.diff(np.append(first, len(ranked))) > 1).astype(np.uint64)


def _tied(blocks: list[list[np.ndarray]]):
    """Sorts one bucket: for each block, which of its names come at two places."""
    order, first = _runs(np.concatenate([b[0] for b in blocks]))
    if not len(order):
        return [(ex.packed_bits(b[0] > 0),) for b in blocks]
    sizes = np.diff(np.append(first, len(order)))
    twice = np.concatenate([b[1] for b in blocks]) > 0
    tied = np.empty(len(order), bool)
    tied[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(twice[order], first), sizes)
    return [(ex.packed_bits(t),) for t in np.split(tied, np.cumsum([len(b[0]) for b in blocks])[:-1])]


def _send_samples(length: int, period: int, n_buckets: int):
    return lambda batch, buf, offsets: _distinct(_cover_names(buf, offsets, length, period, n_buckets)[0])


def _reached(found: np.ndarray, offsets: np.ndarray, period: int) -> np.ndarray:
    """Mask of the bytes that have one of the rising positions `found` less than `period` ahead in their document."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    lo = np.maximum(found - period + 1, offsets[np.searchsorted(offsets, found, "right") - 1])
    first = np.flatnonzero(np.diff(lo, prepend=-1))  # the first bytes of a document may begin for many
    edge[lo[first]] = np.diff(np.append(first, len(lo)))
    edge[found + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _open_suffixes(length: int, period: int, n_buckets: int):
    """Texts with a bit for each suffix that the sample leaves open; `open` if there is any."""

    def run(batch, buf, offsets, answers):
        keys, at = _cover_names(buf, offsets, length, period, n_buckets)
        found = at[_in_answers(keys, answers, n_buckets)]
        bits = _reached(found, offsets, period)
        some = tb.per_document(bits, offsets) > 0
        marks = [np.packbits(bits[lo:hi]).tobytes() if s else b"" for s, lo, hi in zip(some, offsets[:-1], offsets[1:], strict=True)]
        return pa.table({"doc_id": batch.column(0), "text": batch.column(1).cast(pa.string()), "marks": pa.array(marks, pa.binary()), "open": pa.array(some)})

    return run


def _suffix_names(batch, buf, offsets, length, n_buckets):
    marks = batch.column(2).to_pylist()
    bits = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks, np.diff(offsets), strict=True)]) > 0
    keys, at = _names(buf, offsets, length, bits)
    return _short(keys, SUFFIX_BITS, n_buckets), at


def _send_suffixes(length: int, n_buckets: int):
    return lambda batch, buf, offsets: _distinct(_suffix_names(batch, buf, offsets, length, n_buckets)[0])


def _removed(length: int, n_buckets: int):
    def run(batch, buf, offsets, answers):
        keys, at = _suffix_names(batch, buf, offsets, length, n_buckets)
        gone = tb.covered(at[_in_answers(keys, answers, n_buckets)], length, len(buf))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(buf)]] = gone[offsets[:-1][offsets[:-1] < len(buf)]]
        kept = [buf[lo:hi][~gone[lo:hi]].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.table({
            "doc_id": batch.column(0), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(tb.per_document(gone, offsets)),
            "n_spans": pa.array(tb.per_document(begins, offsets)), "kept": pa.array(kept, pa.binary()),
        })

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes)."""
    if not 1 <= period <= length:
        raise ValueError("period must be from 1 to length")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, n = docs.schema["doc_id"].dataType.simpleString(), ex.bucket_count(docs, "text")
    folder, schema = shared_dir(spark, "open-suffixes"), f"doc_id {kind}, text string, marks binary, open boolean"
    ties = ex.answer(ex.send(docs, _send_samples(length, period, n), n, BLOCK_BYTES), _tied, n)
    ex.matched(docs, ties, _open_suffixes(length, period, n), schema, BLOCK_BYTES).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "8").partitionBy("open").parquet(folder)
    read = spark.read.schema(schema).parquet(folder)
    left = read.filter("open").select("doc_id", "text", "marks")
    repeats = ex.answer(ex.send(left, _send_suffixes(length, n), n, BLOCK_BYTES), _tied, n)
    cut = ex.matched(left, repeats, _removed(length, n), RESULT.format(id=kind), BLOCK_BYTES)
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    done = read.filter("NOT open").select("doc_id", F.octet_length(bytes_).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), bytes_.alias("kept"))
    return cut.unionByName(done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT rid, s, hash(substr(x, 2 * s + 1, 400)) AS h FROM (SELECT rid, x, unnest(range(0, n - 199)) AS s FROM d WHERE n >= 200)),
f AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
r AS (SELECT rid, s, s - lag(s) OVER (PARTITION BY rid ORDER BY s) > 200 AS apart FROM g JOIN f USING (h)),
k AS (SELECT rid, s, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM r),
e AS (SELECT rid, run, min(s) AS lo, max(s) + 200 AS hi FROM k GROUP BY rid, run),
o AS (SELECT rid, list(struct_pack(lo := lo, hi := hi) ORDER BY lo) AS spans, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM e GROUP BY rid),
p AS (SELECT *, CASE WHEN spans IS NULL THEN x ELSE
        substr(x, 1, 2 * spans[1].lo) || array_to_string(list_transform(range(1, len(spans) + 1), lambda j:
          substr(x, 2 * spans[j].hi + 1, 2 * (CASE WHEN j < len(spans) THEN spans[j + 1].lo ELSE n END - spans[j].hi))), '') END AS y FROM d LEFT JOIN o USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(y)) AS kept_sha256 FROM p
"""
