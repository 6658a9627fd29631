"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every distinct shingle of five words is an element, all of one weight, however often a text has it: with
equal weights the probability Jaccard similarity is the Jaccard similarity of the sets, which is what is
verified. An element's arrivals are a Poisson process of its weight as rate, with random places among the
registers; each register keeps its first arrival, so registers are equal with that similarity as chance.
Arrivals come in increasing order, so an element stops at the first one later than all registers' times:
most stop at once. All texts of a run advance together, one arrival of every element left per step.

Texts of equal words are one before banding. Texts that share a band are candidates; similarity is
then verified on whole shingle sets (Jaccard >= 0.8). In a bucket all members are compared with the
smallest one, the centre, and components are taken. Members outside the centre's component are then
compared with another member of it, drawn at random in each of their buckets, and components are
taken again. What is still apart is compared with all members of other components in its buckets, but
only where a link is possible: x and y share the centre's shingles that both have (a bit for each was
kept by the first comparison), and outside the centre no more than the smaller of their shingles that
are in any other text at all. Pairs that cannot reach the threshold by that bound are not made. So no
link that matters for the classes is lost, and a group of copies doesn't give all its pairs.

Words are those of `native_words`, A-Z lower-cased. A text of fewer than five words, but not none, is
one shingle. Texts without words (null, empty, marks only) are classes of their own. Rows of one id
are one document if their words are equal; else each links the id. Null ids are left out. Ids are
integers. A table that isn't read from files should be checkpointed, for it is read twice. An empty
table gives no rows. Other columns are left out, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.session import shared_dir

from . import exchange as ex, text_blocks as tb
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Pairs or sets that a worker decodes at a time.
STEP_ROWS = 512
#: Bands and registers in a band. A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** 4) ** 20 > 0.9999 (equal weights).
BANDS, ROWS = 20, 4


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, counts and documents of each (sorted by document and shingle), and the whole-text hashes of documents."""
    buf = tb.LOWER[buf]
    starts, ends, bounds = tb.word_spans(buf, offsets, tb.ALNUM_WORD)
    hashes = tb.span_hash(tb.byte_sums(buf), starts, ends)
    whole = np.zeros((2, len(offsets) - 1), np.uint64)
    sizes = np.diff(bounds)
    for k in range(2):
        keys = hashes if not k else tb.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
        up, down = tb._power_table(tb._ITEM_BASE, len(keys) + 1)
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(keys * up[: len(keys)], out=sums[1:])
        whole[k] = tb.mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + sizes.astype(np.uint64))
    at = tb.whole_windows(bounds, SHINGLE)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    keys = np.concatenate([tb.item_windows(hashes, SHINGLE)[at], whole[0][short]])
    docs = np.concatenate([tb.owners(bounds)[at], short])
    order = np.lexsort([keys, docs])
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), docs[first], whole


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) / 2**53


def prob_min_hash(keys: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Element kept by each register of each document, zeros for documents without elements."""
    times, kept = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, np.uint64)
    arrival, step = np.zeros(len(keys)), 0
    while len(keys):
        step += 1
        bits = tb.mixed(keys + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        arrival = arrival - np.log(_unit(bits)) / weights
        place = docs * registers + (tb.mixed(bits ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, place, arrival)
        won = times[place] == arrival
        kept[place[won]] = keys[won]
        latest = times.reshape(n_docs, registers).max(1)
        on = arrival < latest[docs]
        keys, weights, docs, arrival = keys[on], weights[on], docs[on], arrival[on]
    return kept.reshape(n_docs, registers)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = tb.buffers(batch.column(1))
        for i, j, b, o in tb.chunks(buf, offsets):
            keys, _, docs, whole = shingles(b, o)
            kept = prob_min_hash(keys, np.ones(len(keys)), docs, j - i, BANDS * ROWS)
            bands = _band_hashes(kept)
            n = np.bincount(docs, minlength=j - i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))],
                names=["doc_id", "n_shingles", "words_a", "words_b", "bands"],
            )
            del keys, docs, whole, kept, bands, n
        tb.give_back()


def _band_hashes(kept: np.ndarray) -> np.ndarray:
    """A hash for each band of each document; the band's number is part of it."""
    out = np.empty((len(kept), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(kept), tb.mixed(np.array([k + 1], np.uint64))[0])
        for r in range(ROWS):
            h = tb.mixed(h * np.uint64(0x9E3779B97F4A7C15) + kept[:, k * ROWS + r])
        out[:, k] = h
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = tb.buffers(batch.column(1))
        for i, j, b, o in tb.chunks(buf, offsets):
            keys, _, docs, _ = shingles(b, o)
            cuts = np.searchsorted(docs, np.arange(j - i + 1))
            bodies = [ex.encode(keys[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "body"])
            del keys, docs, bodies
        tb.give_back()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(i, STEP_ROWS)


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _steps(batches):
        values, bits, last, held = [], [], None, None
        for a, b in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), strict=True):
            if a is not last:
                last, held = a, ex.decode(a)[0]
            other = ex.decode(b)[0]
            shared = np.isin(held, other, assume_unique=True)
            both = int(shared.sum())
            values.append(both / (len(held) + len(other) - both))
            bits.append(ex.packed_bits(shared).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("u"), batch.column("v"), pa.array(values, pa.float64()), pa.array(bits, pa.list_(pa.int64()))], names=["u", "v", "similarity", "shared"]
        )
    tb.give_back()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, the Jaccard similarity of their shingle sets, and a bit for each of u's shingles that v has."""
    rows = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("body").alias("body_a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("body").alias("body_b")), "v")
    return rows.select("u", "v", "body_a", "body_b").mapInArrow(_similarity, "u long, v long, similarity double, shared array<long>")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size; one row for each id."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "near-dup")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    signed = stored(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, words_a long, words_b long, bands array<long>"), "signatures")
    same = ["words_a", "words_b"]
    with_words = signed.filter("n_shingles > 0")
    # The smallest id with these words, and its bands (equal words have equal bands).
    texts = stored(with_words.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "texts")
    buckets = texts.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_other")).filter("centre <> _other").drop("_other")
    members = stored(buckets.join(shared, "bucket"), "members")
    sets = stored(docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, body binary").dropDuplicates(["doc_id", "body"]), "sets")

    def tested(pairs: DataFrame, name: str) -> DataFrame:
        return stored(verified(pairs.distinct(), sets), name)

    def links(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for t in parts[1:]:
            out = out.union(t)
        return out.filter(F.col("similarity") >= threshold).select("u", "v")

    def unsettled(of: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """Members of buckets that hold more than one component, with theirs and the centre's (main)."""
        found = components(edges, f"{folder}/{name}-components").select(F.col("u").alias("doc_id"), F.col("v").alias("_root"))
        rows = stored(of.join(found, "doc_id", "left").withColumn("component", F.coalesce("_root", "doc_id")).drop("_root"), f"{name}-all")
        open_ = rows.groupBy("bucket").agg(
            F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max(F.when(F.col("doc_id") == F.col("centre"), F.col("component"))).alias("main"),
        ).filter("_lo <> _hi").select("bucket", "main")
        return stored(rows.join(open_, "bucket"), name)

    first = tested(members.filter("doc_id <> centre").select(F.col("centre").alias("u"), F.col("doc_id").alias("v")), "first")
    left = unsettled(members, links(first), "left-1")
    drawn = left.filter("component = main").groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("bucket", "doc_id")).alias("u"))
    second = tested(left.filter("component <> main").select("bucket", F.col("doc_id").alias("v")).join(drawn, "bucket").select("u", "v"), "second")
    left = unsettled(left.drop("component", "main"), links(first, second), "left-2")
    of_centre = first.select(F.col("u").alias("centre"), F.col("v").alias("doc_id"), "shared").dropDuplicates(["centre", "doc_id"])
    near = left.join(of_centre, ["centre", "doc_id"], "left").join(_own_shingles(left, sets), "doc_id", "left")
    cross = tested(cross_pairs(near, threshold), "cross")
    # Ids whose rows have different words link them, so their texts share a class.
    by_id = with_words.join(texts.select(*same, "rep"), same).select("doc_id", "rep")
    own = by_id.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    roots = components(links(first, second, cross).union(own), f"{folder}/components-last").select(F.col("u").alias("rep"), F.col("v").alias("_root"))
    classed = by_id.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(roots, "rep", "left").select("doc_id", F.coalesce("_root", "rep").alias("class_id"))
    rows = signed.select("doc_id").distinct().join(classed, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    sizes = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return rows.join(sizes, "class_id").select("doc_id", "class_id", "class_size")


def _own_shingles(left: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, own: how many shingles of a text no other text in `left` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            keys = [ex.decode(b)[0] for b in batch.column("body").to_pylist()]
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))], names=["doc_id", "shingle"])
        tb.give_back()

    rows = sets.join(left.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "body").mapInArrow(run, "doc_id long, shingle long")
    holders = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("_last"))
    return holders.filter("doc_id = _last").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))


def cross_pairs(near: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components in one bucket that may reach the threshold; members of the centre's component don't
    meet each other. `near` has the bits of the centre's shingles that a text shares (null for the centre: all)."""
    size, longest = F.col("n"), F.array_repeat(F.lit(-1).cast("long"), F.ceil(F.col("n") / 64).cast("int"))
    common = F.when(F.col("doc_id") == F.col("centre"), size).otherwise(F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x)))
    rows = near.select(
        "bucket", "doc_id", "n", "component", "main", F.coalesce("shared", longest).alias("shared"),
        F.greatest(size - common - F.coalesce("own", F.lit(0)), F.lit(0)).alias("outside"),
    )
    a = rows.filter("component <> main").select("bucket", *(F.col(c).alias(f"u_{c}") for c in ("doc_id", "n", "component", "shared", "outside")))
    b = rows.select("bucket", *(F.col(c).alias(f"v_{c}") for c in ("doc_id", "n", "component", "shared", "outside")))
    both = F.aggregate(F.zip_with("u_shared", "v_shared", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x, F.lit(0)))
    most = both + F.least("u_outside", "v_outside")
    sizes = F.least("u_n", "v_n") >= threshold * F.greatest("u_n", "v_n") - 1e-6
    may_link = sizes & ((1 + threshold) * most >= threshold * (F.col("u_n") + F.col("v_n")) - 1e-6)
    met = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("u_component") != F.col("v_component")) & may_link)
    return met.select(F.least("u_doc_id", "v_doc_id").alias("u"), F.greatest("u_doc_id", "v_doc_id").alias("v")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE k >= 0.8 * (x.n + y.n - k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c
"""
