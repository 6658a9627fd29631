"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are lexicon densities (a fixed list, and words and word beginnings learned from labelled
rows by their log odds), nearness of lexicon words to the second person, capitals, punctuation,
repeated letters and obfuscation (letters replaced by look-alikes). The lexicon is learned from one
part of the labelled rows, the trees from another with that lexicon, the calibration from a third, so
none sees its own rows; texts are then scored with the lexicon of all labelled rows.

At most `MAX_LABELLED` labelled rows are learned from: those with the smallest hash of their id. Their
ids are broadcast, and a few numbers of each come to the driver for the fit. Scoring is one pass over
the documents without a shuffle. Rows without label or id are not learned from.

A null text is empty; an empty text has zero in every feature and gets the score of that point. Rows
are scored one by one, so repeated rows and ids are no special case (of several labels of an id the
largest counts). An empty table gives no rows. With labels of one kind only, every score is that
share. Other columns are left out, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.session import shared_dir

from . import text_blocks as tb

MAX_LABELLED = 20_000
#: Most entries of the learned lexicon; least texts that an entry needs; least log odds.
MAX_ENTRIES, MIN_TEXTS, MIN_ODDS = 2_000, 3, 2.5
PREFIXES = (4, 5, 6)
NEAR_WORDS = 5
THRESHOLD = 0.7

INSULTS = """idiot idiots stupid moron morons loser losers pathetic worthless disgusting scum trash clown clowns dumb fool fools jerk
garbage filth filthy vermin coward liar ugly hate shut crap damn hell bastard bitch asshole fuck fucking shit kill die""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi vous votre tus usted ustedes vosotros eres".split()
_LOOKALIKE = np.arange(256, dtype=np.uint8)
for _from, _to in zip("013457@$!", "oieastasi", strict=True):
    _LOOKALIKE[ord(_from)] = ord(_to)
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0x80, 0x100)])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DISGUISE = np.isin(np.arange(256), [ord(c) for c in "0134578@$*!"])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?-\"'()"])

FEATURES = [
    "insult_density", "insult_count", "learned_max", "learned_count", "learned_density", "learned_sum", "second_person_near", "second_person", "upper_letters",
    "upper_words", "exclamations", "questions", "marks", "disguised_words", "disguised_insults", "long_runs", "log_words",
]


def _hash_words(words: list[str]) -> np.ndarray:
    buf, offsets = tb.buffers(pa.array(words))
    return np.sort(tb.span_hash(tb.byte_sums(buf), offsets[:-1], offsets[1:]))


_INSULTS, _SECOND = _hash_words(INSULTS), _hash_words(SECOND_PERSON)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in sorted `known`, -1 where absent."""
    if not len(known) or not len(keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _terms(buf: np.ndarray, offsets: np.ndarray):
    """Of lower-cased text: word spans, word hashes, and keys of each word and its beginnings (0 where it is no longer than that)."""
    starts, ends, bounds = tb.word_spans(buf, offsets, tb.ALNUM_WORD)
    sums = tb.byte_sums(buf)
    hashes = tb.span_hash(sums, starts, ends)
    point = (buf & 0xC0) != 0x80
    places = np.append(np.flatnonzero(point), [len(buf)] * (max(PREFIXES) + 1))
    rank = np.concatenate([[0], np.cumsum(point)])[starts]
    keys = [tb.mixed(hashes)]
    for k in PREFIXES:
        upto = places[rank + k]
        keys.append(np.where(upto < ends, tb.mixed(tb.span_hash(sums, starts, np.minimum(upto, ends)) + np.uint64(k)), np.uint64(0)))
    return starts, ends, bounds, hashes, keys


@dataclass
class Lexicon:
    keys: np.ndarray
    weights: np.ndarray


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    parts = []
    raw, offsets_raw = tb.buffers(column)
    low, offsets_low = tb.buffers(pc.utf8_lower(column))
    for i, j, b, o in tb.chunks(low, offsets_low):
        starts, ends, bounds, hashes, keys = _terms(b, o)
        n = np.maximum(np.diff(bounds), 1)
        doc = lambda x, at=bounds: np.add.reduceat(np.append(x, 0.0), at[:-1]) * (np.diff(at) > 0)
        insult = _among(hashes, _INSULTS) >= 0
        weight = np.zeros(len(hashes))
        for k in keys:
            at = _among(k, lexicon.keys)
            if len(lexicon.keys):
                weight = np.maximum(weight, np.where(at >= 0, lexicon.weights[at], 0))
        hit = insult | (weight > 0)
        second = _among(hashes, _SECOND) >= 0
        own = tb.owners(bounds)
        reach = np.concatenate([[0], np.cumsum(second)])
        places = np.arange(len(hashes))
        near = hit & (reach[np.minimum(places + NEAR_WORDS + 1, bounds[1:][own])] > reach[np.maximum(places - NEAR_WORDS, bounds[:-1][own])])
        top = np.maximum.reduceat(np.append(weight, 0.0), bounds[:-1]) * (np.diff(bounds) > 0)
        look = _LOOKALIKE[b]
        s2, e2, b2 = tb.word_spans(look, o, tb.ALNUM_WORD)
        disguised = _among(tb.span_hash(tb.byte_sums(look), s2, e2), _INSULTS) >= 0
        r = raw[offsets_raw[i] : offsets_raw[j]]
        ro = offsets_raw[i : j + 1] - offsets_raw[i]
        ws, we, wb = tb.word_spans(r, ro, tb.PLAIN_WORD)
        count = lambda lut: np.concatenate([[0], np.cumsum(lut[r])])
        letters, upper, odd = count(_LETTER), count(_UPPER), count(_DISGUISE)
        word_letters = letters[we] - letters[ws]
        shouted = (word_letters > 1) & (upper[we] - upper[ws] == word_letters)
        inner = np.maximum(we - 1, ws + 1)
        mixed_word = (odd[inner] - odd[ws + 1] > 0) & (word_letters > 1)
        same = np.zeros(len(r), bool)
        same[2:] = (r[2:] == r[1:-1]) & (r[1:-1] == r[:-2]) & _LETTER[r[2:]]
        chars = np.maximum(np.diff(ro), 1)
        of = lambda lut: tb.per_document(lut[r], ro)
        insults, learned = doc(insult), doc(weight > 0)
        parts.append(np.stack([
            insults / n, np.log1p(insults), top, np.log1p(learned), learned / n, np.log1p(doc(weight)), doc(near) / n, doc(second) / n,
            of(_UPPER) / np.maximum(of(_LETTER), 1), tb.per_document(shouted, wb) / np.maximum(np.diff(wb), 1), of(np.arange(256) == 33) / n,
            of(np.arange(256) == 63) / n, of(_MARK) / n, tb.per_document(mixed_word, wb) / np.maximum(np.diff(wb), 1),
            np.maximum(tb.per_document(disguised, b2) - insults, 0) / n, tb.per_document(same, ro) / chars, np.log1p(np.diff(bounds)),
        ], 1))
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a term, added up in the batch: key, toxic, clean. Columns: text, label."""
    for batch in batches:
        low, offsets = tb.buffers(pc.utf8_lower(batch.column(0)))
        toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
        for i, j, b, o in tb.chunks(low, offsets):
            _, _, bounds, _, keys = _terms(b, o)
            own = np.tile(tb.owners(bounds), len(keys))
            keys = np.concatenate(keys)
            order = np.lexsort([own, keys])
            keys, own = keys[order], own[order]
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]) if len(keys) else np.zeros(0, bool)
            keys, is_toxic = keys[first], toxic[i:j][own[first]]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            a = np.add.reduceat(is_toxic.astype(np.int64), start) if len(start) else start
            yield pa.RecordBatch.from_arrays([pa.array(keys[start].view(np.int64)), pa.array(a), pa.array(np.diff(np.append(start, len(keys))) - a)], names=["key", "toxic", "clean"])


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries of the largest weight; `rows` has text and label. At most MAX_ENTRIES come to the driver."""
    sizes = rows.groupBy((F.col("label") > 0).alias("toxic")).count().collect()
    n = {bool(r["toxic"]): r["count"] for r in sizes}
    counts = rows.select("text", "label").mapInArrow(_term_counts, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n.get(True, 0) + 1)) - F.log((F.col("b") + 0.5) / (n.get(False, 0) + 1))
    best = (
        counts.filter((F.col("key") != 0) & (F.col("a") >= MIN_TEXTS)).withColumn("w", odds).filter(F.col("w") >= MIN_ODDS)
        .orderBy((F.col("a") * F.col("w")).desc(), "key").limit(MAX_ENTRIES).select("key", "w").toPandas()
    )
    keys = best["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], best["w"].to_numpy()[order].astype(float))


@dataclass
class Boosted:
    """Trees as (feature, threshold, left value or child, right ...) in arrays; every tree is a full one of `depth`."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.clip(np.interp(m, *self.knots), 0, 1) if len(self.knots[0]) else 1 / (1 + np.exp(-m))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, least: int = 4, ridge: float = 1.0) -> Boosted:
    """Logistic boosting with second-order gains over at most 64 thresholds of each feature."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start, nodes = float(np.log(share / (1 - share))), 2**depth - 1
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])) if len(v) else np.zeros(0) for v in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    margin, made = np.full(len(x), start), ([], [], [])
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, feature, threshold = np.zeros(len(x), np.int64), np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for k in range(nodes):
            inside = np.flatnonzero(node == k)
            best = 1e-6
            if len(inside) >= 2 * least:
                total_g, total_h = g[inside].sum(), h[inside].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[inside, f]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[inside], h[inside], None))
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    gain[(left_n < least) | (len(inside) - left_n < least)] = 0
                    q = int(np.argmax(gain))
                    if gain[q] > best:
                        best, feature[k], threshold[k] = gain[q], f, c[q]
            right = x[inside, feature[k]] > threshold[k]
            node[inside] = 2 * k + 1 + right
        at = node - nodes
        leaf = rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + ridge)
        margin += leaf[at]
        for part, value in zip(made, (feature, threshold, leaf), strict=True):
            part.append(value)
    shape = lambda a, w: np.array(a).reshape(-1, w)
    return Boosted(start, depth, shape(made[0], nodes).astype(np.int64), shape(made[1], nodes), shape(made[2], nodes + 1))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to the labels (pooled neighbours), joined by lines."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # label sum, size, margin sum
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(c) for c in x.T)], names=["label", "part", *FEATURES])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> tuple[Boosted, Lexicon]:
    """Calibrated trees and the lexicon to use with them. They learn from at most `max_labelled` ids, those with the smallest
    hash: of several labels of an id the largest counts, of several texts the one with the smallest hash."""
    chosen = (
        labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")).dropna()
        .select("_id", "label", F.xxhash64(F.col("_id").cast("string")).alias("_order")).orderBy("_order", "_id").limit(max_labelled)
        .withColumn("part", F.pmod(F.shiftrightunsigned("_order", 7), F.lit(10)).cast("int")).drop("_order")
    )
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    # One text per id, so that what reaches the driver is bounded; written once, as it is read five times.
    folder = shared_dir(docs.sparkSession, "labelled-texts")
    found.groupBy("_id", "label", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label", "part").write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    # Half for the lexicon, 3 tenths for the trees, 2 for the calibration.
    half = learn_lexicon(rows.filter("part < 5"))
    fields = ", ".join(f"{f} double" for f in FEATURES)
    table = rows.filter("part >= 5").select("text", "label", "part").mapInArrow(_featured(half), f"label int, part int, {fields}").toPandas()
    table = table.sort_values(["part", "label", *FEATURES], kind="stable")
    x, y, fit = table[FEATURES].to_numpy(float), (table["label"] > 0).to_numpy(float), (table["part"] < 8).to_numpy()
    model = boost(x[fit], y[fit])
    held = ~fit if 5 <= y[~fit].sum() <= (~fit).sum() - 5 else np.ones(len(fit), bool)
    if len(y) and 0 < y.sum() < len(y):
        model.knots = isotonic(model.margin(x[held]), y[held])
    return model, learn_lexicon(rows)


def _scored(model: Boosted, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1), lexicon)))], names=["doc_id", "score"])
            tb.give_back()

    return run


def scores(docs: DataFrame, model: Boosted, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scored(model, lexicon), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 1)
    rows = scores(docs, *learn(docs, labels))
    return rows.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
