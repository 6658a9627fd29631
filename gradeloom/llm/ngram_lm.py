"""Language-model scores from an Elias-Fano n-gram trie that is spread over the cluster.

Tokens are words of the lower-cased text and one end. The model has n-grams up to `order` tokens, level by
level. Each block of documents sends its distinct words, with their counts in training documents, to buckets (see
`exchange`) by their hash, and gets back their places there: bucket and place are a word's number. An n-gram is the
number of its context, which is the n-gram before its last token, and the number of that token; blocks send the
distinct ones of a level to buckets by the hash of both numbers, so a frequent context is spread over all buckets. A
bucket adds the counts and builds its part of the trie: contexts, monotone pointers to their successors and one byte
for each count, memory-mapped. It looks up the n-grams of all blocks by successor search inside the context and
sends back bytes and, below the highest level, places, the numbers of contexts for the next level. Last, every
bucket tells those of the level below how many successors it has of each context; those add them and answer the
blocks, which sum the log probabilities of their documents. No part of the model is gathered or broadcast.

Smoothing is interpolated absolute discounting: p(w | v) = max(c(vw) - D, 0) / c(v) + D t(v) / c(v) p(w | v'), where
v' is the context without its first token, p(w) = (c(w) + 1) / (N + V + 1), t(v) the distinct successors of v, and
D = n1 / (n1 + 2 n2) of all n-grams of that level. A context reaches back to the beginning of the text at most. An
unseen context leaves p(w | v'). Contexts of one word have exact c(v), all have exact t(v), and words exact c(w) (words are
told apart by 64-bit hashes, n-grams by numbers). A byte holds c(vw) exactly up to EXACT, or up to 255 if the
bucket has no larger one; above, it divides the logarithms up to the bucket's largest count.

A null text is empty: one end. A null id counts as the empty text for the fold. Rows are taken one by
one, so repeated rows and ids are no special case. A table that isn't read from files must be
checkpointed first. An empty table gives no rows. Other columns are left out; no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.session import shared_dir

from . import exchange as ex, text_blocks as tb
from .elias_fano import NgramTrie

#: Counts up to here have a code each in every bucket.
EXACT = 47
#: Texts are packed anew for each level, so lightly.
TEXT_LEVEL = 3
#: Order of the query.
ORDER = 3
_END, _BEGIN = np.uint64(0xE703_7ED1_A0B4_28DB), np.uint64(0x8EBC_6AF0_9C88_C6E3)
#: Rows between the steps: answers to n-grams and words, successors of contexts.
ANSWER, SUCCESSORS = 0, 2
STEP_ROWS = "block long, bucket int, body binary, once long, twice long, kind int"
WORD_ROWS, ANSWERS = "block long, bucket int, body binary, distinct long, total long", "block long, bucket int, body binary"


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them, by one pass over all and a sort of the distinct ones."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[coded.indices.to_numpy()]


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and where each of them stood, equal ones as they came. Plain numbers sort several times faster than their places do, so keys and places share a number if they fit."""
    shift = np.uint64(len(keys).bit_length())
    if len(keys) and int(keys.max()).bit_length() + int(shift) > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys << shift
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    stood = (both & ((np.uint64(1) << shift) - np.uint64(1))).view(np.int64)
    both >>= shift
    return both, stood


def _first(ranked: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before."""
    return np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)


def _grouped(ranked: np.ndarray, stood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of the sorted values, and the place among them of what stood where."""
    first, at = _first(ranked), np.empty(len(ranked), np.int64)
    at[stood] = np.cumsum(first) - 1
    return ranked[first], at


def _distinct_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of numbers made of a bucket and a place below it."""
    low = np.uint64(int((values & np.uint64(0xFFFFFFFF)).max(initial=0)).bit_length())
    if len(values) and (int(values.max()) >> 32).bit_length() + int(low) + len(values).bit_length() > 64:
        return _distinct(values)
    found, at = _grouped(*_ordered(values >> np.uint64(32) << low | values & np.uint64(0xFFFFFFFF)))
    return found >> low << np.uint64(32) | found & ((np.uint64(1) << low) - np.uint64(1)), at


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes (a beginning, and an end after each document), each token's place among them, that of the token before it, and the tokens before each document."""
    buf, parts, bounds, before = tb.LOWER[buf], [], [np.zeros(1, np.int64)], 0
    for _, _, b, o in tb.chunks(buf, offsets):
        starts, ends, own = tb.word_spans(b, o, tb.PLAIN_WORD)
        parts.append(tb.span_hash(tb.byte_sums(b), starts, ends))
        bounds.append(own[1:] + before)
        before += len(starts)
    words, bounds = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(bounds)
    n = len(bounds) - 1
    tokens = np.empty(len(words) + n + 1, np.uint64)
    tokens[np.arange(len(words)) + tb.owners(bounds)] = words
    bounds = bounds + np.arange(n + 1)
    tokens[bounds[1:] - 1], tokens[-1] = _END, _BEGIN
    del parts, words
    words, place = _distinct(tokens)
    previous = np.empty_like(place[:-1])
    previous[1:] = place[:-2]
    previous[bounds[:-1]] = place[-1]
    return words, place[:-1], previous, bounds


def _weight(batch: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
    """Whether each token counts: those of training documents do."""
    return np.repeat(~batch.column(2).to_numpy(zero_copy_only=False), np.diff(bounds))


def _pairs(words: np.ndarray, place: np.ndarray, previous: np.ndarray, n_buckets: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (words, or named by `before`) and successors of the distinct pairs, by bucket and then by name; bounds of the buckets; the pair of each token."""
    before = words if before is None else before
    shift = np.uint64(len(words).bit_length())
    keys = previous.astype(np.uint64)
    keys <<= shift
    keys |= place.astype(np.uint64)
    both, at = _grouped(*_ordered(keys))
    del keys
    contexts, successors = before[(both >> shift).astype(np.int64)], words[(both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)]
    bucket, order = _ordered((tb.mixed(contexts ^ tb.mixed(successors)) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return contexts[order], successors[order], np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64)), rank[at]


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(_first(ranked))
    return ranked[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)


def _own_words(batch, buf, offsets):
    words, place, _, bounds = _tokens(buf, offsets)
    return words, np.bincount(place, _weight(batch, bounds), len(words)).astype(np.int64)


def _words(table: pa.Table) -> pa.Table:
    """For each block, the places (from 1) of its words in the bucket, and their exact counts."""
    table = table.combine_chunks()
    sent = [ex.decode(b) for b in table.column("body").to_pylist()]
    words, counts = _counted(np.concatenate([s[0] for s in sent]), np.concatenate([s[1] for s in sent]).astype(np.int64))
    places = [np.searchsorted(words, s[0]) for s in sent]
    rest = [0] * (len(sent) - 1)
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"), "body": pa.array([ex.encode(at + 1, counts[at]) for at in places], pa.binary()),
        "distinct": pa.array([int((counts > 0).sum())] + rest), "total": pa.array([int(counts.sum())] + rest),
    })


def _gathered(answers: dict[int, list[np.ndarray]], first: int, cuts: np.ndarray, array: int) -> np.ndarray:
    """An array of the answers of the buckets from `first` on, for a block's words or n-grams in their order."""
    out = np.zeros(int(cuts[-1]), np.int64)
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), first):
        if k in answers:
            out[lo:hi] = answers[k][array][: hi - lo]
    return out


def _levels(tokens, answers: dict[int, list[np.ndarray]], n_buckets: int, order: int):
    """For each level from 2 on: the tokens that end an n-gram, the place of its context among those of the level below, and `_pairs` of them."""
    words, place, previous, bounds = tokens
    number = lambda cuts, places: (tb.owners(cuts).astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64)
    cuts = ex.cut(words, n_buckets)
    names = before = number(cuts, _gathered(answers, 0, cuts, 0))
    on, context = np.arange(len(place)), previous
    for level in range(2, order + 1):
        contexts, successors, cuts, at = _pairs(names, place[on], context, n_buckets, before)
        yield on, context, contexts, successors, cuts, at
        if level == order:
            return
        del contexts, successors
        places = _gathered(answers, (level - 1) * n_buckets, cuts, 2)
        before = number(cuts, places)
        # What ends at a token is the context of the next one in its document, if training has seen it.
        ended = np.full(len(place) + 1, -1)
        ended[on + 1] = at
        ended[bounds] = -1
        on = np.flatnonzero(ended >= 0)
        on = on[places[ended[on]] > 0]
        context = ended[on]
        del at, ended, places


def _send(n_buckets: int, level: int):
    def run(batch, buf, offsets, answers):
        tokens = _tokens(buf, offsets)
        levels = _levels(tokens, answers, n_buckets, level)
        for _ in range(2, level):
            next(levels)
        on, _, contexts, successors, cuts, at = next(levels)
        counts = np.bincount(at, _weight(batch, tokens[3])[on], len(contexts)).astype(np.int64)
        full = np.flatnonzero(np.diff(cuts))
        bodies = [ex.encode(*(a[cuts[k] : cuts[k + 1]] for a in (contexts, successors, counts))) for k in full]
        block = np.full(len(full), ex.block_number(batch.column(0), offsets, buf))
        return pa.table({"bucket": pa.array((full + (level - 1) * n_buckets).astype(np.int32)), "block": pa.array(block), "body": pa.array(bodies, pa.binary())})

    return run


def _codes(counts: np.ndarray, top: int) -> np.ndarray:
    """Bytes for counts from 1 to `top`, the largest of the bucket."""
    if top <= 255:
        return counts.astype(np.uint8)
    above = EXACT + np.rint(np.log(counts / EXACT) / np.log(top / EXACT) * (255 - EXACT))
    return np.where(counts <= EXACT, counts, above).astype(np.uint8)


def _counts(codes: np.ndarray, top: int) -> np.ndarray:
    codes = codes.astype(np.float64)
    return codes if top <= 255 else np.where(codes <= EXACT, codes, EXACT * (top / EXACT) ** ((codes - EXACT) / (255 - EXACT)))


def _rows(kind: int, blocks, buckets, bodies, once: int = 0, twice: int = 0) -> pa.Table:
    n = len(bodies)
    first = lambda x: pa.array(([x] + [0] * (n - 1))[:n], pa.int64())
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "body": pa.array(bodies, pa.binary()), "once": first(once), "twice": first(twice),
        "kind": pa.array(np.full(n, kind), pa.int32()),
    })


def _bucket(n_buckets: int, order: int = 2):
    """Answers to a bucket's n-grams, and the successors of its contexts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket, blocks = int(table.column("bucket")[0].as_py()), table.column("block").to_numpy()
        level, sent = bucket // n_buckets + 1, [ex.decode(b) for b in table.column("body").to_pylist()]
        sizes = [len(s[0]) for s in sent]
        names, contexts = _distinct_numbers(np.concatenate([s[0] for s in sent]))
        _, successors = _distinct_numbers(np.concatenate([s[1] for s in sent]))
        keys, which = _grouped(*_ordered(contexts.astype(np.uint64) << np.uint64(32) | successors.astype(np.uint64)))
        del contexts, successors
        # Sums of integers, exact below 2^53.
        counts = np.bincount(which, np.concatenate([s[2] for s in sent]).astype(np.float64), len(keys)).astype(np.int64)
        del sent
        distinct, counts = keys[counts > 0], counts[counts > 0]
        top = int(counts.max(initial=0))
        held, kinds = np.unique((distinct >> np.uint64(32)).astype(np.int64), return_counts=True)
        trie = NgramTrie(distinct, _codes(counts, top), np.zeros(len(held), np.uint8)).mapped()
        _, k = trie.find(keys)  # each n-gram once, whichever blocks have it
        codes = (np.where(k >= 0, trie.values[k], 0) if len(trie.values) else np.zeros(len(k))).astype(np.int64)
        back = []
        for mine in np.split(which, np.cumsum(sizes)[:-1]):
            places = [np.append(k[mine] + 1, 0)] if level < order else []
            back.append(ex.encode(np.arange(len(mine) + 1), np.append(codes[mine], top), *places))
        held = names[held]
        cuts = np.searchsorted(held >> np.uint64(32), np.arange(n_buckets + 1).astype(np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        parts = [ex.encode(held[cuts[k] : cuts[k + 1]] & np.uint64(0xFFFFFFFF), kinds[cuts[k] : cuts[k + 1]]) for k in full]
        tb.give_back()
        return pa.concat_tables([
            _rows(ANSWER, blocks, np.full(len(blocks), bucket), back, int((counts == 1).sum()), int((counts == 2).sum())),
            _rows(SUCCESSORS, np.zeros(len(full), np.int64), full + (level - 2) * n_buckets, parts),
        ])

    return run


def _after(n_buckets: int, order: int):
    """Distinct successors of a bucket's words or n-grams, for each block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kinds, sent = table.column("kind").to_numpy(), [ex.decode(b) for b in table.column("body").to_pylist()]
        asked, bucket = np.flatnonzero(kinds == ANSWER), int(table.column("bucket")[0].as_py())
        places = [(sent[k][0] if bucket < n_buckets else sent[k][2][:-1]).astype(np.int64) for k in asked]
        after = np.zeros(1 + max(int(p.max(initial=0)) for p in places), np.int64)
        for k in np.flatnonzero(kinds == SUCCESSORS):
            after[sent[k][0].astype(np.int64)] += sent[k][1].astype(np.int64)
        back = [ex.encode(np.arange(len(p)), after[p]) for p in places]
        return pa.table({
            "block": pa.array(table.column("block").to_numpy()[asked]), "bucket": pa.array(np.full(len(asked), bucket + order * n_buckets, np.int32)), "body": pa.array(back, pa.binary()),
        })

    return run


def _score(n_buckets: int, order: int, total: int, vocabulary: int, discounts: list[float]):
    def run(batch, buf, offsets, answers):
        tokens = _tokens(buf, offsets)
        words, place, _, bounds = tokens
        cuts = ex.cut(words, n_buckets)
        counts, after = _gathered(answers, 0, cuts, 1), _gathered(answers, order * n_buckets, cuts, 1)
        plain = ((counts + 1) / (total + vocabulary + 1))[place]
        known = (counts > 0)[place]
        # A beginning stands before as many tokens as there are ends.
        counts[np.searchsorted(words, _BEGIN)] = counts[np.searchsorted(words, _END)]
        n = len(bounds) - 1
        per_text = lambda p: np.bincount(tb.owners(bounds), np.log10(p), n)
        base, by_order, p = per_text(plain), np.empty((n, order - 1)), plain
        levels = _levels(tokens, answers, n_buckets, order)
        for level in range(2, order + 1):
            on, context, contexts, _, cuts, at = next(levels)
            seen, discount = np.zeros(len(contexts)), discounts[level - 2]
            for k in range(n_buckets):
                if k + (level - 1) * n_buckets in answers:
                    codes = answers[k + (level - 1) * n_buckets][1]
                    seen[cuts[k] : cuts[k + 1]] = _counts(codes[:-1], int(codes[-1]))
            c, t, below = counts[context], after[context], p[on]
            own = np.maximum(np.minimum(seen[at], c - t + 1) - discount, 0)  # a count leaves one for each other successor
            own += discount * t * below
            own /= np.maximum(c, 1)
            p[on] = np.where(c > 0, own, below)
            by_order[:, level - 2] = per_text(p)
            if level < order:
                after = _gathered(answers, (order + level - 1) * n_buckets, cuts, 1)
                counts = np.maximum(seen, after)
            del on, context, contexts, _, at, seen, c, t, below, own
        return pa.table({
            "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(tb.per_document(known, bounds)),
            "base_score": pa.array(base), "score": pa.array(by_order[:, -1]),
            "by_order": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (order - 1), by_order.reshape(-1)),
        })

    return run


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, by_order (the scores of orders 2 to `order`; `score` is the last), train_tokens. The model learns n-grams up to `order` tokens from rows where `held_out` is false."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n, folder = ex.bucket_count(docs, "text"), shared_dir(spark, "ngram-answers")
    ex.send(docs, _own_words, n).repartition(n, "bucket").groupBy("bucket").applyInArrow(_words, WORD_ROWS).write.parquet(f"{folder}/words")
    words = spark.read.schema(WORD_ROWS).parquet(f"{folder}/words")
    vocabulary, total = (x or 0 for x in words.agg(F.sum("distinct"), F.sum("total")).first())
    answers, discounts = words.select("block", "bucket", "body"), []
    named = answers.withColumn("kind", F.lit(ANSWER))
    for level in range(2, order + 1):
        sent = ex.matched(docs, answers, _send(n, level), ex.SENT, level=TEXT_LEVEL).repartition(n, "bucket")
        sent.groupBy("bucket").applyInArrow(_bucket(n, order), STEP_ROWS).write.partitionBy("kind").parquet(f"{folder}/level-{level}")
        made = spark.read.schema(STEP_ROWS).parquet(f"{folder}/level-{level}")
        once, twice = (x or 0 for x in made.agg(F.sum("once"), F.sum("twice")).first())
        discounts.append(min(0.95, once / (once + 2 * twice)) if once else 0.5)
        made = made.select("block", "bucket", "body", "kind")
        named = named.union(made if level < order else made.filter(F.col("kind") == SUCCESSORS))
        answers = answers.union(made.filter(F.col("kind") == ANSWER).drop("kind"))
    after = named.repartition(n, "bucket").groupBy("bucket").applyInArrow(_after(n, order), ANSWERS)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, by_order array<double>"
    rows = ex.matched(docs, answers.union(after), _score(n, order, total, vocabulary, discounts), schema, level=TEXT_LEVEL)
    return rows.withColumn("train_tokens", F.lit(total).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the model of order 3: `score` by its word pairs, `score_3` by all of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2, order=ORDER)
    pairs = F.col("by_order")[0].alias("score")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", pairs, "train_tokens", F.col("score").alias(f"score_{ORDER}"))
