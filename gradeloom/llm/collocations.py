"""Phrase collocations: frequent phrases of each language, scored by the joint count against the counts of their parts.

Texts are read once. A block of one language becomes a stream of word numbers (zero between pieces) beside the list of its
distinct words. Words that occur often enough get ids by rank; the stream is turned into ids, and a pair of neighbouring ids
is a cell of a table that is cut into tiles of TILE x TILE. As ids are ranks, the pairs of a block crowd into few tiles:
those are counted by `bincount` over all cells, the others as sorted (cell, count) lists. Distinct cells go by hash to
buckets, which sum them up, rank what is frequent anew and tell each block the ids of its own frequent pairs; these stand
for the first element in the tables of the next length, and so on. A phrase is counted only where both phrases one word shorter
are frequent, as no other can be.

The rank of a word or phrase is taken inside its hash bucket and interleaved over the buckets, so no group holds a whole
language. A bucket's rows are in proportion to a fixed number of words; a pair that stands everywhere is one entry for each block.

Null languages count as `und`, null texts as empty. Rows are taken one by one, so repeated rows and ids are no special case;
other columns are left out, so no name can clash. An empty table gives no rows. A long text is cut between pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir
from . import text_blocks as tb
from .exchange import decode, encode

UNKNOWN = "und"
TILE = 1024
#: A tile is counted cell by cell if it holds at least one pair for so many cells.
DENSE = 16
#: Bits of a word's id in a code; the others are those of the phrase before it.
WORD_BITS = 30
BLOCK_BYTES, BUCKET_WORDS = 16_000_000, 4_000_000
MIN_COUNT, MAX_WORDS, KEEP_PERCENT, TOP = 10, 3, 50, 2000

_ALL = np.arange(256)
#: Bytes that end a piece, `[.,;:!?\x0A-\x0D]`, and bytes of words.
SEPARATOR = np.isin(_ALL, [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
WORD = ~(SEPARATOR | (_ALL == 0x20) | (_ALL == 0x09))

BLOCKS = "block long, lang string, words array<string>, counts array<long>, body binary"
SENT = "lang string, bucket int, block long, body binary"
SIDE = "block long, kind int, body binary"


# --- streams -------------------------------------------------------------------------

def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of four bytes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.int64(len(values)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unsqueezed(body: bytes) -> np.ndarray:
    if not body:
        return np.zeros(0, np.int64)
    n = int(np.frombuffer(body[:8], np.int64)[0])
    planes = np.frombuffer(pa.decompress(body[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def piece_cuts(low: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """`offsets` with further cuts behind the end of a piece in texts of over `limit` bytes; a longer piece stays whole."""
    cuts = [0]
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while end - start > limit:
            stops = np.flatnonzero(SEPARATOR[low[start + limit // 2 : end]][: limit // 2])
            if not len(stops):
                stops = np.flatnonzero(SEPARATOR[low[start + limit // 2 : end]])[:1]
            if not len(stops) or start + limit // 2 + int(stops[-1]) + 1 >= end:
                break
            start += limit // 2 + int(stops[-1]) + 1
            cuts.append(start)
        cuts.append(end)
    return np.array(cuts, np.int64)


def stream_of(low: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of texts in lower case, and the texts as numbers of words (from 1) with zeros between pieces."""
    starts, ends, bounds = tb.word_spans(low, offsets, WORD)
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(low[WORD[low]].tobytes())]).dictionary_encode()
    stops = np.concatenate([[0], np.cumsum(SEPARATOR[low])])
    last = np.zeros(len(starts), bool)
    if len(starts):
        last[:-1] = stops[starts[1:]] > stops[ends[:-1]]
        full = bounds[1:][np.diff(bounds) > 0]
        last[full - 1] = True
    stream = np.zeros(len(starts) + int(last.sum()), np.int64)
    stream[np.arange(len(starts)) + np.cumsum(last) - last] = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return words.dictionary, stream


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        order = np.argsort(langs.indices.to_numpy(zero_copy_only=False), kind="stable")
        codes = langs.indices.to_numpy(zero_copy_only=False)[order]
        texts = batch.column(1).take(pa.array(order))
        runs = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for i, j in zip(runs[:-1], runs[1:], strict=True):
            if i == j:
                continue
            buf, offsets = tb.buffers(texts.slice(i, j - i))
            low = tb.LOWER[buf]
            offsets = piece_cuts(low, offsets, block_bytes)
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block_bytes, "right")) - 1)
                words, stream = stream_of(low[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                a = b
                if not len(words):
                    continue
                counts = np.bincount(stream, minlength=len(words) + 1)[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task + made]), pa.array([langs.dictionary[int(codes[i])].as_py()]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                     pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())), pa.array([_squeezed(stream)], pa.binary())],
                    names=["block", "lang", "words", "counts", "body"],
                )
                made += 1
        tb.give_back()


# --- tiles ---------------------------------------------------------------------------

def distinct(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts (of one each)."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def tile_counts(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row id, column id) of the cells that occur, and how often: full tiles by cells, the rest as a sorted list."""
    down, across = rows // TILE, columns // TILE
    tile, full = (down << WORD_BITS) | across, []
    # A tile with enough pairs to be dense holds a fixed share of all, so there are few of them.
    numbers, sizes = distinct(tile)
    sparse = np.ones(len(rows), bool)
    for number in numbers[sizes * DENSE >= TILE * TILE].tolist():
        inside = tile == number
        cells = np.bincount((rows[inside] % TILE) * TILE + columns[inside] % TILE, minlength=TILE * TILE)
        found = np.flatnonzero(cells)
        r, c = number >> WORD_BITS, number & ((1 << WORD_BITS) - 1)
        full.append((((r * TILE + found // TILE) << WORD_BITS) | (c * TILE + found % TILE), cells[found]))
        sparse &= ~inside
    full.append(distinct((rows[sparse] << WORD_BITS) | columns[sparse]))
    return np.concatenate([f[0] for f in full]), np.concatenate([f[1] for f in full])


def _sequence(stream: np.ndarray, known: bytes) -> np.ndarray:
    """The stream as word ids; -1 between pieces and for rare words."""
    places, ids = (x.view(np.int64) for x in decode(known))
    table = np.full(int(stream.max(initial=0)) + 1, -1, np.int64)
    table[places + 1] = ids
    return table[stream]


def _grown(sequence: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a phrase of `size` + 1 words may be frequent, and its code; `before` has the id of the phrase of `size` words at each place, or -1."""
    at = np.flatnonzero((before[:-1] >= 0) & (before[1:] >= 0)) if len(before) > 1 else np.zeros(0, np.int64)
    at = at[at + size < len(sequence)]
    return at, (before[at] << WORD_BITS) | sequence[at + size]


def _cells(stream: np.ndarray, side: dict[int, list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the phrases of `length` words. side[0]: word ids, side[k]: ids of the block's phrases of k + 1 words; it may have none."""
    if 0 not in side:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sequence = before = _sequence(stream, side[0][0])
    for size in range(1, length - 1):
        at, codes = _grown(sequence, before, size)
        told = [decode(b) for b in side.get(size, ())]
        known, ids = (np.concatenate([np.zeros(0, np.int64), *(t[k].view(np.int64) for t in told)]) for k in (0, 1))
        order = np.argsort(known)
        known, ids = np.append(known[order], -1), np.append(ids[order], -1)
        found = np.searchsorted(known[:-1], codes)
        before = np.full(len(sequence), -1, np.int64)
        before[at] = np.where(known[found] == codes, ids[found], -1)
    _, codes = _grown(sequence, before, length - 1)
    return tile_counts(codes >> WORD_BITS, codes & ((1 << WORD_BITS) - 1))


def _count(length: int, n_buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function over one block and what is known of it: its cells, a row for each bucket."""
    return lambda left, right: _counted(left, right, length, n_buckets)


def _counted(left: pa.Table, right: pa.Table, length: int, n_buckets: int) -> pa.Table:
    rows = []
    for block, lang, body in zip(*(left.column(c).to_pylist() for c in ("block", "lang", "body")), strict=True):
        side: dict[int, list[bytes]] = {}
        for kind, held in zip(right.column("kind").to_pylist(), right.column("body").to_pylist(), strict=True):
            side.setdefault(kind, []).append(held)
        codes, counts = _cells(_unsqueezed(body), side, length)
        bucket = (tb.mixed(codes.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((codes, bucket))
        codes, counts, bucket = codes[order], counts[order], bucket[order]
        bounds = np.searchsorted(bucket, np.arange(n_buckets + 1))
        rows += [(lang, k, block, encode(codes[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]])) for k in np.flatnonzero(np.diff(bounds)).tolist()]
    tb.give_back()
    return _rows(rows, ["lang", "bucket", "block", "body"], [pa.string(), pa.int32(), pa.int64(), pa.binary()])


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _judge(min_count: int, n_buckets: int, asked: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Function over one bucket: frequent cells with sum and id (block null), and for each block the ids of those it holds."""
    return lambda key, table: _judged(key, table, min_count, n_buckets, asked)


def _judged(key: tuple, table: pa.Table, min_count: int, n_buckets: int, asked: bool) -> pa.Table:
    lang, bucket = (k.as_py() for k in key)
    blocks, bodies = table.column("block").to_pylist(), table.column("body").to_pylist()
    codes, counts, n_held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for body in bodies:  # summed up whenever what waits is larger than the sum
        held.append(tuple(x.view(np.int64) for x in decode(body)))
        n_held += len(held[-1][0])
        if n_held > max(len(codes), 1 << 20):
            codes, counts = distinct(np.concatenate([codes, *(h[0] for h in held)]), np.concatenate([counts, *(h[1] for h in held)]))
            held, n_held = [], 0
    codes, counts = distinct(np.concatenate([codes, *(h[0] for h in held)]), np.concatenate([counts, *(h[1] for h in held)]))
    frequent = counts >= min_count
    codes, counts = codes[frequent], counts[frequent]
    ids = np.empty(len(codes), np.int64)
    ids[np.lexsort((codes, -counts))] = np.arange(len(codes)) * n_buckets + bucket
    if len(ids) and int(ids.max()) >> (63 - WORD_BITS):
        raise OverflowError("more frequent phrases than a code can hold")
    rows = [(lang, None, encode(codes, counts, ids))] if len(codes) else []
    for block, body in zip(blocks, bodies, strict=True) if asked and len(codes) else ():
        own = decode(body)[0].view(np.int64)
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        at = at[codes[at] == own]
        if len(at):
            rows.append((lang, block, encode(codes[at], ids[at])))
    tb.give_back()
    return _rows(rows, ["lang", "block", "body"], [pa.string(), pa.int64(), pa.binary()])


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, counts, ids = (x.view(np.int64) for x in decode(body))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes >> WORD_BITS), pa.array(codes & ((1 << WORD_BITS) - 1)), pa.array(counts), pa.array(ids)],
                names=["lang", "before", "word_id", "f", "id"],
            )


def _known(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    places, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("place", "id"))
    return _rows([(table.column("block")[0].as_py(), 0, encode(places, ids))], ["block", "kind", "body"], [pa.int64(), pa.int32(), pa.binary()])


# --- phrases -------------------------------------------------------------------------

def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def phrases(
    docs: DataFrame, folder: str, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, ids, words, f; totals: lang, n) of all phrases of at most `max_words` words that occur `min_count` times."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _written(rows.mapInArrow(lambda it: _blocks(it, block_bytes), BLOCKS), f"{folder}/blocks")
    held = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "lang", "place", "w.words", "w.counts")
    totals = _written(held.groupBy("lang").agg(F.sum("counts").alias("n")), f"{folder}/totals")
    n_buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // bucket_words
    bucket = F.pmod(F.xxhash64("word"), F.lit(n_buckets))
    rank = F.row_number().over(Window.partitionBy("lang", bucket).orderBy(F.desc("f"), "word"))
    words = held.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= min_count)
    words = _written(words.withColumn("id", (rank - 1).cast("long") * n_buckets + bucket), f"{folder}/words")
    if (words.agg(F.max("id")).first()[0] or 0) >> WORD_BITS:
        raise OverflowError("more frequent words than a code can hold")
    ids = held.withColumnRenamed("words", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "place", "id")
    side = _written(ids.groupBy("block").applyInArrow(_known, SIDE), f"{folder}/side1")
    level = words.select("lang", "id", F.array("id").alias("ids"), F.array("word").alias("words"), "f")
    found = level
    streams = blocks.select("block", "lang", "body")
    for size in range(2, max_words + 1):
        asked = size < max_words
        sent = streams.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(_count(size, n_buckets), SENT)
        judged = sent.groupBy("lang", "bucket").applyInArrow(_judge(min_count, n_buckets, asked), "lang string, block long, body binary")
        judged = _written(judged, f"{folder}/judged{size}")
        table = judged.filter("block IS NULL").select("lang", "body").mapInArrow(_table_rows, "lang string, before long, word_id long, f long, id long")
        before = level.select("lang", F.col("id").alias("before"), F.col("ids").alias("ids0"), F.col("words").alias("words0"))
        last = words.select("lang", F.col("id").alias("word_id"), "word")
        level = _written(
            table.join(before, ["lang", "before"]).join(last, ["lang", "word_id"])
            .select("lang", "id", F.concat("ids0", F.array("word_id")).alias("ids"), F.concat("words0", F.array("word")).alias("words"), "f"),
            f"{folder}/phrases{size}",
        )
        found = found.union(level)
        if asked:
            answers = judged.filter("block IS NOT NULL").select("block", F.lit(size - 1).alias("kind"), "body")
            side = side.union(answers)
    return found, totals


def pair_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    wide = "decimal(15,0)"
    product = F.lit(1000000).cast("decimal(7,0)") * a.cast(wide) * a.cast(wide)
    return F.floor(F.call_function("div", product, left.cast(wide) * right.cast(wide))).cast("long")


def collocations(found: DataFrame, totals: DataFrame, keep_percent: int = KEEP_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language, from the counts of `phrases`.

    A phrase is cut where its parts explain it best (the lowest score; ties to the first cut), and left out if a longer one holds
    it in at least `keep_percent` of its occurrences.
    """
    size = F.size("ids")
    candidates = found.filter(size > 1).select("lang", "ids", "words", F.col("f").alias("a"))
    counts = found.select("lang", "ids", "f")
    cuts = candidates.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("ids").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = cuts.withColumn("score", pair_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.filter(size > 2).select("lang", F.col("a").alias("longer"), "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("lang", "longer", "ids", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", "longer", F.slice("ids", F.col("at"), F.col("m")).alias("ids")).groupBy("lang", "ids").agg(F.max("longer").alias("longer"))
    own = candidates.join(inner, ["lang", "ids"], "left").filter(F.coalesce(100 * F.col("longer") < keep_percent * F.col("a"), F.lit(True)))
    rows = own.join(best, ["lang", "ids"]).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return collocations(*phrases(docs, shared_dir(spark, "collocations")))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS txt
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(txt, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM cuts),
inner_phrases AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE m = 3)) GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE b.cut = 1 AND NOT coalesce(100 * x.longer >= 50 * b.a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
"""
