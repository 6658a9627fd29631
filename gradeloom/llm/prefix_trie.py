"""Prefix trie of conversations: every distinct beginning is a node, with totals over its subtree.

A node is known by its depth and a 128-bit key, the XOR of hashes of (place, role, text) of its turns, so keys of all
beginnings are running XORs; texts are hashed where they are read and never shuffled. Nodes come from one
aggregation over all beginnings.

Totals over subtrees take neither a round for each depth nor a row for each pair of node and ancestor. Depths are cut
into bands of fixed height. A node is exploded to its ancestors inside its band only. The roots of the bands form a
trie of their own, less deep by the height of a band, whose totals are found the same way; the completed total of a band root then goes
to the ancestors in the band above. So a node is exploded at most twice a level, to at most `band` ancestors, and the
number of levels is the logarithm of the greatest depth.

Turns stand in the order of `turn`, null first; turns that share it are ordered by the MD5 of role, then of text, and
equal turns change places without effect. A null role or text is empty. Rows without conversation id are left out. An
empty table gives the root alone, with no members and a null conv_id. Other columns are left out, so no name can clash.
A conversation of any length is cut into ranges of turns; ids of equal conversations are hashed as a stream of sorted chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir
from . import text_blocks as tb

BAND = 16
#: Rows of one conversation that one window covers at most.
RANGE = 1024
#: Ids of equal conversations in one chunk of text.
CHUNK_IDS = 8192
KEY = ["depth", "k1", "k2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _written(frame: DataFrame, folder: str, name: str) -> DataFrame:
    frame.write.parquet(f"{folder}/{name}")
    return frame.sparkSession.read.parquet(f"{folder}/{name}")


def numbered_turns(
    turns: DataFrame, folder: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv, at (from 1), digest (of role and text), size (bytes of the text). A conversation may span many partitions."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.concat(F.md5(role), F.md5(text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    ).filter("conv IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "size", F.monotonically_increasing_id().alias("seq"))
    ranged = _written(ranged, folder, "ranged").withColumn("part", F.shiftright("seq", 33))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    return ranged.join(starts, ["conv", "part"]).select("conv", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("at"), "digest", "size")


def _xors_before(rows: DataFrame, at: str, longest: int, width: int) -> DataFrame:
    """`rows` with b1, b2: XORs of e1, e2 of the rows before, in each conv. Ranges of `width` rows are summed up, and the sums again."""
    if longest <= width:
        before = Window.partitionBy("conv").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"b{k}": F.coalesce(F.bit_xor(f"e{k}").over(before), F.lit(0)) for k in (1, 2)})
    wide = f"{at}_range"
    rows = rows.withColumn(wide, F.floor((F.col(at) - 1) / width) + 1)
    sums = rows.groupBy("conv", wide).agg(*(F.bit_xor(f"e{k}").alias(f"e{k}") for k in (1, 2)))
    sums = _xors_before(sums, wide, -(-longest // width), RANGE).select("conv", wide, F.col("b1").alias("s1"), F.col("b2").alias("s2"))
    inside = Window.partitionBy("conv", wide).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"b{k}": F.coalesce(F.bit_xor(f"e{k}").over(inside), F.lit(0)) for k in (1, 2)})
    joined = local.join(sums.filter(F.col(wide) > 1), ["conv", wide], "left")
    return joined.withColumns({f"b{k}": F.col(f"b{k}").bitwiseXOR(F.coalesce(F.col(f"s{k}"), F.lit(0))) for k in (1, 2)}).drop(wide, "s1", "s2")


def beginnings(turns: DataFrame, longest: int, band: int) -> DataFrame:
    """conv, depth, k1, k2, p1, p2 (key of the parent), size: a row for each beginning of each conversation."""
    keyed = turns.withColumns({f"e{k}": F.xxhash64(F.lit(k), "at", "digest") for k in (1, 2)}).drop("digest")
    keyed = _xors_before(keyed, "at", longest, band)
    return keyed.select("conv", F.col("at").alias("depth"), *(F.col(f"b{k}").bitwiseXOR(F.col(f"e{k}")).alias(f"k{k}") for k in (1, 2)),
                        F.col("b1").alias("p1"), F.col("b2").alias("p2"), "size")


def _above(rows: DataFrame, band: int) -> DataFrame:
    """conv, depth, above: keys of the ancestors in the band of the parent, at most `band`."""
    upto = Window.partitionBy("conv", F.floor((F.col("depth") - 1) / band)).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    up = F.collect_list(F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))).over(upto)
    return rows.select("conv", "depth", up.alias("above"))


def _summed(parts: DataFrame, values: list[str]) -> DataFrame:
    return parts.groupBy(*KEY).agg(*(F.sum(v).alias(v) for v in values))


def _to_ancestors(nodes: DataFrame, values: list[str]) -> DataFrame:
    return nodes.select(F.explode("above").alias("a"), *values).select("a.*", *values)


def rollup(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int, band: int, folder: str, level: int = 0) -> DataFrame:
    """depth, k1, k2 and the sums of `values` over the subtree of each node, itself included.

    `nodes` has depth, k1, k2, conv (any member) and values; `rows` the beginnings of all conversations, p1 and p2 being the key one depth up.
    """
    placed = nodes.join(_above(rows, band), ["conv", "depth"], "left")  # the root has no row
    placed = _written(placed.select(*KEY, "conv", "above", *values), folder, f"placed{level}")
    inside = placed.filter(F.col("depth") % band != 0)
    own = _written(_summed(placed.select(*KEY, *values).union(_to_ancestors(inside, values)), values), folder, f"own{level}")
    if deepest < band:
        return own
    # The roots of the bands as a trie of their own.
    higher = (F.col("depth") / band).cast("long")
    at_roots = rows.filter(F.col("depth") % band == 0).select("conv", higher.alias("depth"), "k1", "k2")
    one_up = at_roots.select("conv", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    linked = at_roots.join(one_up, ["conv", "depth"], "left").withColumns({p: F.coalesce(F.col(p), F.lit(0)) for p in ("p1", "p2")})
    linked = _written(linked, folder, f"roots{level}")
    roots = own.filter(F.col("depth") % band == 0).join(placed.select(*KEY, "conv"), KEY).withColumn("depth", higher)
    totals = rollup(roots, linked, values, deepest // band, band, folder, level + 1)
    complete = totals.filter("depth > 0").withColumn("depth", F.col("depth") * band).join(placed.select(*KEY, "above"), KEY)
    return _written(_summed(own.union(_to_ancestors(complete, values)), values), folder, f"total{level}")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv) to rows of many ids as text, with the first id for their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        ids = batch.column(3).to_pylist()
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        cuts = [0]
        for end in [*new.tolist(), len(ids)]:
            cuts += [*range(cuts[-1] + CHUNK_IDS, end, CHUNK_IDS), end]
        starts = np.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(key[k][starts]) for k in range(3)), pa.array([ids[i] for i in cuts[:-1]], pa.int64()),
             pa.array([",".join(map(str, ids[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])],
            names=[*KEY, "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one digest for each node: only its running hash is held."""
    held, state = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if key == held:
                state.update(b",")
            else:
                if held:
                    done.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256()
            state.update(text.encode())
        if done:
            yield _digest_rows(done)
    if held:
        yield _digest_rows([(*held, state.hexdigest())])
    tb.give_back()


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*KEY, "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the ids (conv) that end at each node, in ascending order."""
    key = "depth bigint, k1 bigint, k2 bigint"
    chunks = ends.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_chunked, f"{key}, first bigint, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, folder: str, band: int = BAND) -> DataFrame:
    """The nodes of all beginnings. `turns`: conv, at (1, 2, ...), digest, size. `lengths`: conv, n for every conversation, n = 0 too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    longest = lengths.agg(F.max("n")).first()[0] or 0
    rows = _written(beginnings(turns, longest, band), folder, "beginnings")
    root = lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).select(
        *(F.lit(0).cast("long").alias(k) for k in KEY), "conv", "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("size", "p1", "p2")))
    nodes = rows.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), *(F.max(c).alias(c) for c in ("size", "p1", "p2")))
    nodes = _written(nodes.union(root.select(nodes.columns)), folder, "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = _written(
        nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.greatest("n_convs", F.lit(1)) - 1) * F.col("size")}), folder, "counted")
    totals = rollup(nodes.select(*KEY, "conv", "n_leaves", "saved_tokens"), rows, ["n_leaves", "saved_tokens"], longest, band, folder)
    last = rows.join(lengths.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select(*KEY, "conv")
    turnless = lengths.filter("n = 0").select(*(F.lit(0).cast("long").alias(k) for k in KEY), "conv")
    ends = ends_digest(last.union(turnless))
    above = nodes.select(F.col("depth").alias("d"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("parent_conv_id"))
    here = (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2"))
    return (
        nodes.drop("n_leaves", "saved_tokens").join(totals, KEY).join(ends, KEY, "left").join(above, here, "left")
        .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    )


def rebuilt(turns: DataFrame, shared_of: Column, shared_turns: Column, most: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) after the first `shared_turns` turns of each conversation were replaced by those of the conversation `shared_of`.

    Both are expressions of conv; `most` is the greatest value of `shared_turns`. `turns` comes from `numbered_turns`, written.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.withColumns({"other": shared_of, "h": shared_turns.cast("long")})
    parents = sizes.select(F.col("conv").alias("other"), F.col("n").alias("held"))
    plan = plan.join(parents, "other", "left").withColumn("head", F.least("h", F.coalesce("held", F.lit(0))))
    plan = _written(plan.select("conv", "other", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), folder, "plan")
    first = turns.filter(F.col("at") <= most).withColumnRenamed("conv", "other")
    heads = plan.join(first, "other").filter("at <= h").select("conv", "at", "digest", "size")
    tails = turns.join(plan.select("conv", "h", "head"), "conv").filter("at > h").select("conv", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "digest", "size")
    return heads.union(tails), plan.select("conv", "n")


#: The query's conversations begin with turns of the first of their five, as many as a checksum of the id tells.
GROUP, FOLDS = 5, 9


def query(spark, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet") if turns is None else turns
    folder = shared_dir(spark, "trie")
    turns = _written(numbered_turns(turns, folder), folder, "turns")
    conv = F.col("conv")
    return trie(*rebuilt(turns, conv - conv % GROUP, F.crc32(conv.cast("string").cast("binary")) % FOLDS, FOLDS - 1, folder), folder)


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS j, CAST(4294967295 AS BIGINT) AS v FROM c
  UNION ALL
  SELECT conv_id, s, j + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
  FROM (SELECT *, CASE WHEN j % 8 = 0 THEN xor(v, CAST(ascii(substr(s, CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE v END AS x FROM crc WHERE j < 8 * length(s))),
plan AS (
  SELECT crc.conv_id, crc.conv_id - crc.conv_id % 5 AS other, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM crc WHERE j = 8 * length(s)),
r AS (
  SELECT plan.conv_id, t.pos, role, txt FROM plan JOIN t ON t.conv_id = plan.other AND t.pos <= plan.h
  UNION ALL
  SELECT t.conv_id, t.pos - plan.h + least(plan.h, coalesce(c.n, 0)), role, txt
  FROM t JOIN plan ON plan.conv_id = t.conv_id LEFT JOIN c ON c.conv_id = plan.other WHERE t.pos > plan.h),
p AS (
  SELECT conv_id, pos AS depth, strlen(txt) AS size,
         md5(string_agg(md5(role) || md5(txt), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM p GROUP BY depth, k),
linked AS (
  SELECT n.*, u.k AS up FROM nodes n LEFT JOIN p u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (depth, k)),
totals AS (
  SELECT a.depth, a.k, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM counted n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.k),
sizes AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
ends AS (
  SELECT depth, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM sizes JOIN p USING (conv_id, depth) GROUP BY depth, k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM counted n JOIN totals t USING (depth, k) LEFT JOIN ends e USING (depth, k)
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.k = n.up
"""
