"""Benchmark decontamination: a positional index of training words, probed from the rarest test terms.

1. `term_counts`: how often each term of the test items stands in the training texts.
2. `anchored`: each test phrase gets its rarest term as anchor and the next rarest as second list.
3. `phrase_matches`: the postings of anchor terms (document, position, and the words around it, which
   are the other terms' offset-adjusted postings) are intersected with the phrases: first the second
   rarest term, then all. Only whole matches leave the scan, so nothing but matches is shuffled.
`proximity_matches` finds items whose rarest terms stand near each other in any order.

DataFrame expressions only. The phrases are broadcast if they measure at most `BROADCAST_CHARS`;
beyond that Spark joins them by a shuffle on the term.

A null text or item has no words, and an item without words matches nothing. Rows equal in id and
text are one document whose result is repeated; other rows that share an id are kept apart. Null
ids are an id of their own; null item ids are left out. Empty tables give no matches. Other columns
are left out, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.session import shared_dir

from . import native_words as nw

WINDOW = 10
#: Phrases of more characters than this are not broadcast.
BROADCAST_CHARS = 16_000_000


def phrases(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: phrase (array of words) and the ids of its items."""
    rows = items.select(F.col(item_col).alias("item_id"), nw.words(F.col(text_col)).alias("w")).filter("item_id IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        rows.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("phrase"))
        .groupBy("phrase").agg(F.collect_set("item_id").alias("items"))
    )


def bounded(df: DataFrame, chars: Column, limit: int = BROADCAST_CHARS) -> DataFrame:
    """`df` with a broadcast hint if it measures at most `limit` characters."""
    size = df.agg(F.sum(chars)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def term_counts(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, n: places of each term in the training texts; counted in the scan first, so little is shuffled."""
    found = docs.select(F.explode(nw.words(F.col(text_col))).alias("term")).join(bounded(terms, F.length("term") + 16), "term")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchored(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase, items, key (hash of the rarest term), anchor and second: places (from 0) of the rarest and the next
    rarest term. Phrases with a term that no training text holds are gone."""
    places = wanted.withColumn("_id", F.xxhash64("phrase")).select("_id", "phrase", F.posexplode("phrase").alias("place", "term"))
    ranked = places.join(counts, "term").groupBy("_id", "phrase").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("by"))
    ranked = ranked.filter(F.size("by") == F.size("phrase")).select(
        "phrase", F.xxhash64(F.col("by")[0]["term"]).alias("key"), F.col("by")[0]["place"].alias("anchor"),
        F.coalesce(F.get("by", F.lit(1))["place"], F.col("by")[0]["place"]).alias("second"),
    )
    return ranked.join(wanted, "phrase")


def phrase_matches(docs: DataFrame, anchors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig, n_words, start (from 0; null in the one row that every document has), length, items."""
    sized = bounded(anchors, F.length(F.concat_ws(" ", "phrase")) + 8 * F.size("items") + 32)
    start = F.col("at") - 1 - F.col("anchor")
    whole = (
        (F.xxhash64("word") == F.col("key")) & (F.col("at") > F.col("anchor")) & (start + F.size("phrase") <= F.size("words"))
        & (F.get("words", start + F.col("second")) == F.get("phrase", F.col("second")))
        & (F.slice("words", start + 1, F.size("phrase")) == F.col("phrase"))
    )
    return (
        nw.tokens(docs, id_col, text_col).join(sized, whole, "left").filter((F.col("at") == 0) | F.col("anchor").isNotNull())
        .select("doc_id", "sig", F.size("words").alias("n_words"), F.when(F.col("at") > 0, start).alias("start"), F.size("phrase").alias("length"), "items",
                (F.col("at") == 0).cast("long").alias("is_doc"))
    )


def hit_words(spans: Column) -> Column:
    """Words covered by spans (sorted array of start and length)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc, span):
        end = (span["start"] + span["length"]).cast("long")
        return F.struct((acc["n"] + F.greatest(end - F.greatest(span["start"].cast("long"), acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def document_hits(matches: DataFrame) -> DataFrame:
    """A row for each document: doc_id, sig (xxhash64 of the text), n_words, spans, n_hit, item_ids (sorted as strings)."""
    grouped = matches.groupBy("doc_id", "sig").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("is_doc").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"),
    )
    item_ids = F.array_sort(F.array_distinct(F.col("items").cast("array<string>")))
    return grouped.select(
        "doc_id", "sig", "n_words", "spans", hit_words(F.col("spans")).alias("n_hit"), item_ids.alias("item_ids"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`document_hits` of all windows of the items. The phrases with their anchors are written once, to the shared folder."""
    spark = docs.sparkSession
    wanted = phrases(items, item_col, item_text_col, window)
    folder = shared_dir(spark, "test-phrases")
    wanted.write.parquet(f"{folder}/phrases")
    wanted = spark.read.parquet(f"{folder}/phrases")
    counts = term_counts(docs, wanted.select(F.explode("phrase").alias("term")).distinct(), id_col, text_col)
    anchored(wanted, counts).write.parquet(f"{folder}/anchors")
    return document_hits(phrase_matches(docs, spark.read.parquet(f"{folder}/anchors"), id_col, text_col))


def proximity_matches(docs: DataFrame, items: DataFrame, n_terms: int = 3, within: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id: documents in which an item's `n_terms` rarest distinct terms stand in `within` consecutive words."""
    terms = items.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(nw.words(F.col(item_text_col)))).alias("term")).filter("item_id IS NOT NULL")
    counts = term_counts(docs, terms.select("term").distinct(), id_col, text_col)
    rare = (
        terms.join(counts, "term", "left").groupBy("item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, n_terms).alias("by"))
        .select("item_id", F.size("by").alias("n_wanted"), F.posexplode("by").alias("rank", "x")).select("item_id", "n_wanted", "rank", F.col("x.term").alias("word"))
    )
    postings = nw.tokens(docs, id_col, text_col).drop("words").filter("at > 0").join(bounded(rare, F.length("word") + 32), "word")
    lists = postings.groupBy("doc_id", "sig", "item_id", "n_wanted", "rank").agg(F.collect_list("at").alias("places"))
    both = lists.groupBy("doc_id", "sig", "item_id", "n_wanted").agg(F.sort_array(F.collect_list(F.struct("rank", "places"))).alias("l")).filter("size(l) = n_wanted")
    near = F.exists(F.flatten(F.col("l.places")), lambda first: F.forall(F.col("l"), lambda x: F.exists(x["places"], lambda p: (p >= first) & (p < first + within))))
    return both.filter(near).select("doc_id", "item_id").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_W = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
g AS (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
      FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM d), (SELECT DISTINCT k FROM p) WHERE s + k - 1 <= len(w)),
m AS (SELECT rid, s, k, item_id FROM g JOIN p USING (k, phrase)),
h AS (SELECT rid, count(DISTINCT wd) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS wd FROM m) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
