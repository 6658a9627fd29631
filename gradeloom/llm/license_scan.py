"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined by Spark with the k-grams of the
templates. A joint k-gram at document word i and template word j votes for the diagonal i - j;
votes are taken per document, template and diagonal. Neighbouring diagonals (a word dropped or
put in moves the rest to the next one) are merged in the order of diagonals, so strays on far ones (words
that a template repeats) part nothing. Runs of one notice that rise in document and template, with at most
the template's length (or `MIN_GAP` words) between them, are chained, so such clauses may be put in. A chain
counts if the distinct template places with a vote cover enough of the template; a place that got votes
on two diagonals of a run counts once. Every vote compares
the words themselves, not only their hashes. Phrases (short templates) must be covered whole on one diagonal.

The templates' k-grams are broadcast up to `MAX_BROADCAST`; then the scan sends on nothing but votes.
More of them are joined by a shuffle of the documents' k-grams. The runs of one notice in one document
are chained together in one row, so they are bounded by the text. A null text has no words. Rows equal in id and text are one document whose result is
repeated; other rows that share an id are kept apart; null ids are an id of their own. An empty
table gives no rows. Other columns are left out, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from . import native_words as nw
from .license_texts import BASE_PHRASES, NOTICES

K = 4
PHRASE_K = 2
#: Template k-grams are broadcast up to this number (some 100 bytes each), beyond it joined by a shuffle of k-grams.
MAX_BROADCAST = 200_000
#: Diagonals at most so far apart are neighbours; a span counts from this part of the template on.
SLACK, MIN_COVERAGE = 6, 0.5
#: Words that may stand between the runs of a chain, where the template is shorter than that.
MIN_GAP = 32

VOTES = ["doc_id", "sig", "template", "label", "kind", "size"]


def templates(spark: SparkSession, phrases=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, kind ('phrase' or 'notice'), size, k, place (from 0), gram (array of words), key (hash): all k-grams."""
    rows = [(i, label, kind, text) for i, (label, kind, text) in enumerate([*((b, "phrase", a) for a, b in phrases), *((a, "notice", b) for a, b in notices)])]
    w = spark.createDataFrame(rows, "template int, label string, kind string, text string").withColumn("w", nw.words(F.col("text")))
    k = F.when(F.col("kind") == "phrase", F.lit(PHRASE_K)).otherwise(F.lit(K))
    grams = w.select("template", "label", "kind", F.size("w").alias("size"), k.alias("k"), "w").withColumn(
        "place", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k")))
    ).withColumn("gram", F.slice("w", F.col("place") + 1, F.col("k")))
    return grams.drop("w").withColumn("key", F.when(F.col("k") == PHRASE_K, _key("gram", F.lit(0), PHRASE_K)).otherwise(_key("gram", F.lit(0), K)))


def _key(words: str, first: Column, k: int) -> Column:
    """Hash of k words from place `first` (from 0) on; null where the text ends before."""
    last = F.get(words, first + (k - 1))
    return F.when(last.isNotNull(), F.xxhash64(F.lit(k), *(F.get(words, first + j) for j in range(k))))


def votes(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig, n_words, template columns, diagonal, word (of the document): a row for each vote, and one without template per document."""
    at = F.col("at") - 1
    grams = nw.tokens(docs, id_col, text_col).select(
        "doc_id", "sig", "words", "at",
        F.explode(F.when(F.col("at") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(_key("words", at, PHRASE_K), _key("words", at, K)))).alias("gram_key"),
    )
    empty = F.col("at") == 0
    if known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        same = (F.col("gram_key") == F.col("key")) & (F.slice("words", F.col("at"), F.col("k")) == F.col("gram"))
        found = grams.join(F.broadcast(known), same, "left").filter(empty | F.col("template").isNotNull()).withColumn("n", F.size("words"))
    else:  # only the k words of a k-gram go with it
        own = grams.withColumn("n", F.size("words")).withColumn("own", F.slice("words", F.greatest(F.col("at"), F.lit(1)), F.lit(K))).drop("words")
        same = (F.col("gram_key") == F.col("key")) & (F.slice("own", F.lit(1), F.col("k")) == F.col("gram"))
        whole = grams.filter(empty).select("doc_id", "sig", "at", F.size("words").alias("n"))
        found = own.filter(F.col("gram_key").isNotNull()).join(known, same).unionByName(whole, allowMissingColumns=True)
    return found.select(
        "doc_id", "sig", F.col("n").alias("n_words"), "template", "label", "kind", "size", "k", (F.col("at") == 0).cast("long").alias("is_doc"),
        F.when(F.col("at") > 0, at).alias("word"), F.when(F.col("at") > 0, at - F.col("place")).alias("diagonal"),
    ).groupBy(*VOTES, "k", "n_words", "diagonal", "word").agg(F.sum("is_doc").alias("copies"))


def spans(voted: DataFrame, slack: int = SLACK, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Verified spans: doc_id, sig, template, label, kind, start, end (words, end excluded), coverage.

    The window runs over the votes of one template in one document, so it is bounded by the text.
    """
    w = Window.partitionBy("doc_id", "sig", "template").orderBy("diagonal", "word")
    step = F.col("diagonal") - F.lag("diagonal").over(w)
    apart = step.isNull() | (step > F.when(F.col("kind") == "phrase", 0).otherwise(slack))
    place = F.col("word") - F.col("diagonal")
    merged = (
        voted.filter("template IS NOT NULL").withColumn("_apart", apart.cast("int")).withColumn("_run", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*VOTES, "k", "_run").agg(
            F.count_distinct(place).cast("int").alias("votes"), F.min("word").alias("start"), (F.max("word") + F.first("k")).alias("end"),
            F.min(place).alias("first"), (F.max(place) + F.first("k")).alias("last"),
        )
    )
    whole = F.col("size") - F.col("k") + 1
    alone = merged.filter((F.col("kind") == "phrase") & (F.col("votes") >= whole)).select(*VOTES, "start", "end", F.lit(1.0).alias("coverage"))
    chains = (
        merged.filter("kind = 'notice'").groupBy(*VOTES, "k").agg(F.array_sort(F.collect_list(F.struct("start", "end", "first", "last", "votes"))).alias("runs"))
        .filter(F.aggregate("runs.votes", F.lit(0), lambda a, b: a + b) >= min_coverage * whole)
        .select(*VOTES, whole.alias("whole"), F.explode(_chains("runs", "size", whole * F.lit(float(min_coverage)))).alias("c"))
        .select(*VOTES, F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.least(F.col("c.votes") / F.col("whole"), F.lit(1.0)).alias("coverage"))
        .filter(F.col("coverage") >= min_coverage)
    )
    return alone.unionByName(chains)


def best_chains(runs: list[dict], size: int, least: float) -> list[tuple[int, int, int]]:
    """(start, end, votes) of chains of runs that rise in the document and in the template, with gaps of at most `size`
    words (or MIN_GAP): the one with the most votes first, no two over the same words, none with fewer votes than `least`.
    `runs` are sorted by their start; a run's predecessor starts at most 3 such gaps before it."""
    gap = max(size, MIN_GAP)
    out, left = [], list(runs)
    while left:
        best: list[tuple[int, int]] = []  # votes of the best chain that ends with each run, and the run before it
        for j, r in enumerate(left):
            own = (r["votes"], -1)
            for i in range(j - 1, -1, -1):
                q = left[i]
                if r["start"] - q["start"] > 3 * gap:
                    break
                if q["end"] <= r["start"] <= q["end"] + gap and q["last"] <= r["first"]:
                    own = max(own, (best[i][0] + r["votes"], i))
            best.append(own)
        at = max(range(len(left)), key=lambda j: (best[j][0], -left[j]["start"]))
        votes, end = best[at][0], left[at]["end"]
        if votes < least:
            break
        while best[at][1] >= 0:
            at = best[at][1]
        start = left[at]["start"]
        out.append((start, end, votes))
        left = [r for r in left if r["end"] <= start or r["start"] >= end]
    return out


_chains = F.udf(lambda runs, size, least: best_chains(runs, size, least), T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "votes")])))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, base_spans and notice_spans (arrays of label, start, end, coverage)."""
    known = templates(docs.sparkSession) if known is None else known
    voted = votes(docs, known, id_col, text_col)
    found = spans(voted)
    one = F.struct("label", "start", "end", "coverage")
    # One row per document and one per span meet in a single grouping; a document has no more spans than words.
    rows = voted.filter("template IS NULL").select("doc_id", "sig", "n_words", "copies", F.lit(None).cast("string").alias("kind"), F.lit(None).alias("span")).unionByName(
        found.select("doc_id", "sig", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"), "kind", one.alias("span"))
    )
    out = rows.groupBy("doc_id", "sig").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "phrase", F.col("span")))).alias("base_spans"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "notice", F.col("span")))).alias("notice_spans"),
    )
    return nw.repeated(out, "copies").drop("copies", "sig")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda *columns: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*(F.col(f"{c}.label") for c in columns)))))
    return rows.select(
        "doc_id", "n_words", F.size("base_spans").cast("long").alias("n_base"), F.array_min("base_spans.start").cast("long").alias("first_word"),
        F.array_max("base_spans.start").cast("long").alias("last_word"), labels("base_spans").alias("base_labels"), labels("base_spans", "notice_spans").alias("labels"),
        F.coalesce(F.array_max(F.concat(F.col("base_spans.coverage"), F.col("notice_spans.coverage"))), F.lit(0.0)).alias("score"),
    )


#: The columns that do not depend on the method's own templates.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p(phrase, label, k) AS (VALUES ('gnu general public license', 'gpl', 4), ('apache license', 'apache', 2), ('cc by', 'cc-by', 2), ('mit license', 'mit', 2)),
t AS (SELECT rid, w, unnest(range(0, len(w))) AS s FROM d),
m AS (SELECT rid, s, label FROM t JOIN p ON array_to_string(w[s + 1:s + k], ' ') = phrase),
g AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN g USING (rid)
"""
