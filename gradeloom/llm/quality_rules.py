"""Quality rules: text statistics and a learned decision list over them.

`text_statistics` measures every text. `learn_rules` covers the labelled bad texts one rule
after the other: a rule is grown as a conjunction of thresholds on one half of the labelled
rows and pruned on the other half; what it covers is taken out, and the next rule is grown.
`rule_number` turns the list into one ordered conditional expression of Spark.

Null texts have no words. A text without words has zero in every statistic. Rows are taken one
by one, so repeated rows and repeated or null ids are no special case. An empty table gives an
empty result; without labelled rows of both kinds the list is empty and the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import text_blocks as tb

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_EXTRA_COUNTS = ["n_upper", "n_letters", "n_digits", "n_punct", "n_chars_all", "n_lines", "n_pipes", "n_distinct_words", "n_long_words"]
COUNTS = BASE + _EXTRA_COUNTS
PREFIX = "qr_"
REPEAT_WIDTH = 5
#: Most labelled rows that the rules are learned from; the ones with the smallest hash of their id.
MAX_LABELLED = 20_000

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_CLASSES = {
    "n_symbols": _SYMBOL,
    "n_upper": np.isin(np.arange(256), np.arange(65, 91)),
    "n_letters": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]),
    "n_digits": np.isin(np.arange(256), np.arange(48, 58)),
    "n_punct": np.isin(np.arange(256), [ord(c) for c in "!?.,;:"]),
    "n_chars_all": (np.arange(256) & 0xC0) != 0x80,
    "n_pipes": np.arange(256) == ord("|"),
}
_POINT = (np.arange(256) & 0xC0) != 0x80


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equal to any other key; equal to an earlier key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    any_other, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    earlier[order[1:]] = same
    return any_other, earlier


def _statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, bounds = tb.word_spans(buf, offsets, tb.PLAIN_WORD)
    out = {"n_words": np.diff(bounds)}
    sums = tb.byte_sums(buf)
    hashes = tb.span_hash(sums, starts, ends)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_POINT[buf] & tb.PLAIN_WORD[buf], out=points[1:])
    out["word_chars"] = points[offsets[1:]] - points[offsets[:-1]]
    for name, lut in _CLASSES.items():
        out[name] = tb.per_document(lut[buf], offsets)
    own = tb.owners(bounds)
    salt = tb.mixed(np.arange(1, len(offsets), dtype=np.uint64))
    _, earlier = _repeated(hashes ^ salt[own])
    out["n_distinct_words"] = np.diff(bounds) - tb.per_document(earlier, bounds)
    out["n_long_words"] = tb.per_document((points[ends] - points[starts]) > 12, bounds)
    at = tb.whole_windows(bounds, REPEAT_WIDTH)
    twice, _ = _repeated(tb.item_windows(hashes, REPEAT_WIDTH)[at] ^ salt[own[at]])
    out["n_repeat_words"] = tb.per_document(tb.covered(at[twice], REPEAT_WIDTH, len(hashes)), bounds)
    # Lines: cut at \n and at document ends; a line counts if a word starts in it.
    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(buf == 10) + 1]))
    line_starts = line_starts[line_starts <= len(buf)]
    line_ends = np.append(line_starts[1:], len(buf))
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[with_word], line_ends[with_word], line_doc[with_word]
    line_ends = line_ends - (buf[line_ends - 1] == 10)
    _, again = _repeated(tb.span_hash(sums, line_starts, line_ends) ^ salt[line_doc])
    n = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    return out


def _measure(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = tb.buffers(batch.column(text_col))
        parts = [_statistics(b, o) for _, _, b, o in tb.chunks(buf, offsets)]
        columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, columns)], names=[*batch.schema.names, *(PREFIX + c for c in COUNTS)]
        )
        tb.give_back()


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and one `qr_` count for each statistic of the whole text. No shuffle."""
    docs = docs.select([c for c in docs.columns if not c.startswith(PREFIX)])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(PREFIX + c, T.LongType()) for c in COUNTS)])
    return docs.mapInArrow(lambda it: _measure(it, text_col), schema)


def base_failed(min_words: int = 10, max_repeat_pct: int = 20) -> Column:
    n = F.col(PREFIX + "n_words")
    return (n < min_words) | (100 * F.col(PREFIX + "n_repeat_words") > max_repeat_pct * n)


#: Features of the learned rules: name -> (numerator, denominator).
RATIOS = {
    "symbols_per_char": ("n_symbols", "n_chars_all"),
    "upper_per_letter": ("n_upper", "n_letters"),
    "digits_per_char": ("n_digits", "n_chars_all"),
    "punct_per_word": ("n_punct", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_words_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "long_per_word": ("n_long_words", "n_words"),
    "words": ("n_words", None),
}


def _feature(name: str) -> Column:
    top, below = RATIOS[name]
    value = F.col(PREFIX + top).cast("double")
    return value / F.greatest(F.col(PREFIX + below), F.lit(1)) if below else value


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = _feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _cover(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for c in rule:
        mask &= c.mask(x)
    return mask


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    """Adds the condition of the largest information gain until only bad rows are covered."""
    rule, inside = (), np.ones(len(bad), bool)
    while inside.any() and not bad[inside].all() and len(rule) < max_conditions:
        y = bad[inside]
        p0, n0 = y.sum(), (~y).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, values in x.items():
            v = values[inside]
            order = np.argsort(v, kind="stable")
            v, ys = v[order], y[order]
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            below_p = np.cumsum(ys)[cut]
            below_n = (cut + 1) - below_p
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside = _cover(rule, x, len(bad))
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = _cover(rule, x, len(bad))
    p, n = (bad & inside).sum(), (~bad & inside).sum()
    return (p - n) / (p + n) if p + n else -1.0


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.97, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows, in the order in which they were found. Every third row prunes, the others grow."""
    rules: list[Rule] = []
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (bad & left & ~prune).sum() >= 3:
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _grow(*part(left & ~prune), max_conditions)
        if not rule:
            break
        held = part(left & prune)
        while len(rule) > 1 and _worth(rule[:-1], *held) >= _worth(rule, *held):
            rule = rule[:-1]
        inside = _cover(rule, x, len(bad)) & left
        held_p, held_all = (bad & inside & prune).sum(), (inside & prune).sum()
        if not (bad & inside).sum() or bad[inside].mean() < min_precision or (held_all and held_p / held_all < min_precision):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list from labelled rows (label 0 is bad). At most `max_labelled` ids, those with the
    smallest hash, are brought to the driver, each as one row of a dozen numbers: of several labels of an id the
    smallest counts, of several texts the one with the smallest statistics. Rows without id or label don't count."""
    chosen = _chosen(labels, id_col, label_col, max_labelled)
    found = stats.filter(~base_failed()).select(F.col(id_col).alias("_id"), *(_feature(name).alias(name) for name in RATIOS))
    joined = found.join(F.broadcast(chosen), "_id")  # broadcast: max_labelled rows of two numbers
    rows = joined.groupBy("_id").agg(F.min("_label").alias("_label"), F.min(F.struct(*RATIOS)).alias("_x")).select("_id", "_label", "_x.*").toPandas()
    if not len(rows):
        return []
    rows = rows.iloc[np.lexsort([rows[c].to_numpy() for c in RATIOS] + [tb.mixed(rows["_id"].map(hash).to_numpy().astype(np.int64).view(np.uint64))])]
    bad = rows["_label"].to_numpy() == 0
    return decision_list({name: rows[name].to_numpy() for name in RATIOS}, bad) if bad.any() and not bad.all() else []


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 for none. Null never arises: every statistic is set."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of `docs`, the `qr_` statistics, `qr_base_failed`, `qr_rule` and `qr_kept`."""
    chosen = labels.select(id_col, "quality")
    learn_on = text_statistics(docs.select(id_col, text_col).join(F.broadcast(_chosen(chosen, id_col).select(F.col("_id").alias(id_col))), id_col, "left_semi"), text_col)
    rules = learn_rules(learn_on, chosen, id_col)
    return text_statistics(docs, text_col).withColumns({PREFIX + "base_failed": base_failed(), PREFIX + "rule": rule_number(rules)}).withColumn(
        PREFIX + "kept", ~F.col(PREFIX + "base_failed") & (F.col(PREFIX + "rule") == 0)
    )


def _chosen(labels: DataFrame, id_col: str, label_col: str = "quality", n: int = MAX_LABELLED) -> DataFrame:
    """_id, _label of the ids to learn from, a row each: n at most, so the broadcast is bounded."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna().groupBy("_id").agg(F.min("_label").alias("_label"))
    return rows.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(n)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", *(F.col(PREFIX + c).alias(c) for c in BASE), *(F.col(PREFIX + c).alias(c) for c in ("base_failed", "kept", "rule")))
