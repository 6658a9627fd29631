"""JSON that a model returned as text: test cases and gold items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import col
from ..functions.text import strip
from .ingest import normalize_generated

#: Ends the array that a text is parsed in.
_MARK = "end of items"


def without_fence(raw: str | Column) -> Column:
    """Trimmed text, or the inside of its first code fence without a json tag."""
    trimmed = strip(col(raw))
    inside = F.element_at(F.split(trimmed, "```"), 2)
    untagged = F.when(inside.startswith("json"), F.substr(inside, F.lit(5))).otherwise(inside)
    return strip(F.when(trimmed.startswith("```"), untagged).otherwise(trimmed))


def bracket_slice(raw: str | Column) -> Column:
    """From the first [ to the last ], NULL when there is no such stretch."""
    raw = col(raw)
    start = F.locate("[", raw)
    end = F.length(raw) - F.length(F.substring_index(raw, "]", -1))  # 0 without a bracket
    return F.when((start > 0) & (end >= start), F.substr(raw, start, end - start + 1))


def _framed(text: Column) -> Column:
    """The text as VARIANT, as first item of an array that ends with a mark; NULL where that is no JSON. The parser
    stops at the end of a value, so what follows the text's own array shows as a syntax error or moves the mark."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))


def _alone(framed: Column) -> Column:
    """The first item as an array of VARIANT; NULL where it is of another kind, or the mark is not the second and last item."""
    alone = (F.try_variant_get(framed, "$[1]", "string") == _MARK) & F.try_variant_get(framed, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(framed, "$[0]", "array<variant>"))


def parse_json_array(df: DataFrame, raw: str) -> DataFrame:
    """Adds `items` (array of VARIANT, one per item of whatever kind) and `parsed_by`: fence (text as such
    or inside a fence), slice (from the first to the last bracket) or rejected (items NULL)."""
    # One column per step, so that each text is parsed once however often the result is used.
    # The result passes through a generator: a later filter on it would otherwise be pushed
    # below the steps, with a copy of the parser for every mention of a column.
    return (
        df.withColumn("_whole", _framed(without_fence(raw)))
        .withColumn("_plain", _alone(F.col("_whole")))
        .withColumn("_cut", F.when(F.col("_plain").isNull(), _framed(bracket_slice(raw))))
        .withColumn("_salvaged", _alone(F.col("_cut")))
        .select(*df.columns, F.inline(F.array(F.struct(
            F.coalesce("_plain", "_salvaged").alias("items"),
            F.when(F.col("_plain").isNotNull(), "fence").when(F.col("_salvaged").isNotNull(), "slice")
            .otherwise("rejected").alias("parsed_by"),
        ))))
    )


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parsed_by") == "rejected").drop("items")


def _items(parsed: DataFrame) -> DataFrame:
    """One row per item: its place from 1, its value, and whether it is an object."""
    keep = [c for c in parsed.columns if c not in ("items", "parsed_by", "raw")]
    rows = parsed.select(*keep, F.posexplode("items").alias("_pos", "_item"))
    return rows.select(*keep, (F.col("_pos") + 1).cast("bigint").alias("test_seq"), "_item", F.coalesce(F.schema_of_variant("_item").startswith("OBJECT"), F.lit(False)).alias("_is_object"))


def item_rejects(parsed: DataFrame) -> DataFrame:
    """Items that are no objects, with their place and JSON; their neighbours are kept as cases."""
    return _items(parsed).filter(~F.col("_is_object")).withColumn("item", F.to_json("_item")).drop("_item", "_is_object")


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("_item", f"$.{name}", kind)


def _texts(name: str) -> Column:
    """A field that is a list of texts, or one text; NULL where it is neither."""
    is_text = F.schema_of_variant(_field(name, "variant")) == "STRING"
    return F.coalesce(_field(name, "array<string>"), F.when(is_text, F.array(_field(name))))


def cases_from_output(parsed: DataFrame) -> DataFrame:
    """One normalized test case per item that is an object, numbered by its place in its text. A field of
    another type is read as what it stands for ("3" as a weight, one criterion for a list), else it
    counts as missing; it never costs the item or its neighbours."""
    cases = _items(parsed).filter("_is_object")
    return normalize_generated(cases.select(
        *[c for c in cases.columns if not c.startswith("_")],
        _field("id").alias("test_id"), _field("category").alias("category"), _field("question").alias("question"), _texts("criteria").alias("criteria"),
        F.floor(_field("weight", "double")).cast("int").alias("weight"), _texts("context").alias("context"),
    ))


def gold_from_items(items: DataFrame) -> DataFrame:
    """Every generated gold item (role_slug, item_seq from 1) becomes one row per tier."""
    tiers = F.array(*[
        F.struct(
            F.lit(quality).alias("quality"), F.lit(ending).alias("ending"),
            F.coalesce(F.col(field), F.lit("")).alias("response"), F.lit(expected).alias("expected"),
        )
        for quality, field, ending, expected in fv.GOLD_TIERS
    ])
    return items.withColumn("_tier", F.explode(tiers)).select(
        "role_slug",
        F.concat(F.format_string("GEN-GOLD-%02d-", "item_seq"), "_tier.ending").alias("id"),
        F.col("_tier.quality").alias("quality"),
        F.initcap(F.replace("role_slug", F.lit("_"), F.lit(" "))).alias("domain"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.col("_tier.response").alias("response"),
        F.array(F.coalesce("criterion", F.lit(""))).alias("criteria"),
        F.array("_tier.expected").alias("expected_scores"),
    )
