"""Fields of candidate cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.config import BUCKETS, LAST_BUCKET
from tamis.functions.text import first_filled


def shown_bucket(label: Column, score: Column) -> Column:
    """The bucket that a card shows: from the best down, by label or by score."""
    name, value = F.coalesce(label, F.lit("")), F.coalesce(score.cast("double"), F.lit(0.0))
    out = F.lit(LAST_BUCKET)
    for bucket, least in reversed(BUCKETS):
        out = F.when((name == bucket) | (value >= least), bucket).otherwise(out)
    return out


def bar_width(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(5), score))


def contact(email: Column, other: Column, identifier: Column) -> Column:
    """An address: either field, else an identifier that looks like one, else empty."""
    return F.coalesce(first_filled(email, other, F.when(F.contains(identifier, F.lit("@")), identifier)), F.lit(""))


def language_flag(name: Column) -> Column:
    return F.when(F.lower(F.coalesce(name, F.lit(""))).isin("english", "en"), "english").otherwise("vietnamese")


def text_or_list(json: Column, path: str) -> Column:
    """A field that is a string or a list of strings, as an array."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    text = F.try_variant_get(F.try_parse_json(json), path, "string")
    many = F.try_variant_get(F.try_parse_json(json), path, "array<string>")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), many).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def category_lists(json: Column, categories: tuple[str, ...]) -> Column:
    """``map<category, array<string>>`` of an object whose values are lists, single values or nothing."""
    pairs = []
    for c in categories:
        items = F.transform(text_or_list(json, f"$.{c}"), lambda x: F.trim(x))
        pairs += [F.lit(c), F.filter(items, lambda x: x != "")]
    return F.create_map(*pairs)


def timings(stages: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Seconds of each key, with two decimals, and how many stages they come from."""
    return stages.groupBy(*keys).agg(F.bround(F.sum(seconds), 2).alias("seconds"), F.count(F.lit(1)).alias("stages"))
