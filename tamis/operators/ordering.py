"""Tier lists, identifiers, precedence, and names that must be unique."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamis.functions.text import EMAIL, stem, strip
from tamis.shared import materialise

LAST_TIER, NO_PLACE = 3, 9999


def is_separator(line: Column) -> Column:
    folded = F.lower(line)
    return line.startswith("---") | F.contains(folded, F.lit("tier 2")) | F.contains(folded, F.lit("tier2"))


def parse_order(lines: DataFrame, position: str, line: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, tier, place, item`` of the lines of tier lists.

    Lines are tier 1 until a separator, then tier 2; blank lines and comments are skipped, ``Name <address>`` is unwrapped, items are
    lower case without quotes, and repeats in a tier go. A list is parsed as one group: its file bounds it.
    """
    text = strip(F.col(line))
    read = lines.select(*keys, F.col(position).alias("__at"), text.alias("__line")).where("__line <> '' AND NOT startswith(__line, '#')")
    so_far = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = read.withColumn("__sep", is_separator(F.col("__line"))).withColumn("tier", F.max(F.col("__sep").cast("int")).over(so_far) + 1)
    inner = F.regexp_extract("__line", "<([^>]+)>", 1)
    unwrapped = F.when(inner != "", strip(inner)).otherwise(F.col("__line"))
    item = F.lower(F.regexp_replace(F.regexp_replace(unwrapped, "^[\"' ]+", ""), "[\"' ]+$", ""))
    items = marked.where("NOT __sep").withColumn("item", item).where("item <> ''")
    first = items.groupBy(*keys, "tier", "item").agg(F.min("__at").alias("__at"))
    in_order = Window.partitionBy(*keys, "tier").orderBy("__at")
    return first.select(*keys, "tier", (F.row_number().over(in_order) - 1).alias("place"), "item")


def identifiers(candidates: DataFrame, file_name: str, text: str, names: Sequence[str]) -> DataFrame:
    """``file_name, identifier`` of everything that an order list may call a candidate.

    Addresses found in ``text`` and their parts before ``@``, however short, the file's name and stem, and the
    columns ``names``, all in lower case.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({EMAIL})"), 1)
    prefixes = F.filter(F.transform(found, lambda e: F.substring_index(e, "@", 1)), lambda p: F.length(p) > 0)
    own = F.array(F.lower(F.col(file_name)), F.lower(stem(F.col(file_name))), *[F.lower(strip(F.col(n))) for n in names])
    every = F.array_distinct(F.concat(found, prefixes, own))
    return candidates.select(file_name, F.explode(every).alias("identifier")).where("identifier <> ''")


def match_tiers(candidates: DataFrame, ids: DataFrame, order: DataFrame, key: str, most_items: int = 100_000) -> DataFrame:
    """``candidates`` with ``tier`` and ``tier_order``: the first item of the lowest tier that equals an identifier."""
    items = order.where("length(item) >= 2").select("item", "tier", "place")
    if items.limit(most_items + 1).count() <= most_items:
        items = F.broadcast(items)
    best = ids.join(items, F.col("identifier") == F.col("item")).groupBy(key).agg(F.min(F.struct("tier", "place")).alias("__best"))
    joined = candidates.join(best, key, "left")
    return joined.select(
        *[c for c in candidates.columns],
        F.coalesce("__best.tier", F.lit(LAST_TIER)).alias("tier"),
        F.coalesce("__best.place", F.lit(NO_PLACE)).alias("tier_order"),
    )


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: one combined aggregate instead of a sort, so a hot key costs a row a task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.min_by(F.struct(*[F.col(c) for c in (*order, *rest)]), F.struct(*[F.col(c) for c in order]))
    picked = rows.groupBy(*keys).agg(best.alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def by_precedence(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several folders; of one name the first folder's counts."""
    united = None
    for i, frame in enumerate(frames):
        ranked = frame.withColumn("precedence", F.lit(i))
        united = ranked if united is None else united.unionByName(ranked, allowMissingColumns=True)
    return first_by(united, [key], ["precedence"])


def unique_names(rows: DataFrame, name: str, order: str, result: str = "unique_name") -> DataFrame:
    """``rows`` with names made unique in the order of ``order``: ``x@d``, then ``x_2@d``, ``x_3@d`` and so on.

    A name that is taken, by a row before or as a made-up one, goes on counting. Only families of names that could meet (``x`` beside
    ``x_2``) are worked through one by one, as their numbers depend on each other; all others are ranked. Such a family meets in one task, so
    it must fit there. ``order`` must be unique in a family.
    """
    local = F.regexp_extract(name, r"^([^@]*)", 1)
    domain = F.when(F.contains(F.col(name), F.lit("@")), F.regexp_extract(name, r"^[^@]*@([^@]*)", 1)).otherwise(F.lit("unknown.com"))
    family = F.concat_ws("@", F.regexp_replace(local, r"(_[0-9]+)+$", ""), domain)
    marked = rows.withColumn("__family", family)
    kinds = marked.groupBy("__family").agg((F.min(name) != F.max(name)).alias("__mixed"))
    marked = marked.join(kinds, "__family")
    pure = ranked(marked.where("NOT __mixed"), name, [order], "__n")
    made = F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(local, F.lit("_"), F.col("__n"), F.lit("@"), domain))
    pure = pure.withColumn(result, made).drop("__n", "__mixed", "__family")

    def one_by_one(family: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        family = family.sort_values(order, kind="stable")
        for own in family[name]:
            head, at, tail = own.partition("@")
            n, now = 1, own
            while now in taken:
                n += 1
                now = f"{head}_{n}@{tail.split('@')[0] if at else 'unknown.com'}"
            taken.add(now)
            out.append(now)
        return family.assign(**{result: out})[[*columns, result]]

    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(result, T.StringType())])
    mixed = marked.where("__mixed").select("__family", *[F.col(c) for c in columns])
    return pure.select(*columns, result).unionByName(mixed.groupBy("__family").applyInPandas(one_by_one, schema))


def ranked(rows: DataFrame, key: str, order: Sequence[str], result: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``order`` among the rows of their key.

    However many rows a key has, no task sees more than a range of them: rows are dealt by ranges of key and order, counted for each
    range, and numbered inside it from the count of the ranges before. The ranges are written once, so that counts and numbers agree.
    """
    dealt = rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    counts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order))
    joined = dealt.withColumn("__local", local).join(bases, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of")))
    return joined.select(*[F.col(c) for c in rows.columns], (F.col("__base") + F.col("__local")).alias(result))


def rank_in_tier(rows: DataFrame, tier: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with the rank inside their tier (3 if unknown) and the tier's count."""
    known = rows.withColumn("__tier", F.coalesce(F.col(tier), F.lit(LAST_TIER)))
    counts = known.groupBy("__tier").agg(F.count(F.lit(1)).alias("tier_count"))
    return ranked(known, "__tier", order).join(F.broadcast(counts), "__tier").drop("__tier")  # a row for each tier
