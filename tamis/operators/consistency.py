"""Scores of repeated rounds, by candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import EMAIL, strip
from tamis.shared import col


def candidate_email(field: Column, text: Column, stem: Column) -> Column:
    """The address field if it looks like one, else the first address in the text, else a made-up one."""
    own = F.when(F.contains(field, F.lit("@")) & F.contains(field, F.lit(".")), F.lower(strip(field)))
    found = F.nullif(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), f"({EMAIL})", 1)), F.lit(""))
    return F.coalesce(own, found, F.concat(stem, F.lit("@unknown.com")))


def matrix(scores: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """A row for each ``row``, a column for each name, the first value of each, 0 where there is none.

    Names are given, so no extra pass looks for them; :func:`names_of` finds those of a table.
    """
    wide = scores.groupBy(row).pivot(column, list(names)).agg(F.first(value))
    return wide.select(row, *[F.coalesce(col(n), F.lit(0.0)).alias(n) for n in names])


def names_of(scores: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The distinct names of a matrix's columns, sorted; over ``most`` is an error, as each is a column."""
    found = [r[0] for r in scores.select(col(column)).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} names: too many for columns")
    return sorted(n for n in found if n is not None)


def cells(wide: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A row for each cell of a matrix."""
    names = [c for c in wide.columns if c != row]
    listed = F.array(*[F.struct(F.lit(n).alias(column), col(n).alias(value)) for n in names])
    return wide.select(col(row), F.inline(listed)) if names else wide.select(col(row), F.lit(None).cast("string").alias(column), F.lit(0.0).alias(value)).limit(0)


def spread(scores: DataFrame, column: str, value: str) -> DataFrame:
    """For each candidate: rounds, least, greatest and mean score, and their standard deviation."""
    return scores.groupBy(column).agg(
        F.count(F.lit(1)).alias("rounds"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")
    )
