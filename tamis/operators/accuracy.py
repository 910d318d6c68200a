"""Predictions against ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.python import pair_scorer
from tamis.functions.similarity import PARTS, SECTIONS
from tamis.providers import Embedder

MEANS = (*SECTIONS, "overall")


def score_pairs(
    truth: DataFrame, predictions: DataFrame, key: str, json: str, embedder: Callable[[], Embedder] | None = None, assignment: str = "greedy"
) -> DataFrame:
    """``key, matched`` and a column for each section, part and ``overall``; zeros where the prediction is missing or does not parse.

    Truth that does not parse is left out.  Texts are compared letter by letter, or by the vectors of an ``embedder``; list items are
    matched greedily or by the least cost (``optimal``).
    """
    known = truth.where(F.try_parse_json(json).isNotNull()).select(key, F.col(json).alias("__truth"))
    given = predictions.select(F.col(key).alias("__key"), F.col(json).alias("__given"))
    pairs = known.join(given, F.col(key) == F.col("__key"), "left")
    valid = F.when(F.try_parse_json("__given").isNotNull(), F.col("__given"))
    scored = pairs.withColumn("s", pair_scorer(embedder, assignment)(F.col("__truth"), valid))
    return scored.select(
        key,
        F.col("__key").isNotNull().alias("matched"),
        *[F.coalesce(F.col("s")[n], F.lit(0.0)).alias(n.replace(".", "_")) for n in (*MEANS, *PARTS)],
    )


def accuracy_report(scores: DataFrame, key: str) -> DataFrame:
    """One row: files, matched and missing ones, and the mean of each section with missing ones as zeros."""
    return scores.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("missing"),
        *[F.avg(n).alias(n) for n in MEANS],
    )
