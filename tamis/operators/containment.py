"""Which passages stand in which texts, word by word, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import let, words_only
from tamis.shared import materialise

ANCHOR = 3


def _windows(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words of an array."""
    grams = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))
    return F.slice(grams, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def contained_passages(
    texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, most_bytes: int = 8 << 20
) -> DataFrame:
    """``text_id, passage_id`` where the passage's words stand in the text's words, as a substring.

    A passage may begin and end inside a word of the text, but the words between its first and last one are whole. Three of them
    are its anchor. Only hashes of anchors are exploded and met with those of the passages; the texts come back to the pairs that are left,
    which are written in between. Passages of fewer than five words have no anchor; they are compared with all texts, in broadcast
    blocks, as a fixed list of queries. A broadcast side holds at most ``most_bytes``; beyond it the join is shuffled, or there are
    more blocks.
    """
    known = passages.select(F.col(passage_id), words_only(F.col(passage)).alias("__p")).where("__p <> ''").withColumn("__w", F.split("__p", " "))
    anchor = F.xxhash64(*[F.get("__w", F.lit(k)) for k in range(1, ANCHOR + 1)]).alias("__anchor")
    anchored = known.where(F.size("__w") >= ANCHOR + 2).select(passage_id, "__p", anchor)
    short = known.where(F.size("__w") < ANCHOR + 2).select(passage_id, "__p")
    source = texts.select(F.col(text_id), F.col(text).alias("__t"))
    words = F.split(words_only(F.col("__t")), " ")
    anchors = F.explode(let(words, lambda w: F.array_distinct(_windows(w, ANCHOR)))).alias("__anchor")
    opened = source.select(text_id, anchors).join(_bounded(anchored.select("__anchor", passage_id), F.lit(40), most_bytes), "__anchor")
    pairs = materialise(opened.select(F.col(text_id).alias("__id"), F.col(passage_id)), "anchor-pairs")
    inside = F.contains(words_only(F.col("__t")), F.col("__p"))
    met = source.join(_bounded(pairs, F.lit(40), most_bytes), F.col(text_id).eqNullSafe(F.col("__id")))
    size = F.octet_length("__p") + 40
    found = met.join(_bounded(anchored.select(passage_id, "__p"), size, most_bytes), passage_id).where(inside).select(text_id, passage_id)
    n_blocks = -(-_weight(short, size) // most_bytes)
    for b in range(n_blocks):  # a fixed list of queries against all texts, a bounded block at a time
        block = short.where(F.pmod(F.xxhash64(passage_id), F.lit(n_blocks)) == b)
        found = found.unionByName(source.join(F.broadcast(block), inside).select(text_id, passage_id))
    return found.distinct()


def _weight(rows: DataFrame, size: Column) -> int:
    return rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def _bounded(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """``rows`` to be broadcast if their bytes, ``size`` each, are not over ``most``."""
    return F.broadcast(rows) if _weight(rows, size) <= most else rows
