"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in a hashed order, form a stream of words that repeats without end.
The schedule is a row of slots of equal words; slot ``i`` maps the golden-ratio point ``(i + 1) / phi`` modulo 1
through the sources' cumulative shares, and the ``k``-th slot of a source takes the ``k``-th block of its stream.
Ranks come from counts per chunk of slots, so no task sees more than a chunk.  At the end, each source's last slot is
trimmed to its target, or a few closing slots fill what the points left open: a source gives its
target's words, rounded, and no more.

Size is the number of runs outside ``\\x20`` and ``\\x09``-``\\x0D``; null and empty texts have none and are never taken.
Very long texts are cut over as many slots as they reach into.  Sources are ordered by code point with null last; null is a source like any
other, and so is a null id an id.  Rows that repeat one source, id and text are counted first and laid in chunks of ``COPIES`` that have places of
their own, so no row or id that comes very often meets in one task; as they are alike, it does not matter which is which.  Ties of the hashed order
are broken by id, size and text.  Empty tables give empty results, and a source without words has target 0.  Only the named columns
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.llm.quality import words_of
from tamis.shared import col, materialise, unused

GOLDEN = 0x9E3779B97F4A7C15  # 2 ** 64 / phi, an odd number
CHUNK = 1 << 16
#: Repeats of one row that lie together.
COPIES = 1 << 10


def targets(sizes: Sequence[int], weights: Sequence[float], most_repeats: float = 3.0) -> list[float]:
    """Words for each source: all words shared by weight, none above ``most_repeats`` times its own.

    What a limited source cannot take is shared again by weight among the others.
    """
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most_repeats * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def points_to_sources(first: int, last: int, edges: np.ndarray) -> np.ndarray:
    """Source numbers of slots ``first`` to ``last - 1``; ``edges`` are cumulative shares times 2^64."""
    with np.errstate(over="ignore"):
        points = np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    return np.minimum(np.searchsorted(edges, points, side="right"), len(edges) - 1)


def schedule(spark: SparkSession, goals: Sequence[int], block: int) -> DataFrame:
    """Slots of ``block`` words that give each source its goal: ``slot``, ``source_no``, ``start``, ``words``.

    ``start`` counts words of the source's endless stream.
    """
    slots = sum(goals) // block
    shares = np.cumsum(np.array(goals, dtype=np.float64)) / max(1, sum(goals))
    edges = np.minimum(shares * 2.0**64, np.nextafter(2.0**64, 0)).astype(np.uint64)
    needed = [-(-g // block) for g in goals]
    chunks = spark.range(0, -(-slots // CHUNK), 1, max(1, min(4096, -(-slots // CHUNK))))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                yield chunk, points_to_sources(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), edges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, source in numbers(batches):
            which, n = np.unique(source, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(which), chunk)), pa.array(which.astype(np.int32)), pa.array(n.astype(np.int64))], names=["chunk", "source_no", "n"]
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, source in numbers(batches):
            order = np.argsort(source, kind="stable")
            sorted_ = source[order]
            starts = np.searchsorted(sorted_, sorted_, side="left")
            rank = np.empty(len(source), dtype=np.int64)
            rank[order] = np.arange(len(source)) - starts
            slot = chunk * CHUNK + np.arange(len(source))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(source), chunk)), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(rank)], names=["chunk", "slot", "source_no", "rank"]
            )

    counted = chunks.mapInArrow(count, "chunk bigint, source_no int, n bigint")
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("chunk", "source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    placed = chunks.mapInArrow(place, "chunk bigint, slot bigint, source_no int, rank bigint")
    ranked = placed.join(counted.drop("n"), ["chunk", "source_no"]).select("slot", "source_no", (F.col("rank") + F.col("base")).alias("rank"))

    wanted = spark.createDataFrame([(i, g, k) for i, (g, k) in enumerate(zip(goals, needed, strict=True))], "source_no int, goal bigint, needed bigint")
    given = counted.groupBy("source_no").agg(F.sum("n").alias("given"))
    short = wanted.join(given, "source_no", "left").where("needed > coalesce(given, 0)")
    closing = short.select("source_no", F.explode(F.sequence(F.coalesce("given", F.lit(0)), F.col("needed") - 1)).alias("rank"))
    closing = closing.select((F.lit(slots) + F.col("rank") * len(goals) + F.col("source_no")).alias("slot"), "source_no", "rank")

    start = F.col("rank") * block
    return (
        ranked.unionByName(closing)
        .join(_small(wanted, len(goals)), "source_no")
        .where("rank < needed")
        .select("slot", "source_no", start.alias("start"), F.least(F.lit(block), F.col("goal") - start).alias("words"))
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table with a row for each source is broadcast while it is small, and joined by shuffle beyond."""
    return F.broadcast(df) if rows <= 50_000 else df


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most_repeats: float = 3.0,
    block: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry_hash: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, source_size, target, taken, first_slot``.

    ``weights`` repeat over the sources in order.  ``taken`` counts the words that the mix takes of the document, repeats
    counted; ``first_slot`` is the first slot of the schedule that takes some (null: none).
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    sized = docs.select(
        col(id_col).alias("doc_id"),
        col(source_col).alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.xxhash64(col(text_col)).alias("text_hash"),
    )
    sized = sized.groupBy("source", "doc_id", "size", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    sized = materialise(sized, "mix-sizes")
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.sum("copies").alias("rows")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes, rows = [r["n"] for r in found], sum(r["rows"] for r in found)
    cycle = [weights[i % len(weights)] for i in range(len(found))]
    goal = targets(sizes, cycle, most_repeats)
    goals = [math.floor(g + 0.5) for g in goal]
    if block is None:
        block = max(1, min(1024, sum(sizes) // (4096 * max(1, len(found)))))
    sources = spark.createDataFrame(
        [(i, r["source"], n, g) for i, (r, n, g) in enumerate(zip(found, sizes, goal, strict=True))],
        f"source_no int, source_name {sized.schema['source'].dataType.simpleString()}, source_size bigint, target double",
    )
    named = sized.join(_small(sources, len(found)), F.col("source").eqNullSafe(F.col("source_name")))

    # offsets of the documents in their source's stream: sums inside hashed buckets, then over the buckets
    buckets = max(1, math.isqrt(rows))
    named = named.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    named = named.withColumn("copies", F.least(F.col("copies") - F.col("chunk") * COPIES, F.lit(COPIES)))
    named = named.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "chunk"))
    named = named.withColumn("bucket", F.pmod(F.shiftright("place", 20), F.lit(buckets)))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size", "text_hash", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = named.groupBy("source_no", "bucket").agg(F.sum(words).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    laid = named.withColumn("local", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(bases, ["source_no", "bucket"])
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    laid = laid.withColumn("lo", F.col("base") + F.col("local") + F.col("copy") * F.col("size")).withColumn("hi", F.col("lo") + F.col("size"))

    # slots and documents meet in cells of a block's words of the stream's first round
    slots = schedule(spark, goals, block).join(_small(sources.select("source_no", "source_size"), len(found)), "source_no")
    rounds = F.sequence(
        F.floor(F.col("start") / F.col("source_size")), F.floor((F.col("start") + F.col("words") - 1) / F.col("source_size"))
    )
    parts = slots.select("slot", "source_no", "source_size", "start", "words", F.explode(rounds).alias("round")).select(
        "slot",
        "source_no",
        F.greatest(F.col("start") - F.col("round") * F.col("source_size"), F.lit(0)).alias("slot_lo"),
        F.least(F.col("start") + F.col("words") - F.col("round") * F.col("source_size"), F.col("source_size")).alias("slot_hi"),
    )

    def cells(lo: str, hi: str):
        return F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))).alias("cell")

    parts = parts.select("slot", "source_no", "slot_lo", "slot_hi", cells("slot_lo", "slot_hi"))
    # slots of one cell that cover it alike are counted together, so a cell has few rows whatever the number of rounds
    edge = F.col("cell") * block
    parts = (
        parts.select("slot", "source_no", "cell", F.greatest("slot_lo", edge).alias("slot_lo"), F.least("slot_hi", edge + block).alias("slot_hi"))
        .groupBy("source_no", "cell", "slot_lo", "slot_hi")
        .agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot"))
    )
    pieces = laid.where("size > 0").select("source_no", "doc_id", "lo", "hi", cells("lo", "hi"))
    shared = F.least("hi", "slot_hi") - F.greatest("lo", "slot_lo")
    taken = (
        pieces.join(parts, ["source_no", "cell"])
        .where(shared > 0)
        .groupBy("source_no", "lo")  # a document with words has its place for itself
        .agg(F.sum(shared * F.col("times")).alias("taken"), F.min("slot").alias("first_slot"))
        .withColumnRenamed("lo", "at")
    )
    own = laid.join(taken.withColumnRenamed("source_no", "of"), (F.col("of") == F.col("source_no")) & (F.col("at") == F.col("lo")) & (F.col("size") > 0), "left")
    return own.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_slot",
        *([F.col("text_hash")] if carry_hash else []),
    )


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its words are taken, to the nearest whole number.

    Columns stay as they are.  Rows of equal id and text share what is taken of them evenly.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, carry_hash=True, **options)
    times = F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int")
    id_, hash_, times_, time = (unused(n, docs) for n in ("id", "hash", "times", "time"))
    copies = taken.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(times.alias(times_)).where(F.col(times_) > 0)
    joined = docs.join(copies, col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(col(text_col)) == F.col(hash_)))
    repeated = joined.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times_))))
    return repeated.select(*[col(c) for c in docs.columns])
