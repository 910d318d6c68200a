"""Histogram sort: shards of near-equal bytes by exact counts below candidate key boundaries.

A row's key has three parts: a hash of its text, a hash of its id, and a number of its own.  So equal texts stand together, a
group of copies that is too large for the tolerance can be cut between its documents, and rows that repeat one id and text can be cut
apart.  Rounds of exact byte counts by prefixes of a part narrow each splitter down; a splitter takes the nearest boundary
between texts if that is within tolerance of its goal, else between ids, else between rows.  A round sends a bounded number of counts
to the driver, whatever the table's size.  Then the rows are exchanged once, by ranges of the key, and get their slots.

A null text has no bytes (size 1) and CRC 0, like an empty one.  Null ids are ids like any other.  Very long texts are rows like any other: a shard
can be off by half of the row that stands on its border.  Repeated rows are alike, so it does not matter which of them falls on which side
of a cut; ties in size mean nothing.  An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.shared import col, discard, materialise, unused

BITS = 63
COUNTS = 1 << 17
PARTS = ("key", "id_key", "row_key")


def key_of(value: Column) -> Column:
    """A part of the sort key, from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(value), 1)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32`` and the parts of the key of each row."""
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        key_of(text).alias("key"),
        key_of(col(id_col)).alias("id_key"),
        key_of(F.monotonically_increasing_id()).alias("row_key"),
    )


def _counts(rows: DataFrame, before: tuple[str, ...], part: str, known: int, rest: int, wanted: set[tuple[tuple[int, ...], int]]) -> dict:
    """For each head, sorted ``bin, bytes, least, greatest`` of the bins below the wanted prefixes: at most ``COUNTS`` rows."""
    if before:
        heads = [F.struct(*[F.lit(v).cast("long") for v in head]) for head in sorted({head for head, _ in wanted})]
        rows = rows.where(F.struct(*before).isin(heads))
    if known:
        rows = rows.where(F.shiftright(part, BITS - known).isin(sorted({prefix for _, prefix in wanted})))
    bins = rows.groupBy(*before, F.shiftright(part, rest).alias("bin")).agg(F.sum("size").alias("n"), F.min(part).alias("lo"), F.max(part).alias("hi"))
    out: dict[tuple, list] = {}
    for r in bins.collect():
        out.setdefault(tuple(r[: len(before)]), []).append(tuple(r[len(before) :]))
    return {head: np.array(sorted(found), dtype=np.int64) for head, found in out.items()}


def cuts(rows: DataFrame, goals: list[int], tolerances: list[float], parts: tuple[str, ...] = PARTS) -> list[tuple[int, ...]]:
    """For each goal a least key of what lies above: as many bytes lie below, to the goal's tolerance or half a row.

    A key is a tuple of the parts; a cut between two values of a part has 0 in the later parts.
    """

    def cut(head: tuple[int, ...], value: int) -> tuple[int, ...]:
        while value >= 1 << BITS and head:  # above all values of a part: at the next one of the part before
            head, value = head[:-1], head[-1] + 1
        return (*head, value, *[0] * (len(parts) - len(head) - 1))

    found: list[tuple[int, ...]] = [()] * len(goals)
    heads = {i: ((), 0) for i in range(len(goals))}  # goal -> (values of the parts so far, bytes below them)
    for n, part in enumerate(parts):
        last_part = n == len(parts) - 1
        places = {i: (head, 0, below) for i, (head, below) in heads.items()}  # ..., a prefix of this part, bytes below it
        heads, known = {}, 0
        while places:
            wanted = {(head, prefix) for head, prefix, _ in places.values()}
            more = min(BITS - known, max(1, (COUNTS // len(wanted)).bit_length() - 1), 16)
            rest = BITS - known - more
            counted = _counts(rows, parts[:n], part, known, rest, wanted)
            deeper = {}
            for i, (head, prefix, below) in places.items():
                bins = counted.get(head, np.empty((0, 4), np.int64))
                lo, hi = np.searchsorted(bins[:, 0], [prefix << more, (prefix + 1) << more])
                ends = below + np.cumsum(bins[lo:hi, 1])
                k = int(np.searchsorted(ends, goals[i]))
                if k >= hi - lo:  # the goal is all that lies below the end of this prefix, or there is nothing
                    found[i] = cut(head, (prefix + 1) << (BITS - known))
                    continue
                bin_, size, least, greatest = bins[lo + k].tolist()
                end = int(ends[k])
                near = min((abs(end - goals[i]), (bin_ + 1) << rest), (abs(goals[i] - end + size), bin_ << rest))
                if near[0] <= tolerances[i] or (least == greatest and last_part):
                    found[i] = cut(head, near[1])
                elif least == greatest:  # one value of this part: go on inside it
                    heads[i] = ((*head, least), end - size)
                else:
                    deeper[i] = (head, bin_, end - size)
            places, known = deeper, known + more
    return found


def splitters(keys: DataFrame, goals: list[int], tolerances: list[float]) -> list[int]:
    """As :func:`cuts`, for rows ``key, size`` whose key has one part."""
    return [cut for (cut,) in cuts(keys, goals, tolerances, ("key",))]


def shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32``, the key's parts, ``range_no, shard, slot`` of each row; all of ``shard`` have near-equal bytes.

    ``tolerance`` is a share of a shard's bytes.  ``slot`` numbers a shard's rows from 0 in the order of the key.
    """
    rows = materialise(keyed(docs, id_col, text_col), "shard-keys")
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    # a shard is exchanged as several ranges, so that no task holds a whole one
    parts = max(1, min(256, -(-total["rows"] // (4096 * n_shards))))
    n_ranges = parts * n_shards
    goals = [total["size"] * i // n_ranges for i in range(1, n_ranges)]
    exact, loose = tolerance * total["size"] / n_shards, 0.25 * total["size"] / n_ranges
    edges = sorted(cuts(rows, goals, [min(exact, loose) if i % parts == 0 else loose for i in range(1, n_ranges)]))
    firsts = np.array([min(edge[0], (1 << BITS) - 1) for edge in edges], dtype=np.int64)

    def number(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for key, id_key, row_key in frames:
            first = key.to_numpy()
            out = np.searchsorted(firsts, first, side="left")
            for k in np.flatnonzero(np.isin(first, firsts)):  # rows of a text that a cut may part
                out[k] = bisect.bisect_right(edges, (int(first[k]), int(id_key.iloc[k]), int(row_key.iloc[k])))
            yield pd.Series(out.astype(np.int32))

    placed = materialise(rows.withColumn("range_no", F.pandas_udf(number, "int")(*PARTS)), "shard-ranges")
    discard(rows)
    held = dict(placed.groupBy("range_no").count().collect())  # a row for each range
    before = [0] * n_ranges
    for i in range(n_ranges):
        before[i] = 0 if i % parts == 0 else before[i - 1] + held.get(i - 1, 0)
    offsets = F.array(*[F.lit(n).cast("long") for n in before])
    order = Window.partitionBy("range_no").orderBy(*PARTS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        *PARTS,
        "range_no",
        F.floor(F.col("range_no") / parts).cast("int").alias("shard"),
        (F.get(offsets, F.col("range_no")) + F.row_number().over(order) - 1).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` written below ``path`` as ``shard=0`` and so on, each file sorted by the key's parts of text and id.

    Rows that repeat one id and text over several ranges are dealt to them by a hash, in proportion.
    """
    placed = shard(docs, n_shards, id_col=id_col, text_col=text_col)
    counts = placed.groupBy("key", "id_key", "range_no", "shard").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.groupBy("key", "id_key").agg(F.array_sort(F.collect_list(F.struct("range_no", "shard", "n"))).alias("ranges"))  # as many as ranges
    text_key, id_key, range_, at = (unused(n, docs) for n in ("text_key", "id_key", "range", "at"))
    ranges = ranges.select(F.col("key").alias(text_key), F.col("id_key").alias(id_key), F.col("ranges").alias(range_))
    whole = docs.withColumns({text_key: key_of(F.coalesce(col(text_col), F.lit(""))), id_key: key_of(col(id_col)), at: key_of(F.monotonically_increasing_id())})
    total = F.aggregate(range_, F.lit(0).cast("long"), lambda sum_, r: sum_ + r["n"])
    # the first range whose rows and those of the ranges before it go beyond this row's place
    chosen = F.aggregate(
        range_,
        F.struct(F.pmod(F.col(at), total).alias("left"), F.lit(None).cast("int").alias("range_no"), F.lit(None).cast("int").alias("shard")),
        lambda now, r: F.when(now["range_no"].isNotNull(), now)
        .when(now["left"] < r["n"], F.struct(now["left"].alias("left"), r["range_no"].alias("range_no"), r["shard"].alias("shard")))
        .otherwise(F.struct((now["left"] - r["n"]).alias("left"), now["range_no"].alias("range_no"), now["shard"].alias("shard"))),
    )
    dealt = whole.join(ranges, [text_key, id_key]).withColumn(range_, chosen).withColumn("shard", F.col(range_)["shard"]).withColumn(range_, F.col(range_)["range_no"])
    ordered = dealt.repartition(range_).sortWithinPartitions(range_, text_key, id_key)
    ordered.drop(range_, text_key, id_key, at).write.mode("overwrite").partitionBy("shard").parquet(path)
