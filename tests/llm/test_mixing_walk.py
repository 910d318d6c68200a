"""The mix against a walk over the schedule, slot by slot and word by word."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm import mixing

GOLDEN = 0x9E3779B97F4A7C15


def _hashed(*values):
    """Spark's hash of a row: each value is hashed with the hash so far as its seed; nulls leave it alone."""
    h = 42
    for kind, value in values:
        if value is not None:
            raw = value.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", value)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - 2**64 if h >= 2**63 else h


def _walk(rows, block, copies=1 << 10):
    """A counter of (id, source, taken, first slot) by laying out every stream and walking every slot."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    words = {s: sum(size[r] for r in rows if r[2] == s) for s in names}
    goal = mixing.targets([words[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    goals = [math.floor(g + 0.5) for g in goal]
    total, buckets = sum(goals), max(1, math.isqrt(len(rows)))

    # streams: for each source its copies in order, and the copy of each word
    streams = {s: [] for s in names}
    for row, n in Counter(rows).items():
        text_hash = _hashed(("s", row[1]))
        for chunk in range(-(-n // copies)):
            place = _hashed(("i", 17), ("q", row[0]), ("q", text_hash), ("q", chunk))
            for k in range(min(copies, n - chunk * copies)):
                streams[row[2]].append(((place >> 20) % buckets, place, (row[0] is not None, row[0]), size[row], text_hash, chunk, k, row))
    owners = {}
    for s in names:
        streams[s].sort(key=lambda x: x[:7])
        owners[s] = [at for at, entry in enumerate(streams[s]) for _ in range(entry[3])]

    taken, first = defaultdict(Counter), defaultdict(dict)

    def take(slot, i, start, n):
        s = names[i]
        for w in range(start, start + n):
            at = owners[s][w % words[s]]
            taken[s][at] += 1
            first[s][at] = min(slot, first[s].get(at, slot))

    given, edges, upto = Counter(), [], 0.0
    for g in goals:
        upto += g
        edges.append(upto / max(1, total))
    slots = total // block
    for slot in range(slots):
        point = ((slot + 1) * GOLDEN) % 2**64 / 2**64
        i = next((k for k, edge in enumerate(edges) if point < edge), len(names) - 1)
        start = given[i] * block
        given[i] += 1
        if start < goals[i]:
            take(slot, i, start, min(block, goals[i] - start))
    for i, g in enumerate(goals):  # closing slots
        for rank in range(given[i], -(-g // block)):
            take(slots + rank * len(goals) + i, i, rank * block, min(block, g - rank * block))
    return Counter((streams[s][at][7][0], s, taken[s][at], first[s].get(at)) for s in names for at in range(len(streams[s])))


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix_is_its_walk(edge_docs, block):
    rows = [(r.doc_id, r.text, r.source) for r in edge_docs.select("doc_id", "text", "source").collect()]
    found = mixing.mix(edge_docs, block=block).collect()
    sources = defaultdict(set)
    for i, _, s in rows:
        sources[i].add(s)
    assert all(len(x) == 1 for x in sources.values())
    got = Counter((r.doc_id, *sources[r.doc_id], r.taken, r.first_slot) for r in found)
    assert got == _walk(rows, block)


def test_mix_of_whole_documents_is_its_walk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    source = {r[0]: r[2] for r in rows}
    got = Counter((r.doc_id, source[r.doc_id], r.taken, r.first_slot) for r in mixing.mix(docs, block=50).collect())
    assert got == _walk(rows, 50)


def test_mix_of_repeated_rows_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 8)
    docs = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, F.lit(1).cast("long")).alias("doc_id"),
        F.when(F.col("id") < 400, F.lit("one row that repeats")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") % 3 == 2, "a").otherwise("b").alias("source"),
    )
    rows = [tuple(r) for r in docs.collect()]
    found = mixing.mix(docs, block=3)
    wanted = Counter()
    for (i, _, t, f), n in _walk(rows, 3, copies=8).items():
        wanted[i, t, f] += n
    assert Counter((r.doc_id, r.taken, r.first_slot) for r in found.collect()) == wanted
    assert found.count() == 500


def test_kept_mix_lets_other_columns_be(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y", "s", 1, 2, 3, 4) for i in range(20)], "doc_id long, text string, source string, id int, hash int, times int, time int")
    kept = mixing.keep_mixed(docs)
    assert kept.columns == docs.columns and kept.distinct().count() == 20
