"""Shards of groups of copies, repeated rows and rows without ids."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tamis.llm import sharding
from tests.llm.conftest import prose


def _shards(docs, n):
    rows = sharding.shard(docs, n).collect()
    held, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[r.key].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return rows, held, groups


def test_repeated_rows_are_split(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text that all rows repeat").alias("text"))
    rows, held, _ = _shards(docs.unionByName(spark.createDataFrame([(None, None)] * 3 + [(None, "")] * 2, "doc_id long, text string")), 16)
    goal = sum(held.values()) / 16
    assert len(held) == 16 and all(abs(n - goal) <= 0.002 * goal + 30 for n in held.values())
    again = Counter((r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard(docs, 16).collect())
    assert again == Counter((r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard(docs, 16).collect())


def test_texts_are_cut_only_where_tolerance_demands_it(spark):
    rng = random.Random(2)
    rows = []
    for g in range(4000):  # groups of copies, one of them with a third of all rows
        text = prose(5 + g % 30, g)
        rows += [(len(rows) + k, text) for k in range(4000 if g == 5 else rng.choice([1, 1, 2, 3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found, held, groups = _shards(docs, 16)
    goal = sum(held.values()) / 16
    assert all(abs(n - goal) <= 0.002 * goal + max(r.size for r in found) for n in held.values())
    sizes = defaultdict(int)
    for r in found:
        sizes[r.key] += r.size
    cut = [k for k, shards in groups.items() if len(shards) > 1]
    # a group is cut only if both of its ends are further from the border than the tolerance
    assert all(sizes[k] > 2 * 1e-3 * goal for k in cut) and len(cut) <= 16
    largest = max(sizes, key=sizes.get)
    assert len(groups[largest]) > 3


def test_no_group_is_cut_where_a_border_between_texts_is_near(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 4}") for i in range(64_000)], "doc_id long, text string")
    _, held, groups = _shards(docs, 16)
    goal = sum(held.values()) / 16
    assert all(abs(n - goal) <= 0.002 * goal for n in held.values())
    assert not [k for k, shards in groups.items() if len(shards) > 1]


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(1, "same", i, i) for i in range(3000)] + [(i, prose(4, i), 0, 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `range` int, at int")
    sharding.write_shards(docs, str(tmp_path / "out"), 8)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, written.select(*docs.columns).collect())) == sorted(rows)
    sizes = Counter()
    for r in written.collect():
        sizes[r.shard] += len(r.text) + 1
    goal = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(n - goal) < 0.15 * goal for n in sizes.values())
