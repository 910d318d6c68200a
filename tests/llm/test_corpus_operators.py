"""Mixing, sharding, near duplicates, components and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import components, mixing, near_dup, quality, registry, secret_scan, sharding
from tests.llm.conftest import prose

# -- mixing ---------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100], [5, 2]) == pytest.approx([200 * 5 / 7, 200 * 2 / 7])
    assert mixing.targets([10, 1000, 1000], [5, 2, 1]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([0, 7], [5, 2]) == [0.0, 7.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0.0, 0.0]
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 1, 10, 1000, 100000]) for _ in range(rng.randrange(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        found = mixing.targets(sizes, weights)
        assert sum(found) == pytest.approx(sum(sizes)) and all(t <= 3 * n + 1e-6 for t, n in zip(found, sizes, strict=True))
        units = {round(t / w, 6) for t, w, n in zip(found, weights, sizes, strict=True) if t < 3 * n - 1e-6}
        assert len(units) <= 1  # those below their limit share by weight


def _mixed_by_brute_force(rows, block):
    """Words of each (id, text) taken by laying the streams out and walking the schedule slot by slot."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in rows:
        sizes[r.source] += 0
    names = sorted(sizes, key=lambda s: (s is None, s))
    goal = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    goals = [int(g + 0.5) for g in goal]
    total = sum(goals)
    given = Counter()
    for slot in range(total // block):
        point = ((slot + 1) * mixing.GOLDEN) % 2**64 / 2**64
        upto, which = 0.0, len(names) - 1
        for i, g in enumerate(goals):
            upto += g / total
            if point < upto:
                which = i
                break
        given[which] = min(goals[which], given[which] + block)
    for i, g in enumerate(goals):
        given[i] = g  # closing slots
    return names, goal, goals, given


@pytest.mark.parametrize("block", [1, 7, None])
def test_mixing(edge_docs, block):
    rows = edge_docs.collect()
    names, goal, goals, given = _mixed_by_brute_force(rows, block or 1)
    found = mixing.mix(edge_docs, block=block, carry_hash=True).collect()
    assert len(found) == len(rows)
    again = mixing.mix(edge_docs, block=block, carry_hash=True).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.target == pytest.approx(goal[names.index(s)])
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0) == (r.first_slot is None)
        taken[s] += r.taken
    for i, s in enumerate(names):
        assert taken[s] == given[i] == goals[i]


def test_mixing_schedule_is_even(spark):
    goals, block = [50_000, 20_000, 10_000], 10
    slots = mixing.schedule(spark, goals, block).collect()
    for i, g in enumerate(goals):
        own = sorted((r.slot, r.start, r.words) for r in slots if r.source_no == i)
        assert [s for _, s, _ in own] == list(range(0, g, block)) and sum(w for *_, w in own) == g
    for part in range(0, 8000, 1000):  # every stretch has the sources in proportion
        counts = Counter(r.source_no for r in slots if part <= r.slot < part + 1000)
        assert all(abs(counts[i] - 1000 * g / 80_000) < 5 for i, g in enumerate(goals))


def test_mixing_keeps_columns(edge_docs, no_docs):
    kept = mixing.keep_mixed(edge_docs)
    assert kept.columns == edge_docs.columns
    copies = Counter(r.doc_id for r in kept.collect())
    words = defaultdict(int)
    size = defaultdict(int)
    for r in mixing.mix(edge_docs).collect():
        words[r.doc_id] += r.taken
        size[r.doc_id] += r.size
    rows = Counter(r.doc_id for r in edge_docs.collect())
    for i in rows:
        times = int(words[i] / max(1, size[i]) + 0.5)
        assert copies[i] == rows[i] * times or i is None  # a null id joins to itself
    assert mixing.mix(no_docs).count() == 0 and mixing.keep_mixed(no_docs).count() == 0


# -- sharding -------------------------------------------------------------------


def _check_shards(found, texts, n):
    largest = max((r.size for r in found), default=0)
    total = sum(r.size for r in found)
    held, slots, groups = Counter(), defaultdict(list), defaultdict(list)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        held[r.shard] += r.size
        slots[r.shard].append((r.slot, r.key))
        groups[r.text_crc32].append(r.shard)
    for s, own in slots.items():
        own.sort()
        assert [i for i, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own), s
    assert set(held) <= set(range(n))
    return held, total, largest


def test_sharding_is_even(spark):
    rows = [(i, prose(20 + i % 50, i % 400 if i % 3 else 0)) for i in range(6000)]  # a third are copies of one another
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, total, largest = _check_shards(sharding.shard(docs, 16).collect(), dict(rows), 16)
    assert len(held) == 16 and all(abs(b - total / 16) <= largest + 2e-4 * total / 16 for b in held.values())


def test_sharding_edges(known_docs, edge_docs, no_docs, tmp_path):
    texts = {r.doc_id: r.text for r in known_docs.collect()}
    _check_shards(sharding.shard(known_docs, 4).collect(), texts, 4)
    assert sharding.shard(edge_docs, 16).count() == edge_docs.count()
    assert sharding.shard(no_docs, 16).count() == 0
    sharding.write_shards(known_docs, str(tmp_path / "out"), 3)
    written = known_docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert set(written.columns) == {*known_docs.columns, "shard"} and written.count() == known_docs.count()


def test_splitters_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2**63) if i % 2 else 12345 << 20, rng.randrange(1, 1000)) for i in range(2000)]
    keys = spark.createDataFrame(rows, "key long, size long")
    total = sum(n for _, n in rows)
    for tolerance in (0.0, total / 100):
        goals = [total * i // 8 for i in range(1, 8)]
        for cut, goal in zip(sharding.splitters(keys, goals, [tolerance] * 7), goals, strict=True):
            below = sum(n for k, n in rows if k < cut)
            best = min(abs(goal - sum(n for k, n in rows if k < c)) for c in {k for k, _ in rows} | {2**63})
            assert abs(below - goal) <= max(tolerance, best)


# -- near duplicates ------------------------------------------------------------


def _sets(texts, width):
    out = {}
    for i, t in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    return out


def _groups(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def _near_by_brute_force(texts, width, percent):
    sets = _sets(texts, width)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, _groups(links, ids)


def _near_texts():
    rng, texts = random.Random(8), {}
    for g in range(12):
        base = prose(60 + 10 * g, g).split()
        for _ in range(12 if g else 60):  # a large group of drifting copies, and small ones
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
            if rng.random() < 0.3:
                base = words
    texts |= {900: None, 901: "", 902: " ", 903: "One", 904: "one", 905: "two words", 906: "TWO\nwords", 907: texts[3], 908: texts[3].upper()}
    return texts


@pytest.mark.parametrize(("width", "block"), [(2, 256), (2, 5), (5, 8)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = _near_texts()
    sets, groups = _near_by_brute_force(texts, width, 80)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in near_dup.near_duplicates(docs, width=width).collect()}
    assert {i: r.component_id for i, r in found.items()} == groups
    assert all(r.n_shingles == len(sets[i]) and r.kept == (groups[i] == i) for i, r in found.items())


def test_near_duplicates_edges(edge_docs, known_docs, no_docs):
    texts = {r.doc_id: r.text for r in known_docs.collect()}
    _, groups = _near_by_brute_force(texts, 5, 80)
    rows = near_dup.near_duplicates(known_docs).collect()
    assert len(rows) == known_docs.count() and all(r.component_id == groups[r.doc_id] for r in rows)
    every = near_dup.near_duplicates(edge_docs).collect()
    assert len(every) == edge_docs.count() and all(r.component_id == (groups[r.doc_id] if r.doc_id is not None else None) for r in every)
    assert all(r.kept for r in every if r.doc_id is None)
    assert near_dup.near_duplicates(no_docs).count() == 0
    kept = near_dup.keep_firsts(known_docs)
    assert kept.columns == known_docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in groups.items() if i == g}


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    for n, edges in ((300, 200), (300, 280), (50, 400)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(200)]
        nodes = {x for a, b in links for x in (a, b) if a != b}
        groups = _groups(links, nodes | {a for a, _ in links})
        found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert found == {x: groups[x] for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- queries and pipeline -------------------------------------------------------


def test_registered_queries(spark, sf_dir):
    shards = registry.QUERIES["op3_histogram_shards"](spark, sf_dir)
    assert [n for n, _ in shards.dtypes][:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    for name in ("op2_mix_sources", "op8_near_duplicates"):
        assert registry.QUERIES[name](spark, sf_dir).count() == 200
    assert shards.where("law = 'bytes' AND grown_shard IS NULL").count() == 200


def test_pipeline_by_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        results.append((name, before.collect(), docs.collect()))
        assert name == "byte_bpe" or docs.columns == columns
    steps = {name: (a, b) for name, a, b in results}
    a, b = steps["quality_rules"]
    verdicts = {r.doc_id: r.kept for r in quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert {r.doc_id for r in b} == {r.doc_id for r in a if verdicts[r.doc_id]}
    a, b = steps["minhash_near_dedup"]
    _, groups = _near_by_brute_force({r.doc_id: r.text for r in a}, 5, 80)
    assert sorted(r.doc_id for r in b) == sorted(i for i, g in groups.items() if i == g)
    a, b = steps["secret_scans"]
    assert {r.doc_id: r.text for r in b} == {r.doc_id: secret_scan.masked(r.text) for r in a}
    assert all(r.n_chars == len(r.text) for r in b) and not any(secret_scan.base_spans(r.text) for r in b)
    a, b = steps["mix_sources"]
    sizes = Counter()
    for r in a:
        sizes[r.source] += len(r.text.split())
    goal = dict(zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)], [(5, 2, 1)[i % 3] for i in range(len(sizes))]), strict=True))
    largest = max(len(r.text.split()) for r in a)
    for s in sizes:
        assert abs(sum(len(r.text.split()) for r in b if r.source == s) - goal[s]) <= largest
    a, b = steps["byte_bpe"]
    assert Counter((r.doc_id, r.decoded_sha256) for r in b) == Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in a)
    assert all(r.n_tokens == len(r.ids) for r in b)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in b)
