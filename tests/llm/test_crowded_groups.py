"""Buckets and clusters of very many members."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import near_dup
from tests.llm.test_corpus_operators import _groups


def _signatures(n, planted, seed, common=0.6):
    """Signatures of which two agree on about 47 of 128 places, and pairs that agree on 110 of 128."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, 128, dtype=np.uint8)
    sigs = np.where(rng.random((n, 128)) < common, base, rng.integers(0, 256, (n, 128), dtype=np.uint8)).astype(np.uint8)
    pairs = [(2 * k, 2 * k + 1) for k in range(planted)]
    for a, b in pairs:
        sigs[b] = sigs[a]
        sigs[b, rng.choice(128, 18, replace=False)] += 1
    return sigs, pairs


def _members(spark, sigs, grp=5):
    n = len(sigs)
    rows = [(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)]
    frame = spark.createDataFrame(rows, "rep long, sig binary")
    return frame.select(F.lit(grp).cast("long").alias("grp"), F.lit(-(-n // near_dup.BLOCK)).alias("parts"), "rep", "sig")


def _linked(spark, sigs, monkeypatch, grps=1):
    dealt, plain = [], near_dup._linked

    def counted(placed, kernel):
        dealt.append(placed.count())
        return plain(placed, kernel)

    monkeypatch.setattr(near_dup, "_linked", counted)
    members = _members(spark, sigs, 0)
    for g in range(1, grps):
        members = members.unionByName(_members(spark, sigs, g))
    found = near_dup.link_groups(members, "sig", near_dup.link_signatures(80), near_dup.by_further_minima)
    out = {r.node: r.component for r in found.collect()}
    monkeypatch.setattr(near_dup, "_linked", plain)
    return out, sum(dealt)


def test_crowded_bucket_takes_near_linear_work(spark, monkeypatch):
    # a bucket of 50,000 signatures that do not link, but for planted pairs; 32 such buckets share a pair in production, here four
    sizes = {}
    for n in (12_500, 50_000):
        sigs, pairs = _signatures(n, 200, n)
        found, sizes[n] = _linked(spark, sigs, monkeypatch)
        wanted = {x: a for a, b in pairs for x in (a, b)}
        assert set(found.items()) <= set(wanted.items())
        assert len(found) >= 0.9 * len(wanted)  # one bucket of the many that a pair shares
    assert sizes[50_000] < 8 * sizes[12_500] and sizes[50_000] < 40 * 50_000


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    sigs, pairs = _signatures(600, 100, 3)
    found, _ = _linked(spark, sigs, monkeypatch, grps=13)  # as many as a pair at the limit is expected to share
    assert found == {x: a for a, b in pairs for x in (a, b)}


@pytest.mark.parametrize("crowded", [0, 8])
def test_crowded_groups_by_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "CROWDED", crowded)
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(60)]
    texts = {}
    for i in range(120):  # texts that share half of their words, and some with a near copy
        words = shared + [f"u{i}x{k}" for k in range(60)]
        texts[2 * i] = " ".join(words)
        if rng.random() < 0.5:
            words[rng.randrange(60, 120)] = "other"
            texts[2 * i + 1] = " ".join(words)
    links = [(i, i + 1) for i in texts if i % 2 == 0 and i + 1 in texts]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, width=2).collect()}
    assert found == _groups(links, sorted(texts))
