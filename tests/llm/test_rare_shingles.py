"""Links in crowded buckets do not depend on the buckets' sizes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tamis.llm import near_dup
from tamis.llm.shingles import minima, shingle_sets
from tests.llm.test_corpus_operators import _groups

N = 800


def _texts(seed):
    """Texts of 20 of 2000 words, and for every second one a copy with two words replaced."""
    rng = random.Random(seed)
    texts = {}
    for i in range(N):
        words = rng.sample(range(2000), 20)
        texts[2 * i] = " ".join(f"w{k}" for k in words)
        if i % 2:
            texts[2 * i + 1] = " ".join(f"w{k}" for k in [*words[:18], 2000 + i, 4000 + i])
    return texts


@pytest.mark.parametrize("crowded", [0, 1_000_000])
def test_true_links_of_crowded_buckets_are_found(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dup, "BLOCK", 1)
    monkeypatch.setattr(near_dup, "CROWDED", crowded)
    texts = _texts(1)
    values, offsets = shingle_sets([t.encode() for t in texts.values()], 1)
    sigs = minima(values, offsets, 4, 11).astype(np.uint8)
    at = {d: k for k, d in enumerate(texts)}
    # all copies have 18 of 22 words in common; those that agree on two of the four minima share a bucket and pass the test
    links = [(i, i + 1) for i in texts if i + 1 in at and i % 2 == 0 and (sigs[at[i]] == sigs[at[i + 1]]).sum() >= 2]
    assert len(links) > 300
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = near_dup.near_duplicates(docs, width=1, percent=80, bands=4, rows=1, least_agreeing=2)
    found = {r.doc_id: r.component_id for r in out.collect()}
    wanted = _groups(links, sorted(texts))
    assert {d: found[d] for pair in links for d in pair} == {d: wanted[d] for pair in links for d in pair}
    assert all(c in (d, d - 1) for d, c in found.items())


@pytest.mark.parametrize("percent", [50, 75, 80, 100])
def test_sets_at_the_limit_share_a_first_shingle(spark, percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(1, 60))
        sets += [base, base[rng.random(len(base)) < rng.uniform(0.5, 1)], np.concatenate([base, rng.integers(0, 1 << 63, rng.integers(0, 12))])]
    sets = [np.unique(s) for s in sets if len(s)]
    frame = spark.createDataFrame([(k, k, s.tolist()) for k, s in enumerate(sets)], "rep long, component long, shingles array<long>")
    counts = near_dup.rarity(frame)
    assert counts.sum() == sum(map(len, sets))
    held = [set() for _ in sets]
    for r in near_dup.rarest_shingles(frame, counts, percent).collect():
        held[r.rep].add(r.grp)
    linked = np.argwhere(near_dup.similar_sets(sets, percent))
    assert any(a < b for a, b in linked)
    assert all(held[a] & held[b] for a, b in linked if a < b)
