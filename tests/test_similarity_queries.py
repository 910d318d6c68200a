"""Queries that SQL cannot express, against plain recomputations over whole small tables."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from difflib import SequenceMatcher

import pytest

from tamis import queries


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def _like(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return float(a == b) if not a or not b or a == b else _ratio(a, b)


@pytest.fixture(scope="module")
def turns(spark, sf_dir):
    """Texts of each conversation in the order of their turns."""
    out = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.text))
    return out


def _run(name, spark, sf_dir):
    return queries.QUERIES[name](spark, sf_dir).collect()


def test_sequence_ratios(spark, sf_dir, turns):
    wanted = {(c, t): _ratio(before, text) for c, own in turns.items() for (_, before), (t, text) in itertools.pairwise(own) if text is not None and before is not None}
    found = {(r.conv_id, r.turn): r.ratio for r in _run("sequence_ratios", spark, sf_dir)}
    assert found == pytest.approx(wanted)


def test_medoid_consensus(spark, sf_dir, turns):
    for r in _run("medoid_consensus", spark, sf_dir):
        own = [(t, x) for t, x in turns[r.conv_id] if x is not None]
        means = [sum(_ratio(a, b) for j, (_, b) in enumerate(own) if i != j) / (len(own) - 1) for i, (_, a) in enumerate(own)] if len(own) > 1 else [1.0]
        best = means.index(max(means))
        assert (r.n_runs, r.turn) == (len(own), own[best][0]) and r.consensus == pytest.approx(means[best])


def _matched(a, b, threshold, pairs):
    sims = [_like(a[i], b[j]) for i, j in pairs]
    good = [s for s in sims if s >= threshold]
    if not good:
        return 0.0
    precision, recall = len(good) / len(b), len(good) / len(a)
    return 2 * precision * recall / (precision + recall) * sum(good) / len(good)


def test_assignment_f1(spark, sf_dir, turns):
    checked = 0
    texts = {(c, t): (before, text) for c, own in turns.items() for (_, before), (t, text) in itertools.pairwise(own)}
    for r in _run("assignment_f1", spark, sf_dir):
        a, b = (x.split("\n") for x in texts[r.conv_id, r.turn])
        left, greedy = sorted(((1 - _like(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b))), []
        while left:
            _, i, j = left[0]
            greedy.append((i, j))
            left = [x for x in left if x[1] != i and x[2] != j]
        assert r.greedy == pytest.approx(_matched(a, b, 0.3, greedy))
        if max(len(a), len(b)) <= 6:
            checked += 1
            n = min(len(a), len(b))
            ways = ([*zip(range(n), p, strict=True)] if len(a) <= len(b) else [*zip(p, range(n), strict=True)] for p in itertools.permutations(range(max(len(a), len(b))), n))
            costs = [(sum(1 - _like(a[i], b[j]) for i, j in w), w) for w in ways]
            least = min(c for c, _ in costs)
            assert any(r.optimal == pytest.approx(_matched(a, b, 0.3, w)) for c, w in costs if c <= least + 1e-9)
    assert checked


@pytest.mark.parametrize("name", ["json_pair_score", "embedding_pair_score"])
def test_pair_scores(spark, sf_dir, name):
    nation = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    customers = {r.c_custkey: r for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    found = _run(name, spark, sf_dir)
    assert {r.c_custkey for r in found} == set(customers)
    for r in found:
        i, place = r.c_custkey, nation[customers[r.c_custkey].c_nationkey]
        assert r.matched == (i % 13 != 0)
        if i % 13 == 0 or i % 17 == 0:
            assert r.overall == 0.0
            continue
        assert (r.position_applied, r.basic_information_email, r.basic_information_phone, r.education_background, r.projects, r.certifications) == pytest.approx((1,) * 6)
        near = _like(place, place + " City") if i % 4 == 0 else 1.0
        if name == "json_pair_score":
            assert r.basic_information_location == pytest.approx(near) and r.skills_and_specialties == 1.0
            assert r.self_evaluation == pytest.approx(_like(f"I work in {place}", f"I work in {place} City") if i % 4 == 0 else 1.0)
        else:
            assert (r.basic_information_location < 1) == (i % 4 == 0)
        parts = (r.position_applied, r.self_evaluation, r.basic_information, r.skills_and_specialties, r.certifications, r.languages, r.work_experience, r.education_background, r.projects)
        assert r.overall == pytest.approx(sum(parts) / 9) and 0.5 < r.overall <= 1


def test_accuracy_report(spark, sf_dir):
    rows = _run("json_pair_score", spark, sf_dir)
    (report,) = _run("accuracy_report", spark, sf_dir)
    assert (report.files, report.matched) == (len(rows), sum(r.matched for r in rows)) and report.missing == report.files - report.matched
    assert report.overall == pytest.approx(sum(r.overall for r in rows) / len(rows)) and report.languages == pytest.approx(sum(r.languages for r in rows) / len(rows))


def test_clean_page_text(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in _run("clean_page_text", spark, sf_dir):
        text = unicodedata.normalize("NFC", html.unescape(pages[r.page_id] or ""))
        text = re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", re.sub(r"<[^>]+>", " ", text))
        text = re.sub(r"[*_#`|~>•]", " ", re.sub("[–—−]", "-", text)).lower()
        assert r.clean == " ".join(text.split())
