"""Operators on small frames, with the goldens of the scoring model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tamis.config import CATEGORIES, Settings
from tamis.operators import accuracy, consistency, criteria, extract, ordering, scoring, sections
from tamis.operators.containment import contained_passages
from tamis.providers import STAND_IN_SCORES

GOLDEN = [STAND_IN_SCORES[c] for c in CATEGORIES]


def _scored(spark, scores, present=(True,) * 5, failed=(False,) * 5):
    grid = scoring.category_grid(spark.createDataFrame([("r",)], "k string"), "k")
    rows = spark.createDataFrame(list(zip(CATEGORIES, scores, present, failed, strict=True)), "category string, score int, present boolean, failed boolean")
    return scoring.redistribute(grid.join(rows, "category"), "k", "present")


@pytest.mark.parametrize(
    ("present", "failed", "total", "bucket"),
    [
        ((True,) * 5, (False,) * 5, 85.5, "STRONG_MATCH"),
        ((True, True, True, False, True), (False,) * 5, 84.7, "POTENTIAL_MATCH"),
        ((True,) * 5, (True, False, False, False, False), 0.0, "REJECT"),
        ((False,) * 5, (False,) * 5, 0.0, "REJECT"),
    ],
)
def test_totals(spark, present, failed, total, bucket):
    scored = _scored(spark, GOLDEN, present, failed)
    row = scoring.weighted_totals(scored, "k").first()
    assert (row.overall_score, row.recommendation) == (total, bucket)
    weights = {r.category: r.weight for r in scoring.category_results(scored, "k").collect()}
    expected = {True: [0.22, 0.22, 0.22, 0.22, 0.12], False: [0.275, 0.275, 0.275, 0.0, 0.175]}[present.count(True) != 4]
    assert [weights[c] for c in CATEGORIES] == pytest.approx(expected)


@pytest.mark.parametrize(("total", "rounded", "bucket"), [(54.95, 55.0, "LOW_MATCH"), (69.95, 70.0, "POTENTIAL_MATCH"), (84.95, 85.0, "STRONG_MATCH")])
def test_equal_totals_share_a_bucket(spark, total, rounded, bucket):
    # three categories at 27.5 and one at 17.5 percent, by all scores that make this total
    rest = round(total * 400)
    found = [(a, b, c, d) for d in range(101) for a in range(0, 101, 3) for b in range(0, 101, 3) for c in [(rest - 70 * d) // 110 - a - b] if 0 <= c <= 100 and (rest - 70 * d) % 110 == 0]
    rows = [(k, "c", score, 17.5 if at == 3 else 27.5, True, False) for k, scores in enumerate(found) for at, score in enumerate(scores)]
    scored = spark.createDataFrame(rows, "k int, category string, score int, weight_percent double, present boolean, failed boolean")
    out = scoring.weighted_totals(scored, "k")
    assert {(r.raw_total, r.overall_score, r.recommendation) for r in out.collect()} == {(total, rounded, bucket)}


def test_weights_sum_to_one(spark):
    for k in range(1, 32):
        present = tuple(bool(k >> i & 1) for i in range(5))
        if k in (1, 7, 16, 21, 31):
            assert _scored(spark, GOLDEN, present).agg(F.sum("weight_percent")).first()[0] == pytest.approx(100)


def test_median(spark):
    rows = [("a", i, s) for i, s in enumerate((90, 80, 85, 82))] + [("b", 1, 82), ("b", 2, 83), ("c", 1, 7)]
    found = scoring.median_with_payload(spark.createDataFrame(rows, "k string, run int, score int"), ["k"], "score", "run", ["run"]).collect()
    assert {r.k: (r.median_score, r.all_scores, r.run) for r in found} == {"a": (84, [90, 80, 85, 82], 3), "b": (82, [82, 83], 1), "c": (7, [7], 1)}


def test_settings():
    with pytest.raises(ValueError):
        Settings(evaluation_runs=0)


def test_sorted_pool(spark):
    rows = [("Émile", 80.0, "2024-01-02", 1, 2), ("anna", 90.0, None, None, None), ("Zoe", None, "2024-03-01", 1, 1)]
    pool = spark.createDataFrame(rows, "name string, score double, evaluated_at string, tier int, tier_order int")
    order = lambda how: [r.name[0] for r in scoring.sorted_pool(pool, how).collect()]
    assert order("evaluation_order") == ["Z", "É", "a"] and order("name_asc") == ["a", "É", "Z"] and order("name_desc") == ["Z", "É", "a"]
    assert order("score_desc") == ["a", "É", "Z"] and order("date_asc") == ["a", "É", "Z"] and order("date_desc") == ["Z", "É", "a"]


def test_order_list(spark):
    text = ["# head", "", 'Ann <ANN@x.com>', '"Bob"', "bob ", "--- Tier 2 ---", "carl", "ann@x.com", "x tier2 y", "dora"]
    lines = spark.createDataFrame(list(enumerate(text)), "at int, line string")
    found = [(r.tier, r.place, r.item) for r in ordering.parse_order(lines, "at", "line").orderBy("tier", "place").collect()]
    assert found == [(1, 0, "ann@x.com"), (1, 1, "bob"), (2, 0, "carl"), (2, 1, "ann@x.com"), (2, 2, "dora")]
    people = spark.createDataFrame([("r1.json", "mail ann@x.com", "A"), ("r2.json", None, " DORA "), ("r3.json", "", None), ("carl.json", "", "")], "f string, t string, n string")
    ids = ordering.identifiers(people, "f", "t", ["n"])
    tiers = {r.f: (r.tier, r.tier_order) for r in ordering.match_tiers(people, ids, ordering.parse_order(lines, "at", "line"), "f").collect()}
    assert tiers == {"r1.json": (1, 0), "r2.json": (2, 2), "r3.json": (3, 9999), "carl.json": (2, 0)}


def _unique_by_hand(names):
    taken, out = set(), []
    for name in names:
        now, n = name, 1
        while now in taken:
            n += 1
            head, _, tail = name.partition("@")
            now = f"{head}_{n}@{tail or 'unknown.com'}"
        taken.add(now)
        out.append(now)
    return out


def test_unique_names(spark):
    rng = random.Random(6)
    for _ in range(3):
        names = [rng.choice(["a", "a_2", "a_3", "b", "a_2_2"]) + "@" + rng.choice("xy") for _ in range(40)] + ["plain", "plain"]
        rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
        found = [r.unique_name for r in ordering.unique_names(rows, "name", "i").orderBy("i").collect()]
        assert found == _unique_by_hand(names) and len(set(found)) == len(found)


def test_precedence_and_ranks(spark):
    a, b = (spark.createDataFrame(r, "f string, v int") for r in ([("x", 1)], [("x", 2), ("y", 3)]))
    assert {(r.f, r.v) for r in ordering.by_precedence([a, b], "f").collect()} == {("x", 1), ("y", 3)}
    ranked = ordering.rank_in_tier(spark.createDataFrame([(1, None), (2, 3), (3, 1)], "i int, tier int"), "tier", ["i"])
    assert {(r.i, r.rank, r.tier_count) for r in ranked.collect()} == {(1, 1, 2), (2, 2, 2), (3, 1, 1)}


def test_ranks_of_a_large_key(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("k"))
    found = ordering.ranked(rows.repartition(7), "k", ["id"]).collect()
    for key in ("hot", "b", None):
        own = sorted((r.id, r["rank"]) for r in found if r.k == key)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert len(found) == 5000


def test_decompose_golden(spark):
    lines = ("Cần 3+ năm kinh nghiệm Python, FastAPI, PostgreSQL.", "Ưu tiên ứng viên có tinh thần làm việc nhóm tốt.")
    rows = spark.createDataFrame([lines], "standard string, hidden string").withColumn("k", F.lit(0))
    found = criteria.decompose(rows, ["k"])
    assert [(r.id, r.type) for r in found.orderBy("ordinal").collect()] == [
        ("crit_seniority_title_1", "standard"), ("crit_technical_skills_2", "standard"), ("crit_work_experience_3", "standard"), ("crit_hidden_culture_4", "hidden"),
    ]
    text = criteria.summary_text(found, *lines, "2024-01-01 00:00:00").first().text
    assert "(Total items: 0)\n   (No items classified in this category)" in text and f"   1. {lines[0]}\n" in text


def test_retrieve(spark):
    pool = spark.createDataFrame([("1", 1, "a", "c", [1.0, 0.0]), ("2", 2, "b", "c", [0.0, 1.0]), ("3", 3, "d", "c", None), ("4", 1, "e", "n", None), ("5", 2, "f", "n", None)], "id string, ordinal int, text string, category string, embedding array<double>")
    queries = spark.createDataFrame([(7, "c", [0.1, 1.0]), (7, "n", [1.0]), (8, "none", [1.0])], "query_id int, category string, vector array<double>")
    found = [(r.category, r.rank, r.id) for r in criteria.retrieve(queries, pool, 2).orderBy("category", "rank").collect()]
    assert found == [("c", 1, "2"), ("c", 2, "1"), ("n", 1, "4"), ("n", 2, "5")]


def test_medoid(spark):
    rows = [(1, 1, "abcd"), (1, 2, "abce"), (1, 3, "zzzz"), (2, 5, "only"), (3, 1, "x"), (3, 2, "y"), (4, 1, None)]
    found = {r.k: (r.n_runs, r.run, r.consensus) for r in extract.medoid(spark.createDataFrame(rows, "k int, run int, t string"), "k", "run", "t").collect()}
    assert found == {1: (3, 1, 0.375), 2: (1, 5, 1.0), 3: (2, 1, 0.0)}


def test_parse_and_first_valid(spark):
    rows = [(1, 1, "junk"), (1, 2, '{"a": 1}'), (1, 3, '{"a": 3}'), (2, 1, "{}"), (3, 1, '```{"a": 2,}```'), (4, 1, None)]
    parsed = extract.parse_answers(spark.createDataFrame(rows, "k int, attempt int, raw string"), "raw", defaults=None)
    assert {(r.k, r.attempt): r.parsed for r in parsed.collect()} == {(1, 1): None, (1, 2): '{"a": 1}', (1, 3): '{"a": 3}', (2, 1): None, (3, 1): '{"a": 2}', (4, 1): None}
    first = extract.first_valid(parsed, ["k"], "attempt", F.col("parsed").isNotNull())
    assert {r.k: r.attempt for r in first.collect()} == {1: 2, 3: 1}


def test_missing_leaves(spark):
    rows = [(1, '{"a": {"b": ["Alpha &amp; beta", "nope"]}, "warning": ["nope"], "n": 3}', "alpha & beta"), (2, "broken", ""), (3, None, None)]
    found = {r.k: r.warnings for r in extract.missing_leaves(spark.createDataFrame(rows, "k int, j string, s string"), "k", "j", "s").collect()}
    assert found == {1: ["Extraction text at 'a.b[1]' ('nope') not found in markdown"], 2: [], 3: []}
    shown = spark.createDataFrame([(0.5,), (None,), (0.9,)], "c double").select(extract.consensus_warning(F.col("c")).alias("w")).collect()
    assert ["0.5000" in shown[0].w[0], "No candidates" in shown[1].w[0], shown[2].w] == [True, True, []]


def test_sections_hide_private_fields(spark):
    document = '{"basic_information": {"email": "e@x.y", "phone": "1", "name": "N", "location": "L"}, "work_experience": [{"position": "p", "company_name": "c", "company_size": "9", "duration": "d", "responsibilities": "r"}]}'
    from tamis.schemas import RESUME

    typed = spark.createDataFrame([("k", document)], "k string, j string").select("k", F.from_json("j", RESUME).alias("r"))
    found = {r.category: r.section for r in sections.sections(typed, "k", "r", CATEGORIES).collect()}
    assert "p tại c (9) (d)" in found["seniority_title"] and '"r"' in found["hidden_culture"]
    assert not any(x in "".join(found.values()) for x in ("e@x.y", '"name"', '"phone"'))


def test_accuracy(spark):
    truth = spark.createDataFrame([("a", '{"self_evaluation": "x"}'), ("b", '{"self_evaluation": "x"}'), ("c", "{bad"), ("d", "{}")], "f string, j string")
    given = spark.createDataFrame([("a", '{"self_evaluation": "x"}'), ("d", "not json")], "f string, j string")
    scores = accuracy.score_pairs(truth, given, "f", "j")
    assert {(r.f, r.matched, r.overall) for r in scores.collect()} == {("a", True, 1.0), ("b", False, 0.0), ("d", True, 0.0)}
    report = accuracy.accuracy_report(scores, "f").first()
    assert (report.files, report.matched, report.missing) == (3, 2, 1) and report.overall == pytest.approx(1 / 3)


def test_consistency(spark):
    rows = spark.createDataFrame([(1, "a@x", 5.0), (1, "b@x", 7.0), (2, "a@x", 6.0)], "round int, email string, score double")
    out = consistency.matrix(rows, "round", "email", "score", ["a@x", "b@x", "c@x"]).orderBy("round").collect()
    assert [tuple(r) for r in out] == [(1, 5.0, 7.0, 0.0), (2, 6.0, 0.0, 0.0)]
    assert {(r.email, r.rounds, r.mean) for r in consistency.spread(rows, "email", "score").collect()} == {("a@x", 2, 5.5), ("b@x", 1, 7.0)}


def test_contained_passages(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over it"), (2, "quick brown"), (3, None)], "i int, t string")
    passages = spark.createDataFrame([(1, "ick BROWN, fox jumps ov"), (2, "brown"), (3, ""), (4, "one two three four five")], "p int, t string")
    found = contained_passages(docs, "i", "t", passages, "p", "t")
    assert {(r.i, r.p) for r in found.collect()} == {(1, 1), (1, 2), (2, 2)}
