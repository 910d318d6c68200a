"""Text, JSON and similarity functions on their edge cases."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import lenient_json as J
from tamis.functions import python as P
from tamis.functions import similarity as S
from tamis.functions import text as X


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values, kind="string"):
        names = [f"c{i}" for i in range(len(values[0]))] if isinstance(values[0], tuple) else ["c0"]
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {kind}" for n in names))
        return [r[0] for r in df.orderBy("i").select("i", function(*[F.col(n) for n in names]).alias("out")).orderBy("i").select("out").collect()]

    return run


def test_strip_and_markup(apply):
    assert apply(X.strip, "\t a b　\n", None, "") == ["a b", "", ""]
    assert apply(X.clean_markup, "# <b>Hi</b> [Link](http://x) – *a*|b c", None) == ["hi link - a b c", ""]
    assert apply(X.words_only, "Đạ <i>x</i>, y_z 3%") == ["đạ x y_z 3"]
    assert apply(P.normalised, "Caf&eacute; &amp; é") == ["café & é"]


def test_markdown_warnings(apply):
    found = apply(X.markdown_warnings, "", "ok", "a�", "a\x01\x02\x0c", "a\U000f0001", " \n--")
    assert [len(w) for w in found] == [1, 0, 1, 1, 1, 1]
    assert found[3] == [X.CONTROL % 2] and found[4] == [X.PRIVATE % 2] and found[0] == found[5] == [X.NO_TEXT]


def test_language_status(apply):
    status = lambda c: X.language_status(X.language_counts(c))
    assert apply(status, None, "12 3", "plain words", "một từ", "đá " + "plain " * 9, "ít là " + "plain " * 20, "Đá Đá Đá") == [
        "unknown", "unknown", "english", "vietnamese", "english", "bilingual", "unknown",
    ]


def test_contacts(apply):
    assert apply(X.normal_email, " MAILTO:A@B.com ", None, "mailto:x@y.z") == ["a@b.com", "", "x@y.z"]
    assert apply(X.normal_phone, "+84 987 654 321", "0987654321", None, "(84) 1") == ["0987654321", "0987654321", "", "01"]


def test_scores(apply):
    values = ("85", " 84.5 ", "85/100", "-5", "<85>", "true", "101", None, "", "82.5", "83.5", "1.2.3", "100%")
    assert apply(X.valid_score, *values) == [85, 84, None, 5, None, None, None, None, None, 82, 84, None, 100]


def test_names(apply):
    assert apply(X.stem, "a.b.json", "plain", ".hidden", "") == ["a.b", "plain", ".hidden", ""]
    assert apply(X.safe_name, "a b.c-d_é") == ["a_b_c-d__"]
    names = ["x10", "x9", "X2", "x02", "a", "10", "9"]
    keys = apply(X.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names, strict=True), key=lambda p: p[0])] == ["9", "10", "a", "X2", "x02", "x9", "x10"]
    long_ = ["x" + "9" * 30, "x1" + "0" * 30, "x1" + "0" * 29 + "1", "x" + "0" * 40 + "5", "x" + "1" * 25 + "2", "x" + "1" * 25 + "3"]
    keys = apply(X.natural_key, *long_)
    assert len(set(keys)) == len(keys)
    assert [n for _, n in sorted(zip(keys, long_, strict=True))] == sorted(long_, key=lambda n: int(n[1:]))
    assert apply(X.html_escaped, '<a href="x">&</a>') == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"]
    assert apply(lambda a, b: X.first_filled(a, b), ("", "x"), (None, ""), ("y", "x")) == ["x", None, "y"]


def test_containment(apply):
    source = "Alpha *beta* gamma\nDelta: one, two"
    inside = lambda v, s: X.contains_text(v, X.clean_markup(s), X.words_only(s))
    values = ["beta gamma", "delta one two", "one\nAlpha", "missing", "", "***", "alpha\nmissing"]
    assert apply(inside, *[(v, source) for v in values]) == [True, True, True, False, True, True, False]


def test_cosine(apply):
    assert apply(X.cosine, ([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), kind="array<double>") == [pytest.approx(0.5**0.5), 0.0]


# -- lenient JSON -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('<think>{"b": 2}</think> so {"a": 1} done', {"a": 1}),
        ('<think>open thought\n{"a": 1}', {"a": 1}),
        ('Thinking Process: hmm\n {"a": 1}', {"a": 1}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ('{"a": ["x", "k": "v"]}', {"a": ["x", "k: v"]}),
        ('{"a": "say"hi"now"}', {"a": "say'hi'now"}),
        ('{"a": 1, "a": 2}', {"a": 2}),
        ("{}", None),
        ("", None),
        (None, None),
        ("no braces", None),
        ("[1, 2]", None),
        ('broken { "x" {"a": 1}', {"a": 1}),
    ],
)
def test_read_object(text, found):
    assert J.read_object(text, defaults=None) == found


def test_truncated_objects():
    assert J.read_object('{"a": "x", "b": ["y", "z', defaults=None) == {"a": "x", "b": ["y"]}
    assert J.read_object('{"a": {"b": "c", "d": 1, "e', defaults=None) == {"a": {"b": "c", "d": 1}}
    found = J.read_object('{"self_evaluation": "good", "projects": [{"project_name": "p"')
    assert found["self_evaluation"] == "good" and found["projects"] == [{"project_name": "p"}] and set(J.DOCUMENT_DEFAULTS) <= set(found)
    assert J.close_truncated("   ") == "   "


# fences and reasoning marks are dropped before parsing, wherever they stand
PLAIN = st.characters(exclude_characters="`<", exclude_categories=("Cs",))
TREES = st.recursive(st.text(PLAIN, max_size=8) | st.integers(-99, 99) | st.booleans() | st.none(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(PLAIN, max_size=4), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(PLAIN, min_size=1, max_size=4), TREES, min_size=1, max_size=4), st.integers(0, 200))
def test_reading_never_fails(tree, cut):
    whole = json.dumps(tree)
    assert J.read_object(whole, defaults=None) == tree
    part = J.read_object(whole[:cut])
    assert part is None or isinstance(part, dict)


def test_headed_list():
    text = 'technical_skills:\n- "SQL",\n* Java\nnoise\n"hidden_culture"\n• kind'
    assert J.read_headed_list(text, ("technical_skills", "hidden_culture")) == {"technical_skills": ["SQL", "Java"], "hidden_culture": ["kind"]}
    assert J.read_headed_list("nothing", ("technical_skills",)) is None


# -- similarity -----------------------------------------------------------------------


def test_ratio_is_not_symmetric():
    assert S.ratio("tide", "diet") == 0.25 and S.ratio("diet", "tide") == 0.5


def test_text_similarity():
    assert S.text_similarity("", " ") == 1.0 and S.text_similarity("a", "") == 0.0 and S.text_similarity(" A ", "a") == 1.0
    assert S.text_similarity(None, "none") == 1.0 and S.text_similarity("ab", "ac", lambda a, b: 0.7) == 0.7


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=4), min_size=1, max_size=4).filter(lambda m: len({len(r) for r in m}) == 1))
def test_assignments(matrix):
    cost = np.array(matrix, dtype=float)
    n = min(cost.shape)
    greedy, best = S.greedy_assignment(cost), S.optimal_assignment(cost)
    tall = cost if cost.shape[0] <= cost.shape[1] else cost.T
    least = min(sum(tall[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(tall.shape[1]), tall.shape[0]))
    for pairs in (greedy, best):
        assert len(pairs) == n == len({r for r, _ in pairs}) == len({c for _, c in pairs})
    assert sum(cost[p] for p in best) == least <= sum(cost[p] for p in greedy)


def test_skills_and_nested():
    assert S.skills_score([], None) == 1.0 and S.skills_score(["a"], []) == 0.0
    assert S.skills_score(["C++ dev", "SQL"], ["c++", "java"]) == pytest.approx(1 / 4)
    near = lambda a, b: 0.9 if a[0].lower() == b[0].lower() else 0.1
    assert S.skills_score(["apple", "bear"], ["ant", "cat"], near) == pytest.approx(0.5)
    assert S.nested_score([], [], {"n": 1.0}) == 1.0 and S.nested_score([{"n": "a"}], [], {"n": 1.0}) == 0.0
    assert S.nested_score([{"n": "alpha"}, {"n": "beta"}], [{"n": "beta"}], {"n": 1.0}) == pytest.approx(2 / 3)


def test_pair_scores():
    whole = {"position_applied": {"title": "Dev"}, "basic_information": {"email": "a@b.c", "phone": "+84 1"}, "skills_and_specialties": ["x"]}
    assert S.pair_scores(whole, whole)["overall"] == 1.0
    other = {"position_applied": {"title": "dev", "level": "senior"}, "basic_information": {"email": "MAILTO:a@b.c", "phone": "01"}}
    found = S.pair_scores(whole, other)
    assert found["position_applied"] == 0.5 and found["basic_information"] == 1.0 and found["skills_and_specialties"] == 0.0
    assert S.pair_scores(whole, None)["basic_information.email"] == 0.0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.text(max_size=20))
def test_ratios_are_shares(a, b):
    assert 0.0 <= S.text_similarity(a, b) <= 1.0
