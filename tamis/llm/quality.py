"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything here is a DataFrame expression; there is no Python, Arrow or RDD step.
Words are maximal runs outside ``\\x20`` and ``\\x09``-``\\x0D``.  A null text has no
words and no lines.  An empty text, a text of white space and a null text fail the
base rule (fewer than 50 words).  Each row is judged alone, so repeated rows get
equal verdicts, an empty table gives an empty result, and columns beside the id and
the text are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.shared import col

SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

# Frequent function words of the languages that the corpus is in.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "est", "dans", "pour",
    "der", "die", "das", "und", "ein", "eine", "ist", "den", "von", "zu", "mit", "nicht",
    "el", "los", "las", "que", "y", "en", "por", "con", "una", "se", "del", "para",
)


@dataclass(frozen=True)
class Rule:
    """``low`` <= 1000 * ``part`` / ``whole`` <= ``high``, in whole numbers; a bound may be None.

    A rule whose ``whole`` is 0 holds.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


#: The production thresholds, per thousand.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1500, 20000),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 200),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 500),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 20, None),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 500),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array, first ones included.

    Windows are compared by 64-bit hashes.  Most texts leave after a hash-set test;
    the others sort (hash, position) once, so the cost is n log n in the words.
    """
    windows = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )

    def covered(tagged: Column) -> Column:
        twice = F.filter(
            tagged,
            lambda x, i: (x["h"] == F.get(tagged, i - 1)["h"]) | (x["h"] == F.get(tagged, i + 1)["h"]),
        )
        return let(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    def counted(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(tagged, covered))

    return let(windows, counted)


def measures(text: Column) -> Column:
    """A struct of the counts that rules may name."""
    text = F.coalesce(text, F.lit(""))
    has_word = f"[^{SPACE}]"

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            n_repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
            .cast("long")
            .alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))
    return let(words_of(text), lambda words: let(lines, lambda kept: counts(words, kept)))


def base_failed(m: Column) -> Column:
    """The fixed rule: too few words, or more than half of them in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def failures(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules of the table that a document breaks, comma-joined."""

    def broken(rule: Rule) -> Column:
        part, whole = 1000 * m[rule.part], m[rule.whole]
        low = F.lit(False) if rule.low is None else part < rule.low * whole
        high = F.lit(False) if rule.high is None else part > rule.high * whole
        return F.when((whole > 0) & (low | high), F.lit(rule.name))

    return F.concat_ws(",", *[broken(r) for r in rules])


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its counts, the rules that it breaks and the verdict."""
    measured = docs.select(col(id_col).alias("doc_id"), measures(col(text_col)).alias("m"))
    m = F.col("m")
    judged = measured.select("doc_id", "m", base_failed(m).alias("base_failed"), failures(m, rules).alias("broken"))
    return judged.select(
        "doc_id",
        *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"),
        F.col("broken").alias("broken_rules"),
        *[m[n].alias(n) for n in ("n_lines", "n_stop_words", "n_ellipsis_lines")],
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    verdict = let(measures(col(text_col)), lambda m: ~base_failed(m) & (failures(m, rules) == ""))
    return docs.where(verdict)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for :func:`quality` over ``documents``."""

    def broken(rule: Rule) -> str:
        tests = []
        if rule.low is not None:
            tests.append(f"1000 * {rule.part} < {rule.low} * {rule.whole}")
        if rule.high is not None:
            tests.append(f"1000 * {rule.part} > {rule.high} * {rule.whole}")
        return f"CASE WHEN {rule.whole} > 0 AND ({' OR '.join(tests)}) THEN '{rule.name}' END"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
  FROM d
), pos AS (
  SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM pos
), cover AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY rid
), m AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN cover USING (rid)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', {', '.join(map(broken, rules))}) AS broken_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, broken_rules, n_lines, n_stop_words, n_ellipsis_lines
FROM j
"""
