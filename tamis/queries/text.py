"""Text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.functions import text as X
from tamis.functions.python import normalised
from tamis.operators.containment import contained_passages
from tamis.shared import table


def language_status(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").select("doc_id", X.language_counts(F.col("text")).alias("f"))
    return counts.select("doc_id", F.col("f.words").cast("long").alias("n_words"), X.language_status(F.col("f")).alias("status"))


def markdown_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text, some with characters that documents lack, and for each eleventh one an empty text under the id below zero."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    dirty = F.concat(
        F.coalesce("text", F.lit("")),
        F.when(i % 3 == 0, F.lit("�")).otherwise(""),
        F.when(i % 5 == 0, F.lit("\x01\x02")).otherwise(""),
        F.when(i % 7 == 0, F.lit("\ue000\U000f0001")).otherwise(""),
    )
    blank = docs.where("doc_id % 11 = 0").select((-1 - i).alias("doc_id"), F.lit("").alias("text"))
    every = docs.select("doc_id", dirty.alias("text")).unionByName(blank)
    return every.select("doc_id", F.array_join(X.markdown_warnings(F.col("text")), "|").alias("warnings"))


def words_only_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.words_only(F.col("text")).alias("words"))


def clean_markup_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.clean_markup(F.col("html")).alias("clean"))


def clean_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The full form with entities and composition, which SQL engines lack."""
    return table(spark, d, "pages").select("page_id", normalised(F.col("html")).alias("clean"))


def text_containment(spark: SparkSession, d: str) -> DataFrame:
    return contained_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def _extracted(spark: SparkSession, d: str, pattern: str, name: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({pattern})"), 1)
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias(name))


def email_extract_normalize(spark: SparkSession, d: str) -> DataFrame:
    found = _extracted(spark, d, X.EMAIL, "raw")
    return found.select("doc_id", X.normal_email(F.concat(F.lit(" MAILTO:"), "raw")).alias("email")).distinct()


PHONE = r"[+]?[0-9][0-9 ().-]{7,}[0-9]"


def phone_normalize(spark: SparkSession, d: str) -> DataFrame:
    found = _extracted(spark, d, PHONE, "raw")
    return found.select("doc_id", "raw", X.normal_phone(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("84"), "raw")).otherwise(F.col("raw"))).alias("phone"))


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, d, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL")
    sets = pairs.select("conv_id", "turn", X.tokens(F.array("before")).alias("a"), X.tokens(F.array("text")).alias("b"))
    return sets.select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("a", "b")).cast("long").alias("shared"),
        F.size(F.array_union("a", "b")).cast("long").alias("every"),
        X.jaccard(F.col("a"), F.col("b")).alias("jaccard"),
    )


def _score_text() -> Column:
    v = F.col("value").cast("decimal(18,2)").cast("string")
    i = F.col("event_id")
    return (
        F.when(i % 9 == 0, F.concat(v, F.lit("/100")))
        .when(i % 9 == 1, F.concat(F.lit("-"), v))
        .when(i % 9 == 2, F.lit("<integer>"))
        .when(i % 9 == 3, F.lit("true"))
        .when(i % 9 == 4, F.concat(F.lit(" "), (i % 140).cast("string"), F.lit("% ")))
        .when(i % 9 == 5, F.concat((i % 100).cast("string"), F.lit(".5")))
        .otherwise(v)
    )


def score_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.valid_score(_score_text()).cast("long").alias("score"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.html_escaped(F.col("html")).alias("escaped"))


QUERIES = {
    f.__name__: f
    for f in (
        language_status, markdown_validation, words_only_text, clean_markup_text, clean_page_text, text_containment, email_extract_normalize,
        phone_normalize, token_jaccard, score_validate, html_escape,
    )
}

_WORDS = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ')"
_S = r"[\s\p{Z}]"



ORACLE_SQL = {
    "language_status": rf"""WITH w AS (
  SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z{X.VIETNAMESE}]+')) AS w FROM documents
), c AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(list_filter(w, lambda x: regexp_matches(x, '[{X.VIETNAMESE}]'))) AS m FROM w)
SELECT doc_id, n_words, CASE WHEN n_words = 0 THEN 'unknown' WHEN m < 2 THEN 'english' WHEN 100 * m >= 15 * n_words THEN 'vietnamese' ELSE 'bilingual' END AS status FROM c""",
    "markdown_validation": f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN chr(1) || chr(2) ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(57344) || chr(983041) ELSE '' END AS t FROM documents UNION ALL SELECT -1 - doc_id, '' FROM documents WHERE doc_id % 11 = 0)
SELECT doc_id, concat_ws('|', CASE WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN '{X.NO_TEXT}' END,
  CASE WHEN contains(t, chr(65533)) THEN '{X.REPLACED}' END, CASE WHEN contains(t, chr(1)) THEN '{X.CONTROL % 2}' END,
  CASE WHEN contains(t, chr(57344)) THEN '{X.PRIVATE % 2}' END) AS warnings FROM t""",
    "words_only_text": f"SELECT doc_id, {_WORDS.format('text')} AS words FROM documents",
    "clean_markup_text": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g') AS t FROM pages),
b AS (SELECT page_id, lower(regexp_replace(regexp_replace(t, '[–—−]', '-', 'g'), '[*_#`|~>•]', ' ', 'g')) AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '{_S}+', ' ', 'g'), ' ') AS clean FROM b""",
    "text_containment": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents), p AS (SELECT item_id, {_WORDS.format('text')} AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN p ON p <> '' AND contains(t, p)""",
    "email_extract_normalize": f"""SELECT DISTINCT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{X.EMAIL}')) AS e FROM documents)""",
    "phone_normalize": f"""SELECT DISTINCT doc_id, raw, regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '84' || raw ELSE raw END, '[^0-9]', '', 'g'), '^84', '0') AS phone
FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{PHONE}')) AS raw FROM documents)""",
    "token_jaccard": r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_+#-]+', ' ', 'g'), ' '), lambda x: x <> '')) AS b FROM conversations),
p AS (SELECT conv_id, turn, b, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM t),
c AS (SELECT conv_id, turn, len(list_intersect(a, b))::BIGINT AS shared, len(list_distinct(list_concat(a, b)))::BIGINT AS every FROM p WHERE a IS NOT NULL)
SELECT *, CASE WHEN every = 0 THEN 1.0::DOUBLE ELSE shared / every END AS jaccard FROM c""",
    "score_validate": """WITH v AS (SELECT event_id, event_id % 9 AS m, value::DECIMAL(18,2)::VARCHAR AS v FROM events),
n AS (SELECT event_id, CASE m WHEN 0 THEN v || '100' WHEN 1 THEN replace(v, '-', '') WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN (event_id % 140)::VARCHAR
  WHEN 5 THEN (event_id % 100) || '.5' ELSE replace(v, '-', '') END AS n FROM v),
r AS (SELECT event_id, round_even(n::DECIMAL(18,6), 0)::BIGINT AS s FROM n)
SELECT event_id, CASE WHEN s BETWEEN 0 AND 100 THEN s END AS score FROM r""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
}
