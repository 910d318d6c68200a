"""Criteria: decomposition, names, retrieval and the exported summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import CATEGORIES
from tamis.operators import criteria as C
from tamis.shared import table

# Keywords for the language of the stand-in texts.
KEYWORDS = {
    "seniority_title": ("est", "der ", "year"),
    "technical_skills": ("ing ", "python"),
    "work_experience": ("tion", "est"),
    "education_certifications": ("ment", "degree"),
}


def criteria_decompose(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 != 0, F.col("text")).alias("standard"), F.when(i % 3 == 0, F.col("text")).alias("hidden")
    )
    out = C.decompose(docs, ["doc_id"], KEYWORDS)
    return out.select("doc_id", "id", F.col("ordinal").cast("long").alias("ordinal"), "text", "category", "type")


def requirements_split(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("role"), F.lit(" \n--- "), F.coalesce("text", F.lit("")), F.lit("---x"))
    part = C.split_requirements(raw, F.when(F.col("turn") % 2 == 0, F.lit(" own ")))
    return table(spark, d, "conversations").select("conv_id", "turn", part.alias("s")).select("conv_id", "turn", "s.standard", "s.hidden")


def category_alias(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in (" Skills ", "position", "Culture", "hidden", "education", "other", "experience")])
    return table(spark, d, "part").select("p_partkey", C.category_name(F.get(names, (F.col("p_partkey") % 7).cast("int"))).alias("category"))


def topk_cosine_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Each hundredth vector against all of its label; the label is the category."""
    rows = table(spark, d, "embeddings").withColumn("category", F.col("label").cast("string"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "category", F.col("embedding").alias("vector"))
    pool = rows.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ordinal"), F.lit("").alias("text"), "category", "embedding")
    out = C.retrieve(queries, pool, 5)
    return out.select("query_id", "category", F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("vec_id"))


def criteria_summary(spark: SparkSession, d: str) -> DataFrame:
    """The exported report over the nations as criteria."""
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    rows = table(spark, d, "nation").select(
        F.get(names, F.col("n_nationkey") % 4).alias("category"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("text")
    )
    return C.summary_text(rows, "standard", "", "2024-01-01 00:00:00")


QUERIES = {f.__name__: f for f in (criteria_decompose, requirements_split, category_alias, topk_cosine_by_category, criteria_summary)}

_HIT = " UNION ALL ".join(
    f"SELECT doc_id, line_no, line, '{c}' AS category, {i} AS place FROM l WHERE doc_id % 3 <> 0 AND ("
    + " OR ".join(f"contains(lower(line), '{w}')" for w in KEYWORDS[c])
    + ")"
    for i, c in enumerate(CATEGORIES)
    if c in KEYWORDS
)
_SECTIONS = " || ".join(
    f"chr(10) || chr(10) || '[{heading}] (Total items: ' || (SELECT count(*) FROM r WHERE category = '{c}') || ')' || "
    f"coalesce((SELECT string_agg(chr(10) || '   ' || n || '. ' || n_name, '' ORDER BY n) FROM r WHERE category = '{c}'), chr(10) || '{C.NOTHING}')"
    for c, heading in C.HEADINGS.items()
)

ORACLE_SQL = {
    "criteria_decompose": rf"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
u AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM s),
l AS (SELECT doc_id, line_no, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS line FROM u),
h AS ({_HIT} UNION ALL SELECT doc_id, line_no, line, 'hidden_culture', 4 FROM l WHERE doc_id % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, line_no) AS ordinal FROM h WHERE line <> '')
SELECT doc_id, 'crit_' || category || '_' || ordinal AS id, ordinal, line AS text, category, CASE WHEN place = 4 THEN 'hidden' ELSE 'standard' END AS type FROM n""",
    "requirements_split": r"""SELECT conv_id, turn, role AS standard, CASE WHEN turn % 2 = 0 THEN 'own'
  ELSE regexp_replace(coalesce(text, '') || '---x', '^[\s\p{Z}]+', '') END AS hidden FROM conversations""",
    "category_alias": """SELECT p_partkey, ['technical_skills', 'seniority_title', 'hidden_culture', 'hidden_culture', 'education_certifications', 'technical_skills',
  'work_experience'][p_partkey % 7 + 1] AS category FROM part""",
    "topk_cosine_by_category": """WITH s AS (SELECT q.vec_id AS query_id, q.label::VARCHAR AS category, p.vec_id,
  list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings p ON p.label = q.label WHERE q.vec_id % 100 = 0)
SELECT query_id, category, rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "criteria_summary": f"""WITH r AS (SELECT n_name, ['{"', '".join(CATEGORIES)}'][n_nationkey % 4 + 1] AS category,
  row_number() OVER (PARTITION BY n_nationkey % 4 ORDER BY n_nationkey) AS n FROM nation)
SELECT array_to_string(['{C.RULE}', '{C.TITLE}', '{C.GENERATED}2024-01-01 00:00:00', '{C.RULE}', chr(10) || '{C.RAW_STANDARD}', 'standard', chr(10) || '{C.RAW_HIDDEN}', 'None',
  chr(10) || '{C.RULE}', '{C.BY_CATEGORY}', '{C.RULE}'], chr(10)) || {_SECTIONS} || chr(10) || chr(10) || '{C.RULE}' || chr(10) || '{C.END}' || chr(10) || '{C.RULE}' || chr(10) AS text""",
}
