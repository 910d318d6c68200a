"""Tiers, precedence, unique names, filters and joins of document lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import EMAIL, distinct_capped, first_filled, natural_key, safe_name, stem
from tamis.operators import consistency, ordering
from tamis.shared import table


def tier_order_running(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    line = (
        F.when(turn % 4 == 3, "--- tier 2 ---")
        .when(turn % 5 == 1, F.concat(F.lit("Name <"), "role", (turn % 3).cast("string"), F.lit("@x.com> ")))
        .when(turn % 7 == 2, "# note")
        .otherwise(F.concat(F.lit(' "'), F.initcap("role"), F.lit(" "), (turn % 2).cast("string"), F.lit('" ')))
    )
    lines = table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    out = ordering.parse_order(lines, "turn", "line", ["conv_id"])
    return out.select("conv_id", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"), "item")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.concat("c_name", F.lit(".json")).alias("file_name"),
        F.concat(F.lit("write to "), "c_mktsegment", F.lit("@mail.com")).alias("text"),
        "n_name",
        "c_mktsegment",
    )


def _order(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").where("n_nationkey % 3 < 2").select((F.col("n_nationkey") % 3 * 100 + F.col("n_nationkey")).alias("at"), "n_name")
    marks = spark.createDataFrame([(100 - 1, "---"), (300, "building")], "at int, n_name string")
    return ordering.parse_order(nations.unionByName(marks), "at", "n_name")


def tier_match_min_position(spark: SparkSession, d: str) -> DataFrame:
    people = _candidates(spark, d)
    ids = ordering.identifiers(people, "file_name", "text", ["n_name"])
    out = ordering.match_tiers(people, ids, _order(spark, d), "file_name")
    return out.select("c_custkey", F.col("tier").cast("long").alias("tier"), F.col("tier_order").cast("long").alias("tier_order"))


def rank_in_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.nullif((F.col("c_custkey") % 4).cast("int"), F.lit(0)).alias("tier"))
    out = ordering.rank_in_tier(rows, "tier", ["c_custkey"])
    return out.select("c_custkey", F.coalesce("tier", F.lit(3)).cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"), "tier_count")


def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("name"), "source", "doc_id")
    return ordering.first_by(rows, ["name"], ["source", "doc_id"])


def precedence_union(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    approved = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("approved").alias("folder"))
    output = orders.where("o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0").select("o_orderkey", F.lit("output").alias("folder"))  # a sixth is in both
    return ordering.by_precedence([approved, output], "o_orderkey").select("o_orderkey", "folder")


def duplicate_suffix(spark: SparkSession, d: str) -> DataFrame:
    letter = F.char((F.col("c_custkey") % 7 + 97).cast("long"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), letter, F.lit("@x.com")).alias("email"))
    return ordering.unique_names(rows, "email", "c_custkey")


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", natural_key(F.col("s_name")).alias("key")).orderBy("key")


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("."), "p_type")
    return table(spark, d, "part").select("p_partkey", safe_name(name).alias("safe"), stem(name).alias("stem"))


def coalesce_identifier(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    full = F.when(c % 3 == 0, F.col("c_name")).when(c % 3 == 1, "")
    return table(spark, d, "customer").select("c_custkey", first_filled(full, F.when(c % 2 == 0, F.col("c_mktsegment")), F.concat(F.lit("r"), c.cast("string"))).alias("identifier"))


def candidate_emails(spark: SparkSession, d: str) -> DataFrame:
    field = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Doc"), F.col("doc_id").cast("string"), F.lit("@Mail.com "))).when(F.col("doc_id") % 5 == 0, "none")
    stem_ = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", consistency.candidate_email(field, F.col("text"), stem_).alias("email"))


def id_filter_regex(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("c_name", r"(\d+)", 1).try_cast("long")
    return table(spark, d, "customer").where((number % 10).isin(2, 3, 5, 7)).select("c_custkey", "c_name")


def gt_left_outer_scores(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    joined = table(spark, d, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"),
        F.count("l_id").alias("matched"),
        F.count_if(F.col("l_id").isNull()).alias("missing"),
        F.avg(F.coalesce("quality", F.lit(0))).alias("mean_quality"),
        F.avg(F.coalesce("toxic", F.lit(0))).alias("mean_toxic"),
    )


def approved_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def ordered_distinct_cap(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", F.concat(F.lit(" "), "event_type", F.lit("\t")).alias("e"))
    # an event type counts once per user from here on, so a busy user is a handful of rows
    firsts = events.groupBy("user_id", "e").agg(F.min("event_id").alias("at"))
    listed = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("x"))
    return listed.select("user_id", F.array_join(distinct_capped(F.transform("x", lambda v: v["e"]), 3), ",").alias("first_types"))


def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix of hours and event types, a row for each of its cells."""
    events = table(spark, d, "events").select(F.hour("ts").alias("round"), "event_type")
    scores = events.groupBy("round", "event_type").agg(F.count(F.lit(1)).cast("double").alias("score"))
    out = consistency.matrix(scores, "round", "event_type", "score", consistency.names_of(scores, "event_type"))
    return consistency.cells(out, "round", "event_type", "score").withColumn("round", F.col("round").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        tier_order_running, tier_match_min_position, rank_in_tier, first_seen_dedupe, precedence_union, duplicate_suffix, natural_sort, safe_names,
        coalesce_identifier, candidate_emails, id_filter_regex, gt_left_outer_scores, approved_semi, missing_anti, ordered_distinct_cap, pivot_matrix,
    )
}

ORACLE_SQL = {
    "tier_order_running": """WITH l AS (
  SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '--- tier 2 ---' WHEN turn % 5 = 1 THEN role || (turn % 3) || '@x.com' WHEN turn % 7 = 2 THEN '# note'
    ELSE lower(role) || ' ' || (turn % 2) END AS line FROM conversations
), m AS (SELECT *, line LIKE '---%' AS sep FROM l WHERE line NOT LIKE '#%'
), r AS (SELECT *, 1 + max(sep::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS tier FROM m
), f AS (SELECT conv_id, tier, line AS item, min(turn) AS first_at FROM r WHERE NOT sep GROUP BY ALL)
SELECT conv_id, tier::BIGINT AS tier, row_number() OVER (PARTITION BY conv_id, tier ORDER BY first_at) - 1 AS place, item FROM f""",
    "tier_match_min_position": """WITH o AS (
  SELECT lower(n_name) AS item, n_nationkey % 3 + 1 AS tier, row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_nationkey) - 1 AS place FROM nation WHERE n_nationkey % 3 < 2
  UNION ALL SELECT 'building', 2, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 1)
), b AS (
  SELECT c_custkey, min({'t': tier, 'p': place}) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN o ON item IN (lower(n_name), lower(c_mktsegment)) GROUP BY 1
) SELECT c_custkey, coalesce(best.t, 3)::BIGINT AS tier, coalesce(best.p, 9999)::BIGINT AS tier_order FROM customer LEFT JOIN b USING (c_custkey)""",
    "rank_in_tier": """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE c_custkey % 4 END::BIGINT AS tier FROM customer)
SELECT *, row_number() OVER (PARTITION BY tier ORDER BY c_custkey) AS rank, count(*) OVER (PARTITION BY tier) AS tier_count FROM t""",
    "first_seen_dedupe": """SELECT name, source, doc_id FROM (SELECT sha256(text) AS name, source, doc_id,
  row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1""",
    "precedence_union": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'output' END AS folder FROM orders",
    "duplicate_suffix": """WITH e AS (SELECT c_custkey, lower(c_mktsegment) || chr((c_custkey % 7 + 97)::INT) AS head FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY c_custkey) AS n FROM e)
SELECT c_custkey, head || '@x.com' AS email, head || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '@x.com' AS unique_name FROM n""",
    "natural_sort": """SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(lower(s_name), '([0-9]+|[^0-9]+)', 1),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(length(p::BIGINT::VARCHAR)::VARCHAR, 10, '0') || p::BIGINT ELSE p END), '') AS key FROM supplier""",
    "safe_names": r"""SELECT p_partkey, regexp_replace(p_name || '.' || p_type, '[^a-zA-Z0-9_-]', '_', 'g') AS safe,
  regexp_replace(p_name || '.' || p_type, '\.[^.]*$', '') AS stem FROM part""",
    "coalesce_identifier": """SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END, ''),
  nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ''), 'r' || c_custkey) AS identifier FROM customer""",
    "candidate_emails": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'doc' || doc_id || '@mail.com'
  ELSE coalesce(nullif(lower(regexp_extract(coalesce(text, ''), '{EMAIL}')), ''), 'doc' || doc_id || '@unknown.com') END AS email FROM documents""",
    "id_filter_regex": r"SELECT c_custkey, c_name FROM customer WHERE regexp_extract(c_name, '\d+')::BIGINT % 10 IN (2, 3, 5, 7)",
    "gt_left_outer_scores": """SELECT source, count(*) AS files, count(l.doc_id) AS matched, count_if(l.doc_id IS NULL)::BIGINT AS missing,
  avg(coalesce(quality, 0)) AS mean_quality, avg(coalesce(toxic, 0)) AS mean_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "approved_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "missing_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "ordered_distinct_cap": """WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS n FROM f)
SELECT user_id, string_agg(event_type, ',' ORDER BY n) AS first_types FROM r WHERE n <= 3 GROUP BY 1""",
    "pivot_matrix": """WITH e AS (SELECT hour(ts)::BIGINT AS round, event_type FROM events)
SELECT round, event_type, (SELECT count(*) FROM e WHERE e.round = r.round AND e.event_type = t.event_type)::DOUBLE AS score
FROM (SELECT DISTINCT round FROM e) r, (SELECT DISTINCT event_type FROM e) t""",
}
