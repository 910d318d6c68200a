"""Card fields, on customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import CATEGORIES
from tamis.operators import display
from tamis.shared import table


def card_fields(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    score = F.floor(F.col("c_acctbal") / 90).cast("long")
    label = F.when(i % 7 == 0, "LOW_MATCH").when(i % 11 == 0, "REJECT")
    return table(spark, d, "customer").select(
        "c_custkey",
        display.shown_bucket(label, score).alias("bucket"),
        display.bar_width(score).alias("width"),
        display.contact(F.when(i % 3 == 0, ""), F.when(i % 4 == 0, F.concat(F.lit("a"), i.cast("string"))), F.when(i % 5 == 0, F.concat("c_name", F.lit("@x")))).alias("contact"),
        display.language_flag(F.when(i % 2 == 0, "EN")).alias("language"),
    )


def text_or_list(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    one = F.concat(F.lit('{"r": "'), "event_type", F.lit('"}'))
    two = F.concat(F.lit('{"r": ["'), "event_type", F.lit('", "x"]}'))
    json = F.when(i % 4 == 0, one).when(i % 4 == 1, two).when(i % 4 == 2, F.lit('{"r": null}')).otherwise(F.lit("broken"))
    return table(spark, d, "events").select("event_id", F.array_join(display.text_or_list(json, "$.r"), "|").alias("items"))


def category_lists(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    json = F.concat(F.lit('{"technical_skills": [" a ", ""], "hidden_culture": "'), "event_type", F.lit('"}'))
    lists = display.category_lists(F.when(i % 2 == 0, json), CATEGORIES)
    found = table(spark, d, "events").select("event_id", F.explode(lists).alias("category", "items"))
    return found.select("event_id", "category", F.array_join("items", "|").alias("items"))


def timings(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("s"))
    out = display.timings(whole, ["l_returnflag"], "s")
    return out.select("l_returnflag", F.col("seconds").cast("long").alias("seconds"), "stages")


QUERIES = {f.__name__: f for f in (card_fields, text_or_list, category_lists, timings)}

_LISTS = ", ".join(f"('{c}')" for c in CATEGORIES)
ORACLE_SQL = {
    "card_fields": """WITH c AS (SELECT *, floor(c_acctbal / 90)::BIGINT AS score, CASE WHEN c_custkey % 7 = 0 THEN 'LOW_MATCH' WHEN c_custkey % 11 = 0 THEN 'REJECT' END AS label FROM customer)
SELECT c_custkey, CASE WHEN score >= 85 THEN 'STRONG_MATCH' WHEN score >= 70 THEN 'POTENTIAL_MATCH' WHEN score >= 55 OR label = 'LOW_MATCH' THEN 'LOW_MATCH' ELSE 'REJECT' END AS bucket,
  least(100, greatest(5, score)) AS width, CASE WHEN c_custkey % 4 = 0 THEN 'a' || c_custkey WHEN c_custkey % 5 = 0 THEN c_name || '@x' ELSE '' END AS contact,
  CASE WHEN c_custkey % 2 = 0 THEN 'english' ELSE 'vietnamese' END AS language FROM c""",
    "text_or_list": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|x' ELSE '' END AS items FROM events",
    "category_lists": f"""SELECT event_id, category, CASE WHEN event_id % 2 = 1 THEN '' WHEN category = 'technical_skills' THEN 'a' WHEN category = 'hidden_culture' THEN event_type ELSE '' END AS items
FROM events, (VALUES {_LISTS}) v(category)""",
    "timings": "SELECT l_returnflag, sum(l_quantity::INT)::BIGINT AS seconds, count(*) AS stages FROM lineitem GROUP BY 1",
}
