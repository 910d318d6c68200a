"""Runs, medians, weights, totals and pools, on orders and customers.

A customer stands for a résumé, an order's priority for a category, and an order for a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import CATEGORIES, WEIGHT_PERCENT
from tamis.operators import scoring
from tamis.shared import table


def _runs(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return table(spark, d, "orders").select(
        "o_custkey",
        F.get(names, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("category"),
        F.col("o_orderkey").alias("run_index"),
        (F.col("o_orderkey") * 37 % 101).cast("int").alias("score"),
        (F.col("o_orderkey") % 997 == 0).alias("failed"),
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Medians in the grid of all customers and categories, with redistributed weights."""
    runs = _runs(spark, d)
    medians = scoring.median_with_payload(runs, ["o_custkey", "category"], "score", "run_index", ["failed"])
    failed = runs.groupBy("o_custkey", "category").agg(F.bool_or("failed").alias("any_run_failed"))
    results = medians.join(failed, ["o_custkey", "category"]).select(
        "o_custkey", "category", F.col("median_score").alias("score"), F.col("any_run_failed").alias("failed")
    )
    grid = scoring.category_grid(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    joined = grid.join(results, ["o_custkey", "category"], "left")
    joined = joined.withColumn("present", F.col("score").isNotNull())
    filled = joined.withColumn("score", F.coalesce("score", F.lit(0))).withColumn("failed", F.coalesce("failed", F.lit(False)))
    return scoring.redistribute(filled, "o_custkey", "present")


def weighted_total_bucket(spark: SparkSession, d: str) -> DataFrame:
    totals = scoring.weighted_totals(_scored(spark, d), "o_custkey")
    return totals.select("o_custkey", "any_failed", F.round(F.col("raw_total") * 10000).cast("long").alias("total_e4"), "recommendation")


def category_results(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.category_results(_scored(spark, d), "o_custkey")
    return rows.select("o_custkey", "category", F.round(F.col("weight") * 10000).cast("long").alias("weight_e4"), F.col("score").cast("long").alias("score"), "present")


def weight_redistribution(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("o_custkey", "category", "present", "weight_percent")


def fill_categories(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).groupBy("o_custkey", "category").agg(F.bool_or("failed").alias("failed"), F.max("score").alias("score"))
    grid = scoring.category_grid(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return scoring.fill_categories(runs, grid, "o_custkey").select("o_custkey", "category", F.col("score").cast("long").alias("score"), "failed")


def median_with_payload(spark: SparkSession, d: str) -> DataFrame:
    run = F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey")
    runs = table(spark, d, "lineitem").select("l_orderkey", run.alias("run"), "l_partkey", F.col("l_quantity").cast("int").alias("score"))
    out = scoring.median_with_payload(runs, ["l_orderkey"], "score", "run", ["l_partkey"])
    shown = F.array_join(F.col("all_scores").cast("array<string>"), ",").alias("all_scores")
    return out.select("l_orderkey", F.col("n").cast("long").alias("n"), F.col("median_score").cast("long").alias("median_score"), "l_partkey", shown)


def cross_runs(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.cross_runs(table(spark, d, "region").select("r_regionkey"), CATEGORIES, 20)
    return out.select("r_regionkey", "category", F.col("run_index").cast("long").alias("run_index"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("title"),
        F.floor((F.col("c_acctbal") + 1000) / 110).cast("long").alias("score"),
        F.when(F.col("c_custkey") % 7 == 0, "LOW_MATCH").when(F.col("c_custkey") % 11 == 0, "STRONG_MATCH").otherwise("").alias("label"),
    )


_POOL = """(SELECT c_custkey, c_name AS name, c_mktsegment AS title, floor((c_acctbal + 1000) / 110)::BIGINT AS score,
  CASE WHEN c_custkey % 7 = 0 THEN 'LOW_MATCH' WHEN c_custkey % 11 = 0 THEN 'STRONG_MATCH' ELSE '' END AS label FROM customer)"""


def pool_kpis(spark: SparkSession, d: str) -> DataFrame:
    return scoring.pool_kpis(_pool(spark, d), "score", "label")


def status_filter_search(spark: SparkSession, d: str) -> DataFrame:
    kept = scoring.status_filter(_pool(spark, d), "POTENTIAL_MATCH", "score", "label")
    return scoring.search(kept, "  BuilD ", ["name", "title"]).select("c_custkey", "score", "title")


def sorted_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d).withColumn("tier", (F.col("c_custkey") % 3 + 1).cast("int")).withColumn("tier_order", F.col("c_custkey") % 50)
    return scoring.sorted_pool(pool, "evaluation_order").select("tier", "tier_order", "name")


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    """Strengths and gaps of all categories of a résumé, flattened and counted; line items stand for them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("x"))
    flat = F.flatten(F.transform("x", lambda v: F.filter(F.array(v["l_returnflag"], v["l_linestatus"]), lambda s: s != "N")))
    return grouped.select("l_orderkey", F.size(flat).cast("long").alias("total"), F.array_join(flat, "").alias("flat"))


_GRID = "(VALUES " + ", ".join(f"('{c}', {WEIGHT_PERCENT[c]})" for c in CATEGORIES) + ") g(category, own)"
_NAMES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"

_RUNS_SQL = f"""runs AS (
  SELECT o_custkey, ({_NAMES})[substr(o_orderpriority, 1, 1)::INT] AS category, o_orderkey AS run_index,
         (o_orderkey * 37 % 101)::INT AS score, o_orderkey % 997 = 0 AS failed FROM orders)"""
_SCORED_SQL = f"""{_RUNS_SQL}, sorted AS (
  SELECT o_custkey, category, list_sort(list(score)) AS s, bool_or(failed) AS failed FROM runs GROUP BY ALL
), med AS (
  SELECT o_custkey, category, failed, s[(len(s) + 1) // 2] + s[len(s) // 2 + 1] AS two FROM sorted
), grid AS (SELECT c_custkey AS o_custkey, category, own FROM customer, {_GRID}
), j AS (
  SELECT grid.o_custkey, grid.category, own, two IS NOT NULL AS present,
         coalesce(two // 2 + CASE WHEN two % 2 = 1 AND (two // 2) % 2 = 1 THEN 1 ELSE 0 END, 0)::BIGINT AS score, coalesce(failed, false) AS failed
  FROM grid LEFT JOIN med USING (o_custkey, category)
), c AS (
  SELECT *, count_if(present) OVER p AS n, coalesce(sum(own) FILTER (present) OVER p, 0)::BIGINT AS held FROM j WINDOW p AS (PARTITION BY o_custkey)
), scored AS (
  SELECT o_custkey, category, present, score, failed,
         CASE WHEN n = 0 THEN own::DOUBLE WHEN present THEN (own * n + (100 - held)) / n ELSE 0.0::DOUBLE END AS weight_percent FROM c
)"""

QUERIES = {
    f.__name__: f
    for f in (
        weighted_total_bucket, category_results, weight_redistribution, fill_categories, median_with_payload, cross_runs, pool_kpis,
        status_filter_search, sorted_pool, summary_counts,
    )
}

ORACLE_SQL = {
    "weighted_total_bucket": f"""WITH {_SCORED_SQL}, t AS (
  SELECT o_custkey, bool_or(failed) AS any_failed, sum(CASE WHEN present THEN score * round(weight_percent * 100)::BIGINT ELSE 0 END)::BIGINT AS total_e4
  FROM scored GROUP BY 1)
SELECT *, CASE WHEN any_failed THEN 'REJECT' WHEN total_e4 >= 849500 THEN 'STRONG_MATCH' WHEN total_e4 > 699500 THEN 'POTENTIAL_MATCH'
  WHEN total_e4 >= 549500 THEN 'LOW_MATCH' ELSE 'REJECT' END AS recommendation FROM t""",
    "category_results": f"""WITH {_SCORED_SQL}
SELECT o_custkey, category, round(weight_percent * 100)::BIGINT AS weight_e4, present,
  CASE WHEN bool_or(failed) OVER (PARTITION BY o_custkey) OR NOT present THEN 0 ELSE score END AS score FROM scored""",
    "weight_redistribution": f"WITH {_SCORED_SQL} SELECT o_custkey, category, present, weight_percent FROM scored",
    "fill_categories": f"""WITH {_RUNS_SQL}, a AS (SELECT o_custkey, category, bool_or(failed) AS failed, max(score)::BIGINT AS score FROM runs GROUP BY ALL),
grid AS (SELECT c_custkey AS o_custkey, category FROM customer, {_GRID})
SELECT o_custkey, category, coalesce(score, 0) AS score, coalesce(failed, true) AS failed FROM grid LEFT JOIN a USING (o_custkey, category)""",
    "median_with_payload": """WITH g AS (
  SELECT l_orderkey, count(*) AS n, list({'s': l_quantity::INT, 'o': l_linenumber, 'p': l_partkey} ORDER BY l_quantity::INT, l_linenumber, l_partkey) AS r,
         string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS all_scores FROM lineitem GROUP BY 1
), m AS (SELECT *, r[(n + 1) // 2].s + r[n // 2 + 1].s AS two FROM g)
SELECT l_orderkey, n, (two // 2 + CASE WHEN two % 2 = 1 AND (two // 2) % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS median_score,
  r[(n + 1) // 2].p AS l_partkey, all_scores FROM m""",
    "cross_runs": f"SELECT r_regionkey, category, run_index FROM region, {_GRID}, (SELECT unnest(range(1, 21)) AS run_index)",
    "pool_kpis": f"""WITH b AS (SELECT score, CASE WHEN label = 'STRONG_MATCH' OR score >= 85 THEN 1 WHEN label = 'POTENTIAL_MATCH' OR score >= 70 THEN 2
  WHEN label = 'LOW_MATCH' OR score >= 55 THEN 3 ELSE 4 END AS b FROM {_POOL})
SELECT count(*) AS total, count_if(b = 1)::BIGINT AS strong_match, count_if(b = 2)::BIGINT AS potential_match, count_if(b = 3)::BIGINT AS low_match,
  count_if(b = 4)::BIGINT AS reject, printf('%.1f', avg(score)) AS avg_score FROM b""",
    "status_filter_search": f"""SELECT c_custkey, score, title FROM {_POOL}
WHERE (label = 'POTENTIAL_MATCH' OR (score >= 70 AND score < 85)) AND (lower(name) LIKE '%build%' OR lower(title) LIKE '%build%')""",
    "sorted_pool": f"SELECT (c_custkey % 3 + 1)::INT AS tier, c_custkey % 50 AS tier_order, name FROM {_POOL} ORDER BY 1, 2, lower(name)",
    "summary_counts": """WITH x AS (SELECT l_orderkey, string_agg(replace(l_returnflag || l_linestatus, 'N', ''), '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS flat FROM lineitem GROUP BY 1)
SELECT l_orderkey, length(flat)::BIGINT AS total, flat FROM x""",
}

