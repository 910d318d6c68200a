"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from tamis import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(name, spark, sf_dir, duck, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_missing_leaves_has_every_customer(spark, sf_dir):
    found = {r.c_custkey: r.warnings for r in queries.QUERIES["missing_leaves"](spark, sf_dir).collect()}
    keys = {r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").collect()}
    assert set(found) == keys and {k for k, w in found.items() if w is None} == {k for k in keys if k % 13 == 0}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 150
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


NATIVE = ("weighted_total_bucket", "median_with_payload", "pool_kpis", "language_status", "words_only_text", "token_jaccard", "topk_cosine_by_category", "tier_order_running")


@pytest.mark.parametrize("name", NATIVE)
def test_plan_has_no_python(name, spark, sf_dir):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan)


def test_topk_limits_before_the_exchange(spark, sf_dir):
    plan = queries.QUERIES["topk_cosine_by_category"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scans_read_few_columns(spark, sf_dir):
    plan = queries.QUERIES["weighted_total_bucket"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
