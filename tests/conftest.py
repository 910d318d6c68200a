from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(v) for v in row) for row in rows)


@pytest.fixture(scope="session")
def same_as_sql():
    """Compare a DataFrame with the rows of a DuckDB connection's SQL, without regard to order."""

    def check(df, con, sql):
        names = sorted(df.columns)
        cursor = con.execute(sql)
        order = [d[0] for d in cursor.description]
        assert sorted(order) == names
        expected = [tuple(r[order.index(n)] for n in names) for r in cursor.fetchall()]
        assert plain(tuple(r[n] for n in names) for r in df.collect()) == plain(expected)

    return check
