"""Every registered query against its SQL, on the smallest tables."""

import glob
import os
import time

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from eigenloom.plans.queries import ORACLE, QUERIES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert compare(got, duck.execute(oracle_sql()[name]).df()) == "ok"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [*ORACLE])
def test_sql_is_quick_under_a_limit(duck, name):
    """A LIMIT around the SQL must not make DuckDB run its steps again and again."""
    start = time.perf_counter()
    duck.execute(f"SELECT * FROM ({ORACLE[name]}) LIMIT 10000000").fetchall()
    assert time.perf_counter() - start < 5


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(QUERIES) == set(ORACLE)
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).limit(5).count() == 5
