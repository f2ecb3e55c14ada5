"""Every registered query runs; every query with an oracle gives the oracle's rows."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLE = spark_entry.oracle_sql()
# Iterative fits have tests of their own.
SLOW = {"nmf_topics", "nmf_topic_sentiment", "guided_nmf_keywords", "run_full_analysis", "train_classifiers"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in spark_entry.queries() if n not in SLOW])
def test_query(spark, con, name):
    df = spark_entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        res = con.execute(ORACLE[name])
        want = rows_of([d[0] for d in res.description], res.fetchall())
        assert got == want


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(spark_entry.queries())
