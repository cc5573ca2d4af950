"""Every registered query of the library against its SQL on DuckDB."""

from collections import Counter

import duckdb
import pytest

from quillspark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


def test_list_is_sorted_without_one_task(spark):
    plan = QUERIES["list_newest_first"](spark, SF)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["open_queue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "TakeOrderedAndProject" in plan and "o_totalprice" not in plan
