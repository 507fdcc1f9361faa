"""Registered queries of the core against their SQL, on the smallest tables."""

import os

import pytest

from codeloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(found):
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(flat, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    if name not in Q.ORACLES:
        assert df.count() > 0
        return
    want = duck.sql(Q.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows(df.select(*columns).collect()) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys() and set(Q.QUERIES) <= e.queries().keys()


def test_a_small_table_of_code_is_parsed_in_many_tasks(spark, tmp_path):
    from codeloom.sources import codetree

    n = 2 * codetree.TASK_ROWS + 1
    spark.range(n).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size", "'b' as p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = Q.code(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 3 and files.select("path").distinct().count() == 3 * n
    spark.range(0).selectExpr("id as p_partkey", "cast(id as int) as p_size", "'b' as p_brand").write.parquet(f"{tmp_path}/none/part.parquet")
    assert Q.code(spark, f"{tmp_path}/none").count() == 0
