import duckdb
import pytest

import __spark_entry__ as registry
from tallyframe.llm import registry as own

SF_DIR = "/root/testdata/sf0.01"


def test_all_are_registered():
    assert set(own.queries()) == {n for n in registry.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
    assert {int(n[2:].split("_")[0]) for n in own.queries() if n != "pipeline"} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    expected = connection.execute(own.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    found = own.queries()[name](spark, SF_DIR).select(*columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, expected.fetchall())))


@pytest.mark.parametrize("name, table", [("op2_sharding", "documents"), ("op6_quality", "documents"), ("op9_embeddings", "embeddings")])
def test_one_row_for_each(spark, name, table):
    rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    assert own.queries()[name](spark, SF_DIR).count() == rows


def test_only_uses_dataframe_functions_where_asked(spark, conf):
    from conftest import plan_of

    for name in ("op1_urls", "op2_sharding", "op7_pii"):
        plan = plan_of(own.queries()[name](spark, "/root/testdata/sf0.001"))
        assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]
