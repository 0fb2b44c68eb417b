"""Every registered query against its SQL in a second engine."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


OPTIONAL = set(registry.llm.queries()) if registry.llm else set()  # tested in a folder of their own


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - OPTIONAL))
def test_query_matches_sql(spark, oracle, name):
    result = registry.queries()[name](spark, SF_DIR)
    expected = oracle.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert ordered([tuple(r) for r in result.collect()], result.columns) == ordered(expected.fetchall(), columns)


def test_every_query_has_sql():
    assert set(registry.queries()) - OPTIONAL == set(registry.oracle_sql()) - OPTIONAL


def test_queries_leave_the_session_as_it_was(spark):
    before = spark.catalog.currentDatabase()
    for name in ("cat_switch", "cat_current", "cat_catalogs", "view_query"):
        registry.queries()[name](spark, SF_DIR)
    assert spark.catalog.currentCatalog() == "spark_catalog" and spark.catalog.currentDatabase() == before
    assert not [k for k in spark.conf.getAll if "tally_remote" in k]
    assert not [d.name for d in spark.catalog.listDatabases() if d.name.startswith("tally_")]
    assert not [t.name for t in spark.catalog.listTables() if t.isTemporary]


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def test_bench_runs_registered_queries():
    import bench

    assert set(bench.HEADLINE) <= set(registry.queries())
