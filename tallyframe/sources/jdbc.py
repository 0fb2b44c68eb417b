"""Reads from a remote relational engine, divided over tasks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

FETCH_ROWS = 10_000


def _reader(spark: SparkSession, url: str, properties: dict[str, str] | None) -> DataFrameReader:
    settings = {"fetchsize": str(FETCH_ROWS), **(properties or {})}
    return spark.read.format("jdbc").option("url", url).options(**settings)


def _bound(value) -> str:
    """Bounds only place the cuts between ranges, so a whole number will do."""
    return str(int(value) if isinstance(value, (float, Decimal)) else value)


def _read_divided(
    spark: SparkSession,
    url: str,
    relation: str,
    column: str,
    partitions: int,
    bounds: tuple | None,
    properties: dict[str, str] | None,
) -> DataFrame:
    if bounds is None:
        limits = f"SELECT min({column}) AS lo, max({column}) AS hi FROM {relation}"
        found = _reader(spark, url, properties).option("query", limits).load().first()
        # An empty relation has no bounds; one partition then reads nothing.
        bounds = (found[0], found[1]) if found[0] is not None else None
    reader = _reader(spark, url, properties).option("dbtable", relation)
    if bounds is not None:
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", _bound(bounds[0]))
            .option("upperBound", _bound(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    partitions: int = 64,
    bounds: tuple | None = None,
    predicates: list[str] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A remote table, read by one task per range of a numeric or date column.

    Without ``bounds`` one min/max query finds them. Where a single value holds
    much of the table, give ``predicates`` instead: one condition per task,
    which together must cover every row once.
    """
    if (partition_column is None) == (predicates is None):
        raise ValueError("give either partition_column or predicates")
    if predicates is not None:
        settings = {"fetchsize": str(FETCH_ROWS), **(properties or {})}
        return spark.read.jdbc(url, table, predicates=predicates, properties=settings)
    return _read_divided(spark, url, table, partition_column, partitions, bounds, properties)


def read_jdbc_query(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    partitions: int = 64,
    bounds: tuple | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """The result of a query that the remote engine runs.

    One task fetches the result unless ``partition_column`` names a numeric or
    date column of it, so leave that out only for previews and small reports.
    """
    if partition_column is None:
        return _reader(spark, url, properties).option("query", query).load()
    relation = f"({query}) remote_query"
    return _read_divided(spark, url, relation, partition_column, partitions, bounds, properties)
