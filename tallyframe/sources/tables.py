"""External tables: a catalog name for files that already exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.catalog import quoted, sql_text


def _options(options: dict[str, str]) -> str:
    return ", ".join(f"{sql_text(k)} {sql_text(v)}" for k, v in options.items())


def create_delimited_table(
    spark: SparkSession,
    table: str,
    path: str,
    columns: list[str] | None = None,
    *,
    sep: str = ",",
    quote: str = '"',
    escape: str = "\\",
    header: bool = False,
) -> DataFrame:
    """Register separated text at ``path`` as ``table`` and return it.

    Every column is a string. ``columns`` are the names; without them the
    header line or positional names are used. ``quote=""`` turns quoting off,
    so quote marks are ordinary characters. An existing table is kept. Such
    text cannot tell an empty value from a missing one: both are read as null.
    """
    declared = f"({', '.join(f'{quoted(c)} STRING' for c in columns)})" if columns else ""
    settings = _options({"sep": sep, "quote": quote, "escape": escape, "header": str(header).lower()})
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(table)} {declared} USING csv "
        f"OPTIONS ({settings}) LOCATION {sql_text(path)}"
    )
    return spark.table(quoted(table))


def create_table_at(spark: SparkSession, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Register the data set at ``path`` as ``table`` and return it.

    ``fmt`` is any format with a stored schema: ``parquet``, ``orc``, or
    ``delta`` where its package is installed.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(table)} USING {quoted(fmt)} LOCATION {sql_text(path)}")
    return spark.table(quoted(table))
