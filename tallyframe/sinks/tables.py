"""Writes to catalog tables and to the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.catalog import quoted, sql_text
from tallyframe.session import scratch_path
from tallyframe.sinks.files import KEEP_BLANKS, write_directory


def refresh_table(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """Replace a managed table with the rows of ``df``, creating it if needed.

    The rows go to a table beside it, which then takes its name, and the old
    table is dropped last. So ``df`` may read the table or its files, and a
    failed write or switch leaves the table as it was. Where a driver died
    between the two renames, ``recover_table`` has the old rows back, and the
    next refresh begins with that.
    """
    spark = df.sparkSession
    recover_table(spark, table)
    schema, name = table.split(".")[:-1], table.split(".")[-1]
    staged, old = (".".join([*schema, f"{name}_{kind}_{uuid.uuid4().hex}"]) for kind in ("new", "old"))
    try:
        df.write.format(fmt).saveAsTable(quoted(staged))
        present = spark.catalog.tableExists(quoted(table))
        if present:
            _rename(spark, table, old)
        try:
            _rename(spark, staged, table)
        except Exception:
            if present:
                _rename(spark, old, table)
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(staged)}")
        raise
    if present:
        spark.sql(f"DROP TABLE {quoted(old)}")


def recover_table(spark: SparkSession, table: str) -> bool:
    """Give a table that a broken refresh left without its name the name back; whether that was needed."""
    schema, name = table.split(".")[:-1], table.split(".")[-1]
    if spark.catalog.tableExists(quoted(table)):
        return False
    place = f" IN {quoted('.'.join(schema))}" if schema else ""
    if schema and not spark.catalog.databaseExists(".".join(schema)):
        return False
    found = [r.tableName for r in spark.sql(f"SHOW TABLES{place} LIKE '{name}_old_*'").collect()]
    left = [n for n in found if re.fullmatch(re.escape(name) + "_old_[0-9a-f]{32}", n, re.IGNORECASE)]
    if len(left) == 1:
        _rename(spark, ".".join([*schema, left[0]]), table)
    return len(left) == 1


def _rename(spark: SparkSession, source: str, target: str) -> None:
    spark.sql(f"ALTER TABLE {quoted(source)} RENAME TO {quoted(target)}")


def write_external_table(
    df: DataFrame, table: str, path: str, fmt: str = "csv", options: dict[str, str] | None = None
) -> None:
    """Write ``df`` to ``path`` and point ``table`` at it; dropping it keeps the files.

    The files are replaced only when the new ones are whole, and the table is
    declared anew after that.
    """
    settings = {**(KEEP_BLANKS if fmt == "csv" else {}), **(options or {})}
    write_directory(df, path, fmt, settings)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    spark.catalog.createTable(quoted(table), path, fmt, df.schema, **settings)


def rewrite_external_table(df: DataFrame, table: str, path: str, fmt: str = "parquet") -> None:
    """Write ``df`` to a new ``path``, then switch ``table`` over to it.

    Unlike an overwrite this works when ``df`` reads ``table`` itself, and a
    failed write leaves the table as it was. ``df`` must have the table's
    columns and ``fmt`` its format. The old files stay.
    """
    write_directory(df, path, fmt)
    spark = df.sparkSession
    spark.sql(f"ALTER TABLE {quoted(table)} SET LOCATION {sql_text(path)}")
    spark.catalog.refreshTable(quoted(table))


def store_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed now and read back from the shared folder.

    For a frame that feeds several outputs, each of which would compute it
    again. What is stored outlives lost executors; it stays until the folder is
    cleaned, as checkpoints do.
    """
    path = scratch_path(df.sparkSession, label)
    write_directory(df, path)
    return df.sparkSession.read.parquet(path)
