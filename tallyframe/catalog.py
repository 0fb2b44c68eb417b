"""Catalogs, schemas, tables and views.

These touch metadata only, except that dropping a managed table removes its
files. Names may be qualified: ``schema.table`` or ``catalog.schema.table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A possibly qualified name as a SQL identifier."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def register_view(df: DataFrame, name: str) -> None:
    """Make ``df`` visible to SQL in this session, replacing an older view."""
    df.createOrReplaceTempView(name)


def register_catalog(
    spark: SparkSession, name: str, implementation: str, options: dict[str, str] | None = None
) -> bool:
    """Define a catalog unless the name is taken; tells whether it was new.

    Spark has no SQL statement for this. The implementation is loaded when the
    catalog is first used.
    """
    setting = f"spark.sql.catalog.{name}"
    if spark.conf.get(setting, None):
        return False
    for key, value in (options or {}).items():
        spark.conf.set(f"{setting}.{key}", value)
    spark.conf.set(setting, implementation)
    return True


def unregister_catalog(spark: SparkSession, name: str) -> None:
    """Take back the settings of a catalog that ``register_catalog`` defined."""
    setting = f"spark.sql.catalog.{name}"
    for key in [k for k in spark.conf.getAll if k == setting or k.startswith(f"{setting}.")]:
        spark.conf.unset(key)


def switch_catalog(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentCatalog(name)


def current_catalog(spark: SparkSession) -> str:
    return spark.catalog.currentCatalog()


def list_catalogs(spark: SparkSession) -> DataFrame:
    """Column ``catalog``; Spark lists the catalogs used so far in the session."""
    return spark.sql("SHOW CATALOGS").toDF("catalog")


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a schema unless it exists, at ``location`` if one is given."""
    place = f" LOCATION {sql_text(location)}" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name)}{place}")


def use_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"USE {quoted(name)}")


def list_schemas(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    """Column ``schema``, for the current catalog or a named one."""
    source = f" IN {quoted(catalog)}" if catalog else ""
    return spark.sql(f"SHOW SCHEMAS{source}").toDF("schema")


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Column ``table``, for the current schema or a named one, without views of the session."""
    source = f" IN {quoted(schema)}" if schema else ""
    found = spark.sql(f"SHOW TABLES{source}")
    return found.where(~F.col("isTemporary")).select(F.col("tableName").alias("table"))


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """Columns first, then an empty row and details such as location and provider."""
    return spark.sql(f"DESCRIBE EXTENDED {quoted(table)}")


def drop_table(spark: SparkSession, table: str, if_exists: bool = True) -> None:
    """Remove a table; the files of an external table stay."""
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{quoted(table)}")


def drop_schema(spark: SparkSession, name: str, if_exists: bool = True, cascade: bool = False) -> None:
    """Remove a schema; one that still holds tables is refused unless ``cascade``."""
    spark.sql(f"DROP SCHEMA {'IF EXISTS ' if if_exists else ''}{quoted(name)}{' CASCADE' if cascade else ''}")
