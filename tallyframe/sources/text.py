"""File scans and in-memory rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    *,
    names: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = False,
    encoding: str = "UTF-8",
    quote: str = '"',
    escape: str = "\\",
    multiline: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Scan separated text.

    With a ``schema`` the scan is one lazy pass that reads only the columns a
    query needs. Without one Spark infers types, which is an extra pass over
    all lines when this function is called; ``names`` then
    replaces the column names by position. A line with a bad value keeps its
    other columns. Pass ``quote=""`` for text without quoting rules, and
    ``multiline`` if quoted fields hold line breaks: each file is then read by
    one task, so write such text in files of moderate size.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("header", header)
        .option("encoding", encoding)
        .option("quote", quote)
        .option("escape", escape)
        .option("multiLine", multiline)
    )
    if multiline:
        # Otherwise the separator is guessed from the first line end in the text.
        reader = reader.option("lineSep", "\n")
    reader = reader.options(**(options or {}))
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    return df.toDF(*names) if names else df


def read_parquet(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Scan parquet; the schema comes from one file's footer unless it is given."""
    reader = spark.read.options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def frame_from_rows(spark: SparkSession, rows: Iterable, schema: StructType | str) -> DataFrame:
    """A DataFrame from rows already held by the driver, such as a fetched preview."""
    return spark.createDataFrame(list(rows), schema)
