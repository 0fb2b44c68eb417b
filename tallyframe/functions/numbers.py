"""Columns of all-string tables as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame, column: str) -> Column:
    """The column, read as a number if it is text; text that is no number is null."""
    kind = df.select(column).schema[0].dataType
    return F.col(column).try_cast("double") if isinstance(kind, T.StringType) else F.col(column)
