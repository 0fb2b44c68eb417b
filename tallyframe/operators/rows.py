"""Row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First ``n`` rows; without an order, any ``n`` rows (a preview).

    The ``n`` rows meet in one task, so this is for previews and reports.
    """
    return (df.orderBy(*order) if order else df).limit(n)


def top_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """``k`` rows with the largest ``by``; ``ties`` settle equal values."""
    return limit_rows(df, k, F.desc(by), *[F.asc(t) for t in ties])


def contains_text(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose ``column`` contains ``text``, case-sensitive and literal."""
    return df.where(F.col(column).contains(text))
