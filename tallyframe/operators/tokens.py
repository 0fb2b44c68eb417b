"""Counts over strings that hold a joined list of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import split_tokens
from tallyframe.operators.grouping import value_counts


def explode_tokens(
    df: DataFrame, column: str, name: str, separator: str = "|", null_as_empty: bool = False
) -> DataFrame:
    """One row per token of ``column``; repeated tokens stay.

    A null string yields no row, or one empty token with ``null_as_empty``, as
    text tables that cannot tell the two apart do.
    """
    text = F.coalesce(F.col(column), F.lit("")) if null_as_empty else F.col(column)
    return df.select(F.explode(split_tokens(text, separator)).alias(name))


def token_counts(
    df: DataFrame,
    column: str,
    name: str = "token",
    out: str = "count",
    separator: str = "|",
    null_as_empty: bool = False,
) -> DataFrame:
    """Occurrences of each token, most frequent first."""
    return value_counts(explode_tokens(df, column, name, separator, null_as_empty), F.col(name), name, out)
