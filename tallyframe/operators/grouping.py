"""Single-table grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import numeric
from tallyframe.operators.exact import exact_sums


def group_count(df: DataFrame, *keys: str | Column, out: str = "count") -> DataFrame:
    """Rows per combination of ``keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def value_counts(df: DataFrame, key: Column, name: str, out: str = "count") -> DataFrame:
    """Rows per value of an expression, most frequent first, ties by the value."""
    return group_count(df, key.alias(name), out=out).orderBy(F.desc(out), F.asc(name))


def filtered_sum(df: DataFrame, key: str, value: Column | str, below: int | float, out: str) -> DataFrame:
    """Sum of ``value`` per ``key`` under ``below``, in key order; null keys drop.

    Text columns are read as numbers.
    """
    total = F.sum(numeric(df, value) if isinstance(value, str) else value)
    number = numeric(df, key)
    return df.where(number < below).groupBy(number.alias(key)).agg(total.alias(out)).orderBy(key)


def avg_by_group(
    df: DataFrame, key: str, value: str, out: str = "avg", exact_scale: int | None = None, exact: bool = False
) -> DataFrame:
    """Mean of ``value`` per ``key``, in key order; missing values are skipped.

    String values are read as numbers and bad text counts as missing. A sum of
    doubles depends on the order in which tasks finish; ``exact_scale`` adds up
    decimals with that many places instead, which gives the same mean each run.
    A number that such a decimal does not hold, because it has more places (the
    last digits of a double apart), is too large or not finite, fails the job.
    ``exact`` does the same for any doubles, by ``exact_sums``, at the price of
    three rows for each.
    """
    number = F.col(value).try_cast("double")
    if exact:
        sums = exact_sums(df, [key], number, "_total", "_n")
        return sums.select(key, F.try_divide("_total", "_n").alias(out)).orderBy(key)
    if exact_scale is not None:
        kind = f"decimal(38,{exact_scale})"
        exact = F.col(value).try_cast(kind)
        same = F.abs(exact.cast("double") - number) <= 1e-12 * F.greatest(F.abs(number), F.lit(1.0))
        lost = F.raise_error(F.concat(F.lit(f"more than {exact_scale} places or too large: "), number.cast("string")))
        number = F.when(same, exact).when(number.isNotNull(), lost.cast(kind))
    mean = F.try_divide(F.sum(number).cast("double"), F.count(number))
    return df.groupBy(key).agg(mean.alias(out)).orderBy(key)
