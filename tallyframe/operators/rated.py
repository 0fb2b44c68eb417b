"""Votes and mean value per group over a one-to-many join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import numeric
from tallyframe.operators.skew import join_splitting_hot_keys


def rated_by_group(
    items: DataFrame,
    facts: DataFrame,
    *,
    item_key: str,
    fact_key: str,
    group: str | list[str],
    value: str,
    how: str = "inner",
    count: str = "rows",
    votes: str = "votes",
    rate: str = "rate",
    more_votes_than: int | None = None,
) -> DataFrame:
    """``votes`` and ``rate`` (mean of ``value``) per ``group`` of ``items``.

    Same rows as joining ``items`` to ``facts`` and then grouping, but the facts
    are first aggregated to one row per key, which collapses a popular key on
    the map side, and only that row is joined.

    ``how`` is ``inner`` or ``left``. ``count="rows"`` counts joined rows, so an
    item without facts counts 1 in a left join; ``count="values"`` counts values
    that are present, so it counts 0. Groups are formed by the value of
    ``group``: items with different keys and the same title merge, unless the
    key is one of the group columns. A string ``value`` is read as a number, and
    text that is none counts as missing.
    """
    if how not in ("inner", "left") or count not in ("rows", "values"):
        raise ValueError(f"unsupported: how={how!r}, count={count!r}")
    measure = numeric(facts, value)
    per_key = (
        facts.where(F.col(fact_key).isNotNull())
        .groupBy(F.col(fact_key).alias("_key"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(measure).alias("_values"),
            F.sum(measure).alias("_total"),
        )
    )
    groups = [group] if isinstance(group, str) else group
    per_item = items.select(F.col(item_key).alias("_key"), *groups)
    joined = join_splitting_hot_keys(per_item, per_key, "_key", how)
    present = F.sum(F.coalesce("_values", F.lit(0)))
    joined_rows = F.sum(F.coalesce("_rows", F.lit(1)))
    result = (
        joined.groupBy(*groups)
        .agg(
            (joined_rows if count == "rows" else present).alias(votes),
            present.alias("_present"),
            F.sum("_total").alias("_sum"),
        )
        .select(*groups, votes, F.try_divide(F.col("_sum").cast("double"), "_present").alias(rate))
    )
    return result if more_votes_than is None else result.where(F.col(votes) > more_votes_than)
