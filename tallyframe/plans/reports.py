"""The named reports, composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import suffix_window, title_year
from tallyframe.functions.times import epoch_year
from tallyframe.operators.grouping import avg_by_group, filtered_sum, group_count, value_counts
from tallyframe.operators.rated import rated_by_group
from tallyframe.operators.rows import limit_rows, top_k
from tallyframe.operators.tokens import token_counts

MIN_VOTES = 100


def top_rated_items(
    items: DataFrame,
    facts: DataFrame,
    key: str = "movieId",
    title: str = "title",
    value: str = "rating",
    more_votes_than: int = MIN_VOTES,
    k: int = 10,
) -> DataFrame:
    """Best mean value among titles with enough votes."""
    rated = rated_by_group(
        items, facts, item_key=key, fact_key=key, group=title, value=value,
        more_votes_than=more_votes_than,
    )
    return top_k(rated, k, "rate", title).select(title, "rate", "votes")


def rated_items(
    items: DataFrame,
    facts: DataFrame,
    key: str = "movieId",
    title: str = "title",
    value: str = "rating",
    more_votes_than: int | None = MIN_VOTES,
    count: str = "values",
) -> DataFrame:
    """All titles with enough votes, best first; unrated ones take part."""
    rated = rated_by_group(
        items, facts, item_key=key, fact_key=key, group=title, value=value,
        how="left", count=count, more_votes_than=more_votes_than,
    )
    return rated.orderBy(F.desc("rate"), F.asc(title))


def items_per_token(items: DataFrame, column: str = "genres", name: str = "genre") -> DataFrame:
    """Titles per genre, most frequent first."""
    return token_counts(items, column, name)


def items_per_suffix(items: DataFrame, title: str = "title") -> DataFrame:
    """Titles per production year, cut from a fixed place at the end of the title."""
    return value_counts(items, suffix_window(title, 5, 4), "year")


def items_per_year(items: DataFrame, title: str = "title") -> DataFrame:
    """Titles per production year, read from the closing bracket; null without one."""
    return value_counts(items, title_year(title), "year")


def records_per_year(
    records: DataFrame, seconds: str = "timestamp", zone: str = "UTC", first: int | None = None
) -> DataFrame:
    """Records per calendar year of an epoch column in order, all or the ``first`` years."""
    counts = group_count(records, epoch_year(F.col(seconds), zone).alias("year"))
    return counts.orderBy("year") if first is None else limit_rows(counts, first, "year")


def trips_per_pair(trips: DataFrame, first: str, second: str) -> DataFrame:
    """Rows per pair of columns, such as vendor and passenger count."""
    return group_count(trips, first, second)


def amount_per_zone(trips: DataFrame, zone: str, amount: Column | str, below: int = 25) -> DataFrame:
    """Amount per zone with a number under ``below``."""
    return filtered_sum(trips, zone, amount, below, "amount")


def mean_per_group(rows: DataFrame, key: str, value: str, exact_scale: int | None = None) -> DataFrame:
    """Mean value per key, such as price per colour."""
    return avg_by_group(rows, key, value, value, exact_scale)
