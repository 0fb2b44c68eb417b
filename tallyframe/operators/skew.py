"""Equi-join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _comparable(left: DataFrame, right: DataFrame, key: str) -> Column:
    """The key in the type in which Spark would compare the two columns."""
    types = [df.select(key).schema[0].dataType for df in (left, right)]
    if types[0] == types[1]:
        return F.col(key)
    both = F.coalesce(*[F.lit(None).cast(t) for t in types])
    return F.col(key).try_cast(left.select(both.alias(key)).schema[0].dataType)


def join_splitting_hot_keys(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``right`` is an aggregate with one row per key.

    Adaptive execution splits a hot or null key of ``left`` over several tasks,
    but only if both inputs reach the join through a shuffle of their own. An
    aggregate is already partitioned by its key and would be joined in place,
    with no split. A hash of the key as a second join column is met by no
    existing partitioning, so the one row per key moves once more and the split
    becomes possible. A ``right`` that turns out small is broadcast instead.
    Both the split and the second shuffle are Spark's defaults
    (``spark.sql.adaptive.enabled``, ``spark.sql.requireAllClusterKeysForCoPartition``).

    Keys of different types are compared as Spark compares them, except that
    text which is no number matches nothing instead of failing the job.
    """
    # Equal numbers of different types have different hashes, so cast first.
    common = _comparable(left, right, key)
    hashed = {key: common, "_hash": F.xxhash64(common)}
    return left.withColumns(hashed).join(right.withColumns(hashed), list(hashed), how).drop("_hash")
