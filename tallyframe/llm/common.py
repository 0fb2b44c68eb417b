"""Helpers that several operators share: stored tables, columns with free names, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.skew import join_splitting_hot_keys
from tallyframe.session import scratch_path

# A word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


#: Rows of an Arrow batch that a task turns into Python objects at a time.
SLICE = 512


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``.

    An Arrow batch may hold ten thousand texts, and a worker keeps for its next
    tasks much of what it once took for them. What Arrow no longer uses is given
    back before the first batch and after the last.
    """
    pool = pa.default_memory_pool()
    pool.release_unused()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pool.release_unused()


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What follows does not depend on the executors that computed it: a lost
    executor costs its own tasks only.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(df: DataFrame, name: str) -> Column:
    """The column with exactly this name first, then in any case; ``name`` may hold dots."""
    for found in df.columns:
        if found == name:
            return df[f"`{found}`"]
    return df[f"`{name}`"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``nodes`` has ``node`` (long, distinct), ``links`` has ``a`` and ``b``; the
    result is one row per node with ``component``, the smallest node reachable.
    Every round shuffles the links with algebraic minima only, so a node with
    very many links is reduced on the map side, and its links meet the minimum in a
    join whose both sides are shuffled, which adaptive execution splits. Each round is stored; only two numbers per
    round reach the driver.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links"
    )
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        edges = stored(_small_star(_large_star(edges)), "links")
        after = _fingerprint(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("v").agg(F.min("m").alias("m"))
    return nodes.join(roots, nodes["node"] == roots["v"], "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    half = F.xxhash64("v", "m").bitwiseAND(F.lit((1 << 40) - 1))
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(half), F.lit(0))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest of its neighbours and itself."""
    both = edges.select("v", "m").union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    least = both.groupBy("v").agg(F.min("m").alias("low"))
    least = least.select("v", F.least("v", "low").alias("low"))
    joined = join_splitting_hot_keys(both.where("m > v"), least, "v")
    return joined.select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, with the smallest of them."""
    least = edges.groupBy("v").agg(F.min("m").alias("low"))
    joined = join_splitting_hot_keys(edges, least, "v")
    moved = joined.select(F.explode(F.array("m", "v")).alias("v"), F.col("low").alias("m"))
    return moved.where("v <> m").distinct()
