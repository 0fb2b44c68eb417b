"""A reproducible shuffle: a Feistel permutation with cycle walking over global row numbers.

Only DataFrame functions are used. The permutation is a formula, so the shard
and slot of any row number can be computed without reading the data, and the
inverse names the row number at any shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import col, stored

ROUNDS = 8
#: A walk leaves the numbers outside the range with a chance of at least one half per step.
MAX_WALK = 64
#: Rows of one numbering bucket are sorted by one task; buckets are hashes of distinct rows.
BUCKETS = 4096
#: Equal rows are dealt out in blocks of at most this many.
BLOCK = 10_000


def _widths(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def _network(x: Column, n: int, seed: int, backwards: bool) -> Column:
    """One pass of the network over the numbers below a power of two, at most ``2 * n``."""
    high, low = _widths(n)
    order = list(range(ROUNDS))[:: -1 if backwards else 1]

    def one_round(half: Column, key: Column) -> Column:
        def mixed(value: Column, bits: int) -> Column:
            return F.xxhash64(value, key, F.lit(seed)).bitwiseAND(F.lit((1 << bits) - 1))

        left, right = half["left"], half["right"]
        return F.when(
            key % 2 == 0, F.struct(left.bitwiseXOR(mixed(right, high)).alias("left"), right.alias("right"))
        ).otherwise(F.struct(left.alias("left"), right.bitwiseXOR(mixed(left, low)).alias("right")))

    start = F.struct(
        F.shiftright(x, low).alias("left"), x.bitwiseAND(F.lit((1 << low) - 1)).cast("bigint").alias("right")
    )
    return F.aggregate(
        F.array(*map(F.lit, order)),
        start,
        one_round,
        lambda half: F.shiftleft(half["left"], low) + half["right"],
    )


def permuted(x: Column, n: int, seed: int = 0, backwards: bool = False) -> Column:
    """Where row number ``x`` of ``n`` goes, or, backwards, which row number comes to ``x``.

    The network permutes a power of two that is below ``2 * n``. A result of
    ``n`` or more is sent through again until it is smaller, which keeps the
    whole a permutation of the numbers below ``n``. A walk above ``MAX_WALK``
    steps has a chance below 2 ** -63 and fails the job.
    """
    if n < 2:
        return x.cast("bigint")
    x = x.cast("bigint")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)),
        _network(x, n, seed, backwards),
        lambda p, _: F.when(p < n, p).otherwise(_network(p, n, seed, backwards)),
    )
    return F.transform(
        F.array(walked), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("the walk did not end")).cast("bigint"))
    )[0]


def numbered(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows reduced to ``columns`` with a global ``row_number`` from 0, and how many there are.

    Numbers depend on the values alone, not on files or partitions. Equal rows
    are counted first, so however many there are they cost one row up to the
    end; their numbers are consecutive. No window spans the whole table: the
    one without a key sees one row per numbering bucket.
    """
    names = [f"c{i}" for i in range(len(columns))]
    picked = df.select(*(col(df, c).alias(n) for c, n in zip(columns, names, strict=True)))
    counted = picked.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS))
    rows = stored(counted.withColumn("bucket", bucket), "rows")
    totals = rows.groupBy("bucket").agg(F.sum("copies").alias("n"))
    total, most = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    before = F.expr("sum(n) over (order by bucket rows between unbounded preceding and 1 preceding)")
    starts = totals.select(F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    order = ", ".join(names)
    within = F.expr(
        f"sum(copies) over (partition by bucket order by {order} rows between unbounded preceding and 1 preceding)"
    )
    ranked = rows.withColumn("within", F.coalesce(within, F.lit(0)))
    placed = ranked.join(starts, F.col("bucket") == F.col("b"), "left")
    placed = placed.select(*names, "copies", (F.col("start") + F.col("within")).alias("first"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(BLOCK).cast("bigint"))
    placed = placed.withColumn("block", F.explode(blocks))
    if most > BLOCK:
        placed = placed.repartition("first", "block")
    last = F.least(F.col("copies"), F.col("block") + BLOCK) - 1
    placed = placed.withColumn("nth", F.explode(F.sequence("block", last)))
    result = placed.select(
        *(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)),
        (F.col("first") + F.col("nth")).alias("row_number"),
    )
    return result, total


def place(row_number: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """Shard and slot of a row number: shards differ by one row at most, slots have no gap."""
    both = F.transform(
        F.array(permuted(row_number, n, seed)),
        lambda to: F.struct(F.pmod(to, F.lit(shards)).cast("int").alias("shard"), F.call_function("div", to, F.lit(shards)).alias("slot")),
    )[0]
    return both["shard"], both["slot"]


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number at a shard and slot; the inverse of ``place``."""
    return permuted(slot.cast("bigint") * shards + shard, n, seed, backwards=True)


def shard_rows(df: DataFrame, columns: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Deal the rows of a frame, reduced to ``columns``, into shards in a reproducible random order.

    Returns ``columns`` and ``row_number``, ``shard``, ``slot``. Rows are told
    apart by ``columns`` alone: repeated rows each get a place of their own,
    and nulls are values like any other. An empty frame gives no rows. Other
    columns of the frame, whatever their names, are not read.
    """
    rows, n = numbered(df, columns)
    shard, slot = place(F.col("row_number"), n, shards, seed)
    return rows.select(*(F.col(f"`{c}`") for c in columns), "row_number", shard.alias("shard"), slot.alias("slot"))
