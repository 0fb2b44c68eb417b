"""Sums of doubles that do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bin; three bins hold the 53 bits of any double.
BITS = 28
#: Smaller numbers are scaled up by so many bins first, so that no bin is below the smallest double.
TINY, SHIFT = 2.0**-800, 10


def _unit(bins: Column) -> Column:
    return F.pow(F.lit(2.0), bins * BITS)


def exact_sums(df: DataFrame, keys: list[str], value: str | Column, total: str = "total", count: str = "n") -> DataFrame:
    """Per key the ``total`` of a double, and the ``count`` of its values that are not null.

    Every number is cut into whole multiples of three fixed powers of two, which
    loses nothing. Those are whole numbers, so it does not matter which task
    adds what first. A group has less than 100 such bins; they are joined from
    the largest down. The total is therefore the same, to the last digit, for any order
    and partitioning of the rows. Without values it is null; NaN and infinities
    give what they give in any sum. A bin holds the sum of 2 ** 34 values; one
    that overflows fails the job.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    x = (value if isinstance(value, Column) else F.col(value)).cast("double")
    rows = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, ks, strict=True)), x.alias("x"))
    tiny, size = F.abs("x") < TINY, F.abs("x")
    rows = rows.withColumn("whole", F.coalesce((size > 0) & (size < float("inf")), F.lit(False)))
    rows = rows.withColumn("v", F.when(tiny, F.col("x") * 2.0 ** (BITS * SHIFT)).otherwise(F.col("x")))
    rows = rows.withColumn("b", F.when(F.col("whole"), F.floor(F.log2(F.abs("v")) / BITS).cast("int")))
    rest, pieces = F.col("v"), []
    for k in range(3):
        rows = rows.withColumn(f"p{k}", F.when(F.col("whole"), F.floor(rest / _unit(F.col("b") - k))))
        rows = rows.withColumn(f"r{k}", rest - F.col(f"p{k}").cast("double") * _unit(F.col("b") - k))
        rest = F.col(f"r{k}")
        place = F.col("b") - k - F.when(tiny, F.lit(SHIFT)).otherwise(0)
        first = F.lit(1 if k == 0 else 0).cast("bigint")
        pieces.append(F.struct(place.alias("bin"), F.col(f"p{k}").alias("piece"), first.alias("n"), F.lit(None).cast("double").alias("odd")))
    # Nulls, zeros, NaN and infinities have no bins.
    odd = F.when(~F.col("whole") & F.col("x").isNotNull() & (F.isnan("x") | (size > 0)), F.col("x"))
    alone = F.struct(F.lit(None).cast("int").alias("bin"), F.lit(None).cast("bigint").alias("piece"), F.col("x").isNotNull().cast("bigint").alias("n"), odd.alias("odd"))
    rows = rows.select(*ks, F.explode(F.when(F.col("whole"), F.array(*pieces)).otherwise(F.array(alone))).alias("e"))
    bins = rows.groupBy(*ks, F.col("e.bin").alias("bin"))
    bins = bins.agg(F.sum("e.piece").alias("s"), F.sum("e.n").alias("n"), F.sum("e.odd").alias("odd"))
    filled = F.when(F.col("bin").isNotNull(), F.struct((-F.col("bin")).alias("from_top"), F.col("s").alias("s")))
    groups = bins.groupBy(*ks).agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.array_sort(F.collect_list(filled)).alias("bins"))

    def worth(e: Column) -> Column:
        s = e["s"].cast("double")
        low = s * _unit(SHIFT - e["from_top"]) * 2.0 ** (-BITS * SHIFT)
        return F.when(e["from_top"] > 25, low).otherwise(s * _unit(-e["from_top"]))

    joined = F.aggregate("bins", F.lit(0.0), lambda a, e: a + worth(e))
    result = F.when(F.col("n") > 0, F.coalesce(F.col("odd"), joined))
    shown = [F.col(n).alias(k) for n, k in zip(ks, keys, strict=True)]
    return groups.select(*shown, result.alias(total), F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias(count))
