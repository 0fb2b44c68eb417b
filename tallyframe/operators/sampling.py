"""A ratio of rows, and the sum of a Python function over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.exact import exact_sums


def ratio_estimate(rows: DataFrame, inside: Column, factor: float = 1.0) -> DataFrame:
    """One row: ``hits`` that satisfy ``inside``, ``n`` and ``factor * hits / n``."""
    return rows.agg(
        F.count_if(inside).alias("hits"), F.count(F.lit(1)).alias("n")
    ).withColumn("estimate", F.try_divide(F.lit(factor) * F.col("hits"), "n"))



def map_and_sum(
    df: DataFrame, fn: Callable, columns: list[str], out: str = "total", kind: str = "bigint"
) -> DataFrame:
    """Sum of a Python function over the rows, one partial sum per task.

    ``fn`` gets the named columns of an Arrow batch as pandas Series and
    returns a Series of numbers; whole-number columns come as pandas' nullable
    integers, so a null stays a null and no digit is lost. Results that are
    missing are skipped. ``kind`` is the type of the sum, ``bigint`` or
    ``double``. A ``bigint`` sum is exact: a fraction fails it, and so does a
    total that a bigint does not hold. Partial sums of doubles are added
    without regard to order. Prefer an expression where one exists.
    """
    if kind not in ("bigint", "double"):
        raise ValueError(f"sums are bigint or double, not {kind}")

    def partial_sums(batches):
        import math
        from decimal import Decimal

        import pandas as pd
        import pyarrow as pa

        whole = {t: d() for t, d in ((pa.int8(), pd.Int8Dtype), (pa.int16(), pd.Int16Dtype), (pa.int32(), pd.Int32Dtype), (pa.int64(), pd.Int64Dtype))}
        total, parts = 0, []
        for batch in batches:
            given = [batch.column(i).to_pandas(types_mapper=whole.get) for i in range(batch.num_columns)]
            values = fn(*given).dropna()
            if kind == "double":
                parts = [math.fsum([*parts, *values.astype("float64")])]
            elif pd.api.types.is_integer_dtype(values.dtype):
                # Halves of numbers add up to less than 2 ** 63 in any batch.
                numbers = values.to_numpy("int64")
                total += (int((numbers >> 32).sum()) << 32) + int((numbers & 0xFFFFFFFF).sum())
            else:
                if not (values % 1 == 0).all():
                    raise ValueError("the function gave a fraction; sum it as double")
                total += sum(map(int, values))
        part = pa.array([float(sum(parts))], pa.float64()) if kind == "double" else pa.array([Decimal(total)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([part], ["part"])

    parts = df.select(*columns).mapInArrow(partial_sums, f"part {'double' if kind == 'double' else 'decimal(38,0)'}")
    if kind == "double":
        return exact_sums(parts, [], "part", out, "n").select(F.coalesce(out, F.lit(0.0)).alias(out))
    total = F.coalesce(F.sum("part"), F.lit(0)).alias("part")
    too_large = F.raise_error(F.concat(F.lit("the sum is no bigint: "), F.col("part").cast("string"))).cast("bigint")
    return parts.agg(total).select(F.coalesce(F.col("part").try_cast("bigint"), too_large).alias(out))
