"""The table behind a chart: keys on an axis, groups as series, summed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import numeric


def chart_aggregate(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    series: str | None = None,
    series_values: list | None = None,
    rest: str | None = None,
) -> DataFrame:
    """Sum of each value column per key, with one column per series if given.

    Give ``series_values`` when they are known: otherwise Spark runs one more
    job to find them, and fails above ``spark.sql.pivotMaxValues``. A series
    that is not listed, null included, fails the job, or goes into the column
    ``rest`` if that is given. A series column is named after the series value, and
    carries the value name too when there is more than one value column. Text
    values are read as numbers.
    """
    grouped = df.groupBy(*keys)
    if series is not None:
        if series_values is not None:
            listed = F.col(series).isin([v for v in series_values if v is not None])
            if None in series_values:
                listed = listed | F.col(series).isNull()
            listed = F.coalesce(listed, F.lit(False))
            if rest is None:
                unlisted = F.raise_error(F.concat(F.lit("series not listed: "), F.coalesce(F.col(series).cast("string"), F.lit("null"))))
                shown = F.when(listed, F.col(series)).otherwise(unlisted.cast(df.schema[series].dataType))
            else:
                shown = F.when(listed, F.col(series).cast("string")).otherwise(F.lit(rest))
                series_values = [*(v if v is None else str(v) for v in series_values), rest]
            grouped = df.withColumn("__series", shown).groupBy(*keys)
            series = "__series"
        grouped = grouped.pivot(series, series_values)
    return grouped.agg(*[F.sum(numeric(df, v)).alias(v) for v in values])


def chart_series(df: DataFrame, keys: list[str], value: str, series: str, out: str = "series") -> DataFrame:
    """Sum of ``value`` per key and series, with the series of a key in one map, ``out``.

    For series that are many or not known: no job looks for them first, none
    reaches the driver, and there is no limit to their number. Only partial
    sums, one row for each key and series, are gathered. The map is in the order of its
    text keys; a null series goes into the column ``rest``, which is null
    where a key has none. Text values are read as numbers.
    """
    name = F.col(series).cast("string").alias("_s")
    sums = df.groupBy(*keys, name).agg(F.sum(numeric(df, value)).alias("_v"))
    entry = F.when(F.col("_s").isNotNull(), F.struct("_s", "_v"))
    return sums.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out),
        F.max(F.when(F.col("_s").isNull(), F.col("_v"))).alias("rest"),
    )


def chart_from_spec(df: DataFrame, spec: dict, series_values: list | None = None) -> DataFrame:
    """The table for a saved chart: lists ``keys``, ``groups`` and ``values`` of named columns.

    Values are summed, and at most one group column makes the series.
    """
    keys, groups, values = ([field["name"] for field in spec.get(k) or []] for k in ("keys", "groups", "values"))
    other = {field.get("aggr", "sum") for field in spec.get("values") or []} - {"sum"}
    if other or len(groups) > 1:
        raise ValueError(f"unsupported chart: aggregates {sorted(other)}, groups {groups}")
    return chart_aggregate(df, keys, values, groups[0] if groups else None, series_values)
