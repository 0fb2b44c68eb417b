import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe import operators


def numbers(seed=2):
    rng = random.Random(seed)
    rows = []
    for g, (low, high) in enumerate([(-5, 5), (-300, 300), (-1074, -1000), (900, 1000), (-30, 30), (0, 0), (-810, -790)]):
        rows += [(g, rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(low, high)) for _ in range(200)]
    rows += [(7, 0.0), (7, None), (12, 5e-324), (12, 5e-324), (13, 1e16), (13, 1.0), (13, -1e16), (14, -(2.0**28) + 2**-20)]
    return rows + [(15, 1.7e308), (15, -1.7e308), (15, 3.0), (None, 2.5)] + [(16, 2.0**k) for k in range(-60, 60)]


def test_sums_are_the_rounded_exact_ones_in_any_order(spark):
    rows = numbers()
    df = spark.createDataFrame(rows, "g int, v double")
    found = set()
    for parts in (1, 3, 8):
        shuffled = df.withColumn("r", F.rand(parts)).repartition(parts, "r").sortWithinPartitions("r")
        found.add(repr(sorted(map(tuple, operators.exact_sums(shuffled, ["g"], "v").collect()), key=repr)))
    assert len(found) == 1
    for g, total, n in operators.exact_sums(df, ["g"], "v").collect():
        values = [v for k, v in rows if k == g and v is not None]
        assert (total, n) == (math.fsum(values), len(values))


def test_sums_without_and_beyond_numbers(spark):
    inf = float("inf")
    df = spark.createDataFrame([(8, None), (9, inf), (9, 1.0), (10, inf), (10, -inf), (11, float("nan"))], "g int, v double")
    found = {r.g: (r.total, r.n) for r in operators.exact_sums(df, ["g"], "v").collect()}
    assert found[8] == (None, 0) and found[9] == (inf, 2) and found[10][1] == 2
    assert math.isnan(found[10][0]) and math.isnan(found[11][0])
    assert tuple(operators.exact_sums(df.limit(0), [], "v").first()) == (None, 0)
    assert operators.exact_sums(df.limit(0), ["g"], "v").count() == 0


def test_means_are_the_same_for_any_order(spark):
    df = spark.createDataFrame([("a", str(v)) for _, v in numbers(5)[:700]] + [("a", "bad"), ("b", None)], "k string, v string")
    found = {tuple(map(tuple, operators.avg_by_group(df.repartition(n), "k", "v", exact=True).collect())) for n in (1, 5, 7)}
    (rows,) = found
    values = [v for _, v in numbers(5)[:700]]
    assert rows == (("a", math.fsum(values) / len(values)), ("b", None))


def test_whole_sums_are_exact_or_fail(spark):
    same = lambda v: v
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v long")
    with pytest.raises(Exception, match="no bigint"):
        operators.map_and_sum(df, same, ["v"]).collect()
    df = spark.createDataFrame([(2**62,), (None,), (-(2**62),), (2**53 + 1,), (2**62,), (-1,)], "v long")
    assert operators.map_and_sum(df, same, ["v"]).first().total == 2**62 + 2**53
    assert operators.map_and_sum(df.limit(0), same, ["v"]).first().total == 0
    assert operators.map_and_sum(df.where("v IS NULL"), same, ["v"]).first().total == 0


def test_sums_of_a_function_do_not_depend_on_tasks(spark):
    df = spark.createDataFrame([(v,) for _, v in numbers(3)[:400]], "v double")
    totals = {operators.map_and_sum(df.repartition(1).repartition(n, "v"), lambda v: v, ["v"], kind="double").first().total for n in (1, 400)}
    assert len(totals) == 1


def test_very_many_series(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 20_011).alias("s"), F.lit(2).alias("v"))
    rows = operators.chart_series(df, ["k"], "v", "s").collect()
    assert len(rows) == 3 and sum(len(r.series) for r in rows) > 50_000
    assert sum(sum(r.series.values()) for r in rows) == 120_000


def test_series_of_nulls_and_text(spark):
    df = spark.createDataFrame([("x", "b", "1"), ("x", "a", "2"), ("x", None, "4"), ("y", "a", "bad"), (None, "a", "3")], "k string, s string, v string")
    found = {r.k: (r.series, r.rest) for r in operators.chart_series(df, ["k"], "v", "s").collect()}
    assert found == {"x": ({"a": 2.0, "b": 1.0}, 4.0), "y": ({"a": None}, None), None: ({"a": 3.0}, None)}
