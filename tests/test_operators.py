from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tallyframe import operators, plans
from tallyframe.sources import read_delimited


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_token_counts_repeat_tokens_and_drop_null(movies):
    assert pairs(plans.items_per_token(movies)) == [
        ("Drama", 2), ("(no genres listed)", 1), ("Action", 1), ("Adventure", 1),
        ("Animation", 1), ("Children", 1), ("Comedy", 1),
    ]


def test_null_may_count_as_one_empty_token(movies):
    counts = dict(pairs(operators.token_counts(movies, "genres", null_as_empty=True)))
    assert counts[""] == 1


def test_items_per_suffix_orders_ties_by_value(movies):
    assert pairs(plans.items_per_suffix(movies)) == [("1995", 2), ("2005", 2), ("001)", 1), ("ab", 1)]


def test_records_per_year_in_order(spark, ratings, files):
    assert pairs(plans.records_per_year(ratings)) == [(1996, 1), (2005, 3)]
    assert pairs(plans.records_per_year(ratings, first=1)) == [(1996, 1)]
    tags = read_delimited(spark, files["tags"], "userId int, movieId int, tag string, timestamp bigint", sep="@")
    assert pairs(plans.records_per_year(tags, first=None)) == [(2005, 2)]


def test_contains_is_literal_case_sensitive_and_pushed_down(spark, movies, tmp_path):
    assert [r.movieId for r in operators.contains_text(movies, "title", "2005").collect()] == [2, 3]
    assert operators.contains_text(movies, "title", "OLD").count() == 0
    assert operators.contains_text(movies, "title", "(2005)").count() == 2
    movies.write.parquet(str(tmp_path / "m"))
    plan = plan_of(operators.contains_text(spark.read.parquet(str(tmp_path / "m")), "title", "2005").select("movieId"))
    assert "StringContains(title,2005)" in plan and "ReadSchema: struct<movieId:int,title:string>" in plan


def test_filtered_sum_drops_null_keys(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (30, 9.0), (None, 5.0), (2, None)], "zone int, amount double")
    assert pairs(plans.amount_per_zone(df, "zone", "amount")) == [(1, 5.0), (2, None)]


def test_text_columns_are_summed_as_numbers(spark):
    rows = [("3", "1.5"), ("3", "2"), ("30", "9"), ("x", "5"), ("10", "bad"), (None, "1")]
    df = spark.createDataFrame(rows, "zone string, amount string")
    assert pairs(plans.amount_per_zone(df, "zone", "amount")) == [(3.0, 3.5), (10.0, None)]
    assert set(pairs(operators.chart_aggregate(df, ["zone"], ["amount"]))) == {
        ("3", 3.5), ("30", 9.0), ("x", 5.0), ("10", None), (None, 1.0),
    }


def test_group_count_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, None)], "a int, b int")
    assert set(pairs(plans.trips_per_pair(df, "a", "b"))) == {(1, 1, 1), (1, None, 2)}


def test_avg_skips_missing_and_bad_text(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "x"), ("b", "n/a"), ("b", None)], "k string, v string")
    assert pairs(plans.mean_per_group(df, "k", "v")) == [("a", 1.5), ("b", None)]


def test_exact_avg_does_not_depend_on_row_order(spark):
    values = [0.1 * i for i in range(1000)]
    results = set()
    for order in (values, values[::-1], sorted(values, key=lambda v: hash(str(v)))):
        df = spark.createDataFrame([("a", v) for v in order], "k string, v double").repartition(7)
        results.add(operators.avg_by_group(df, "k", "v", exact_scale=2).first()["avg"])
    assert results == {49.95}


def test_limit_with_and_without_order(spark):
    df = spark.range(100)
    assert [r.id for r in operators.limit_rows(df, 3, F.desc("id")).collect()] == [99, 98, 97]
    assert operators.limit_rows(df, 3).count() == 3


def test_chart_tables(spark):
    df = spark.createDataFrame([("x", "F", 1, 10), ("x", "O", 2, 20), ("y", "F", 3, 30), ("y", "F", 4, 40)],
                               "k string, s string, v int, w int")
    assert set(pairs(operators.chart_aggregate(df, ["k"], ["v", "w"]))) == {("x", 3, 30), ("y", 7, 70)}
    pivoted = operators.chart_aggregate(df, ["k"], ["v"], "s", ["F", "O"])
    assert pivoted.columns == ["k", "F", "O"] and set(pairs(pivoted)) == {("x", 1, 2), ("y", 7, None)}
    found = operators.chart_aggregate(df, ["k"], ["v", "w"], "s")
    assert found.columns == ["k", "F_v", "F_w", "O_v", "O_w"]


def test_chart_from_a_saved_spec(spark):
    df = spark.createDataFrame([("x", "F", 1), ("x", "O", 2)], "k string, s string, v int")
    spec = {"keys": [{"name": "k"}], "groups": [{"name": "s"}], "values": [{"name": "v", "aggr": "sum"}]}
    assert pairs(operators.chart_from_spec(df, spec, ["F", "O"])) == [("x", 1, 2)]
    assert pairs(operators.chart_from_spec(df, {**spec, "groups": []})) == [("x", 3)]
    with pytest.raises(ValueError):
        operators.chart_from_spec(df, {**spec, "values": [{"name": "v", "aggr": "avg"}]})


def test_ratio_of_rows(spark):
    found = operators.ratio_estimate(spark.range(10), F.col("id") < 4).first()
    assert (found.hits, found.n, found.estimate) == (4, 10, 0.4)
    assert operators.ratio_estimate(spark.range(0), F.col("id") < 4).first().estimate is None


def test_sums_keep_the_declared_type(spark):
    quarters = lambda ids: ids * 0.25
    assert operators.map_and_sum(spark.range(0, 10, 1, 3), quarters, ["id"], kind="double").first().total == 11.25
    with pytest.raises(Exception, match="fraction"):
        operators.map_and_sum(spark.range(10), quarters, ["id"]).collect()


@pytest.mark.parametrize("values", [[1.005, 2.005, 1e27], [0.001, 0.002], [1.0, float("nan")], [1.0, 1e40]])
def test_exact_means_lose_nothing_silently(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    with pytest.raises(Exception, match="places or too large"):
        operators.avg_by_group(df, "k", "v", exact_scale=2).collect()


def test_series_that_are_not_listed(spark):
    df = spark.createDataFrame([("x", "F", 1), ("x", "O", 2), ("x", "N", 4), ("x", None, 8)], "k string, s string, v int")
    with pytest.raises(Exception, match="not listed"):
        operators.chart_aggregate(df, ["k"], ["v"], "s", ["F", "O"]).collect()
    assert pairs(operators.chart_aggregate(df, ["k"], ["v"], "s", ["F", "O"], rest="rest")) == [("x", 1, 2, 12)]
    assert operators.chart_aggregate(df.where("s <> 'N'"), ["k"], ["v"], "s", ["F", "O", None]).count() == 1


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_python_function_is_summed_per_task(spark, n):
    df = spark.range(0, n, 1, 4).withColumn("two", F.lit(2))
    total = operators.map_and_sum(df, lambda i, two: i % 3 * two, ["id", "two"]).first().total
    assert total == sum(i % 3 * 2 for i in range(n))


def test_a_lost_task_is_repeated_and_counted_once(spark):
    def fails_at_first(ids):
        from pyspark import TaskContext

        task = TaskContext.get()
        if task.attemptNumber() == 0 and task.partitionId() % 2:
            raise RuntimeError("lost")
        return ids

    assert operators.map_and_sum(spark.range(0, 1000, 1, 4), fails_at_first, ["id"]).first().total == 499_500


def test_a_hot_group_is_collapsed_before_the_shuffle(spark):
    df = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("genres"))
    counts = plans.items_per_token(df)
    assert pairs(counts) == [("hot", 20_000), ("cold", 10_000)]
    assert "partial_count(1)" in plan_of(counts)


def test_token_counts_match_python(spark):
    words = ["a|b", "b|c|c", None, "", "a"]
    df = spark.createDataFrame([(w,) for w in words * 5], "g string")
    expected = Counter(t for w in words * 5 if w is not None for t in w.split("|"))
    assert dict(pairs(operators.token_counts(df, "g"))) == dict(expected)
