import random
from collections import defaultdict

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tallyframe.operators import join_splitting_hot_keys, rated_by_group
from tallyframe.plans import rated_items, top_rated_items

NAMES = {"item_key": "movieId", "fact_key": "movieId", "group": "title", "value": "rating"}


def as_dict(df):
    return {r.title: (r.votes, r.rate) for r in df.collect()}


def test_left_counts_of_rows_and_values_differ_for_unrated_titles(movies, ratings):
    rows = as_dict(rated_by_group(movies, ratings, **NAMES, how="left", count="rows"))
    values = as_dict(rated_by_group(movies, ratings, **NAMES, how="left", count="values"))
    assert {t: v for t, (v, _) in rows.items()} == {
        "Toy Story (1995)": 3, "Oldboy (2005)": 1, '"Quoted" Film (2005)': 1, "Café (2001) ": 1, "abc": 1,
    }
    assert {t: v for t, (v, _) in values.items()} == {
        "Toy Story (1995)": 2, "Oldboy (2005)": 1, '"Quoted" Film (2005)': 0, "Café (2001) ": 0, "abc": 0,
    }
    assert rows["Toy Story (1995)"][1] == 4.5 and rows["abc"][1] is None


def test_inner_join_keeps_rated_titles_only(movies, ratings):
    assert as_dict(rated_by_group(movies, ratings, **NAMES)) == {
        "Toy Story (1995)": (2, 4.5), "Oldboy (2005)": (1, 3.5),
    }


def test_grouping_by_key_and_title_keeps_items_apart(movies, ratings):
    names = {**NAMES, "group": ["movieId", "title"]}
    rated = rated_by_group(movies, ratings, **names, how="left", count="rows")
    assert rated.columns == ["movieId", "title", "votes", "rate"]
    found = {r.movieId: r.votes for r in rated.where("title LIKE 'Toy%'").collect()}
    assert found == {1: 2, 6: 1}


def test_names_match_in_any_case(movies, ratings):
    rated = rated_by_group(
        movies, ratings, item_key="movieid", fact_key="MOVIEID", group="Title", value="RATING"
    )
    assert {(r.Title, r.votes) for r in rated.collect()} == {("Toy Story (1995)", 2), ("Oldboy (2005)", 1)}


def test_text_columns_compare_and_average_as_numbers(spark, movies, ratings):
    text = ratings.select(
        F.col("movieId").cast("string").alias("movieId"),
        F.when(F.col("rating") == 4, "bad").otherwise(F.col("rating").cast("string")).alias("rating"),
    )
    assert as_dict(rated_by_group(movies, text, **NAMES)) == {
        "Toy Story (1995)": (2, 5.0), "Oldboy (2005)": (1, 3.5),
    }


@pytest.mark.parametrize("kinds", [("int", "bigint"), ("bigint", "int"), ("int", "string"), ("double", "int")])
def test_keys_of_different_types_meet(spark, kinds):
    left = spark.range(5).select(F.col("id").cast(kinds[0]).alias("k"))
    right = spark.range(3, 9).select(F.col("id").cast(kinds[1]).alias("k"), F.lit(1).alias("v"))
    assert sorted(r.k for r in join_splitting_hot_keys(left, right, "k").collect()) == [3, 4]


def brute_force(items, facts, how, count):
    by_key = defaultdict(list)
    for key, value in facts:
        if key is not None:
            by_key[key].append(value)
    joined = defaultdict(list)
    for key, title in items:
        matches = by_key.get(key) if key is not None else None
        if matches:
            joined[title].extend((True, v) for v in matches)
        elif how == "left":
            joined[title].append((False, None))
    result = {}
    for title, rows in joined.items():
        values = [v for _, v in rows if v is not None]
        votes = len(rows) if count == "rows" else len(values)
        result[title] = (votes, sum(values) / len(values) if values else None)
    return result


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("count", ["rows", "values"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force_with_hot_keys_nulls_and_duplicates(spark, conf, how, count, broadcast):
    if not broadcast:
        conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rnd = random.Random(f"{how}{count}")
    keys = [None, 0, 0, 0, *range(12)]
    items = [(rnd.choice(keys), rnd.choice("abcdef")) for _ in range(60)]
    facts = [(rnd.choice(keys), rnd.choice([None, 0.5, 1.0, 2.5, 4.0])) for _ in range(200)]
    rated = rated_by_group(
        spark.createDataFrame(items, "movieId int, title string"),
        spark.createDataFrame(facts, "movieId bigint, rating double"),
        **NAMES, how=how, count=count,
    )
    assert as_dict(rated) == brute_force(items, facts, how, count)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_item_key_is_split_over_tasks(spark, conf, how):
    """A third of the items share one key and another third have none."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.0")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    conf("spark.sql.shuffle.partitions", "8")
    n = 60_000
    items = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("movieId"),
        F.concat(F.lit("t"), F.col("id") % 1000).alias("title"),
    )
    facts = spark.range(0, n).select((F.col("id") % 100).alias("movieId"), F.lit(1.0).alias("rating"))
    rated = rated_by_group(items, facts, **NAMES, how=how, count="values")
    expected = n // 3 * 600 + sum(600 for k in range(100) if k % 3 == 1)
    assert sum(r.votes for r in rated.collect()) == expected
    assert "skew=true" in plan_of(rated)


def test_facts_are_aggregated_before_the_join(spark, conf, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.range(10).select(F.col("id").alias("movieId"), F.lit(1.0).alias("rating"), F.lit("x").alias("note")) \
        .write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    items = spark.range(10).select(F.col("id").alias("movieId"), F.lit("t").alias("title"))
    plan = plan_of(top_rated_items(items, facts, more_votes_than=0))
    assert "ReadSchema: struct<movieId:bigint,rating:double>" in plan
    assert "partial_sum(rating" in plan and "TakeOrderedAndProject" in plan


def test_top_and_full_report_order(movies, ratings):
    top = top_rated_items(movies, ratings, more_votes_than=0, k=1).collect()
    assert [(r.title, r.rate, r.votes) for r in top] == [("Toy Story (1995)", 4.5, 2)]
    full = rated_items(movies, ratings, more_votes_than=None).collect()
    assert [r.title for r in full] == [
        "Toy Story (1995)", "Oldboy (2005)", '"Quoted" Film (2005)', "Café (2001) ", "abc",
    ]
    assert [r.title for r in rated_items(movies, ratings, more_votes_than=1).collect()] == ["Toy Story (1995)"]
    by_rows = rated_items(movies, ratings, more_votes_than=2, count="rows").collect()
    assert [(r.title, r.votes) for r in by_rows] == [("Toy Story (1995)", 3)]


def test_unknown_arguments_are_refused(movies, ratings):
    with pytest.raises(ValueError):
        rated_by_group(movies, ratings, **NAMES, how="right")
    with pytest.raises(ValueError):
        rated_by_group(movies, ratings, **NAMES, count="distinct")
