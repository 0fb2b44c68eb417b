"""Whole sessions: read, register, store, report, clean up."""

import os

import pytest
from pyspark.sql import functions as F

from tallyframe import catalog, operators, plans, sinks, sources


@pytest.fixture
def schema(spark, tmp_path):
    before = spark.catalog.currentDatabase()
    catalog.create_schema(spark, "flow", str(tmp_path / "flow"))
    catalog.use_schema(spark, "flow")
    yield "flow"
    catalog.use_schema(spark, before)
    catalog.drop_schema(spark, "flow", cascade=True)


def test_text_files_to_tables_to_reports(spark, schema, files):
    columns = {
        "movies": ["movieId", "title", "genres"],
        "ratings": ["userId", "movieId", "rating", "timestamp"],
        "tags": ["userId", "movieId", "tag", "timestamp"],
    }
    for name, names in columns.items():
        view = f"{name}_read"
        catalog.register_view(sources.read_delimited(spark, files[name], sep="@", names=names), view)
        sinks.refresh_table(spark.table(view), f"{schema}.{name}")
        spark.catalog.dropTempView(view)
    assert sorted(r.table for r in catalog.list_tables(spark).collect()) == ["movies", "ratings", "tags"]
    movies, ratings, tags = (spark.table(f"spark_catalog.{schema}.{n}") for n in columns)
    assert plans.top_rated_items(movies, ratings, more_votes_than=1).collect() == [("Toy Story (1995)", 4.5, 2)]
    assert plans.items_per_token(movies).first() == ("Drama", 2)
    # Tags come from the tags file: not the same years as the ratings.
    assert plans.records_per_year(tags).collect() == [(2005, 2)]
    assert plans.records_per_year(ratings).collect() == [(1996, 1), (2005, 3)]


def test_all_string_tables_give_the_same_reports(spark, schema, files):
    movies = sources.create_delimited_table(
        spark, "movies_text", files["movies"], ["MovieID", "Title", "Genres"], sep="@", quote=""
    )
    ratings = sources.create_delimited_table(
        spark, "ratings_text", files["ratings"], ["UserID", "MovieID", "Rating", "RatingTime"], sep="@", quote=""
    )
    assert plans.top_rated_items(movies, ratings, more_votes_than=0).collect() == [
        ("Toy Story (1995)", 4.5, 2), ("Oldboy (2005)", 3.5, 1),
    ]
    assert plans.records_per_year(ratings, "RatingTime").collect() == [(1996, 1), (2005, 3)]
    empty = operators.token_counts(movies, "Genres", null_as_empty=True).where("token = ''").first()
    assert empty["count"] == 1


def test_trips_from_parquet_to_csv_and_table(spark, schema, tmp_path):
    raw = str(tmp_path / "trips")
    spark.range(1000).select(
        (F.col("id") % 2).alias("vendor"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("passengers"),
        (F.col("id") % 40).alias("zone"),
        (F.col("id") * 0.25).alias("amount"),
    ).write.parquet(raw)
    trips = sources.read_parquet(spark, raw)
    counts = sinks.store_once(plans.trips_per_pair(trips, "vendor", "passengers"), "trips")
    assert counts.count() == 8 and counts.agg(F.sum("count")).first()[0] == 1000
    # A direct write and an external table may share a path; the later replaces the earlier.
    target = str(tmp_path / "report")
    sinks.write_single_csv(counts, target)
    sinks.write_external_table(counts.where("vendor = 0"), "report", target)
    assert spark.table("report").count() == 4
    amounts = plans.amount_per_zone(trips, "zone", "amount").collect()
    assert [r.zone for r in amounts] == list(range(25))
    assert amounts[0].amount == sum(i * 0.25 for i in range(0, 1000, 40))
    catalog.drop_table(spark, "report")
    assert [f for f in os.listdir(target) if f.startswith("part-")]


def test_csv_table_to_directory_to_table_to_mean(spark, schema, tmp_path):
    source, stored = tmp_path / "diamonds.csv", str(tmp_path / "diamonds")
    source.write_text("color,price\nE,326\nE,328\nI,334\n")
    as_text = sources.create_delimited_table(spark, "diamonds", str(source), header=True)
    assert as_text.dtypes == [("color", "string"), ("price", "string")]
    means = [("E", (326 + 328) / 2), ("I", 334.0)]
    assert [tuple(r) for r in plans.mean_per_group(as_text, "color", "price").collect()] == means
    sinks.write_directory(sources.read_delimited(spark, str(source), header=True), stored)
    catalog.drop_table(spark, "diamonds")
    table = sources.create_table_at(spark, "diamonds", stored)
    assert table.dtypes == [("color", "string"), ("price", "int")]
    assert [tuple(r) for r in plans.mean_per_group(table, "color", "price").collect()] == means
