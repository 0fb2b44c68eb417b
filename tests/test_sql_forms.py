"""The reports give the rows of the plain SQL a user would type over views."""

import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe import catalog, functions, plans


@pytest.fixture(scope="module")
def frames(spark):
    """Random items, ratings and tags with popular keys, gaps and odd text."""
    rnd = random.Random(11)
    genres = ["Drama", "Comedy", "Sci-Fi", "", "Film-Noir"]
    movies = [
        (rnd.choice([i, i, 3, None]), rnd.choice([f"Title {i % 9} ({1990 + i % 9})", "abc", "Odd (1999) ", None]),
         rnd.choice([None, "|".join(rnd.choices(genres, k=rnd.randint(1, 4)))]))
        for i in range(80)
    ]
    ratings = [
        (rnd.randrange(30), rnd.choice([3, rnd.randrange(90), None]), rnd.choice([None, 0.5, 3.0, 4.5, 5.0]),
         rnd.randrange(0, 1_200_000_000))
        for _ in range(500)
    ]
    tags = [(u, m, "t", ts) for u, m, _, ts in ratings[:50]]
    result = {
        "movies": spark.createDataFrame(movies, "movieId int, title string, genres string"),
        "ratings": spark.createDataFrame(ratings, "userId int, movieId int, rating double, timestamp bigint"),
        "tags": spark.createDataFrame(tags, "userId int, movieId int, tag string, timestamp bigint"),
    }
    for name, frame in result.items():
        catalog.register_view(frame, name)
    yield result
    for name in result:
        spark.catalog.dropTempView(name)


REPORTS = {
    "rating years": (
        """SELECT year(timestamp_seconds(timestamp)) AS y, count(*) AS c FROM ratings
           GROUP BY y ORDER BY y LIMIT 10""",
        lambda f: plans.records_per_year(f["ratings"], first=10),
    ),
    "tag years": (
        "SELECT year(timestamp_seconds(timestamp)) AS y, count(*) AS c FROM tags GROUP BY y ORDER BY y",
        lambda f: plans.records_per_year(f["tags"]),
    ),
    "amounts": (
        "SELECT movieId, sum(rating) AS a FROM ratings WHERE movieId < 25 GROUP BY movieId ORDER BY movieId",
        lambda f: plans.amount_per_zone(f["ratings"], "movieId", "rating"),
    ),
    "means": (
        "SELECT userId, mean(rating) AS m FROM ratings GROUP BY userId ORDER BY userId",
        lambda f: plans.mean_per_group(f["ratings"], "userId", "rating"),
    ),
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_equals_sql_in_order(spark, frames, name):
    sql, report = REPORTS[name]
    expected = [tuple(r) for r in spark.sql(sql).collect()]
    assert expected and [tuple(r) for r in report(frames).collect()] == expected


def _rated(frames, more_than, count):
    """Title, votes and mean rating, computed row by row."""
    values = {}
    for m in frames["movies"].collect():
        found = [r.rating for r in frames["ratings"].collect() if r.movieId is not None and r.movieId == m.movieId]
        values.setdefault(m.title, []).extend(found or [None])
    rows = []
    for title, found in values.items():
        present = [v for v in found if v is not None]
        votes = len(found) if count == "rows" else len(present)
        if votes > more_than:
            rows.append((title, votes, sum(present) / len(present) if present else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("more_than, count", [(3, "values"), (0, "rows")])
def test_rated_titles_equal_python(frames, more_than, count):
    report = plans.rated_items(frames["movies"], frames["ratings"], more_votes_than=more_than, count=count)
    assert sorted(((r.title, r.votes, r.rate) for r in report.collect()), key=repr) == _rated(frames, more_than, count)


def test_title_counts_equal_python(frames):
    titles = [(m.title, m.genres) for m in frames["movies"].collect()]
    genres = Counter(g for _, text in titles if text is not None for g in text.split("|"))
    assert {tuple(r) for r in plans.items_per_token(frames["movies"]).collect()} == set(genres.items())
    years = Counter(None if t is None else t[-5:][:4] if len(t) >= 5 else t[: max(0, len(t) - 1)] for t, _ in titles)
    assert {tuple(r) for r in plans.items_per_suffix(frames["movies"]).collect()} == set(years.items())


def test_counts_of_pairs(spark, frames):
    expected = spark.sql("SELECT movieId, rating, count(*) FROM ratings GROUP BY ALL").collect()
    found = plans.trips_per_pair(frames["ratings"], "movieId", "rating").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(tuple, expected)))


def test_text_functions_equal_python(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ab (1290)é|.\\", k=rnd.randint(0, 12))) for _ in range(400)]
    texts += [f"x ({y}){' ' * rnd.randint(0, 2)}" for y in range(1900, 1950)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        functions.suffix_window("t", 5, 4).alias("w"),
        functions.split_tokens("t").alias("p"),
        functions.split_tokens("t", "\\").alias("b"),
        functions.title_year("t").alias("y"),
    )
    for r in rows.collect():
        begin = len(r.t) - 5
        assert r.w == r.t[max(begin, 0):max(begin + 4, 0)]
        assert r.p == r.t.split("|") and r.b == r.t.split("\\")
        year = re.search(r"\((\d{4})\)\s*$", r.t, re.ASCII)
        assert r.y == (year.group(1) if year else None)


def test_epoch_functions_equal_python(spark):
    rnd = random.Random(6)
    seconds = [rnd.randrange(-4_000_000_000, 8_000_000_000) for _ in range(500)]
    start = datetime.datetime(1970, 1, 1)
    rows = spark.createDataFrame([(s, str(start + datetime.timedelta(seconds=s))) for s in seconds], "s bigint, t string")
    found = rows.select(
        "s", "t",
        functions.epoch_year(F.col("s")).alias("y"),
        functions.epoch_seconds(F.col("t").cast("timestamp_ntz")).alias("back"),
    )
    for r in found.collect():
        assert str(r.y) == r.t[:4] and r.back == r.s
