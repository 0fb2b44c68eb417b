import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import (
    cross_entropy_loss,
    epoch_seconds,
    epoch_year,
    scale_vector,
    softmax,
    split_tokens,
    suffix_window,
    title_year,
)


def test_suffix_window_clips_short_text_and_counts_blanks(movies):
    found = [r.y for r in movies.orderBy("movieId").select(suffix_window("title", 5, 4).alias("y")).collect()]
    assert found == ["1995", "2005", "2005", "001)", "ab", "1995"]


def test_title_year_ignores_blanks_and_gives_null_without_a_year(movies):
    found = [r.y for r in movies.orderBy("movieId").select(title_year("title").alias("y")).collect()]
    assert found == ["1995", "2005", "2005", "2001", None, "1995"]


@pytest.mark.parametrize(
    "text, sep, parts",
    [("a|b", "|", ["a", "b"]), ("a||", "|", ["a", "", ""]), ("", "|", [""]), ("a.b", ".", ["a", "b"]), ("ab", "|", ["ab"])],
)
def test_separator_is_literal_and_empty_parts_stay(spark, text, sep, parts):
    row = spark.createDataFrame([(text,)], "t string").select(split_tokens("t", sep).alias("p")).first()
    assert row.p == parts


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_epoch_year_does_not_depend_on_the_session_zone(spark, conf, session_zone):
    conf("spark.sql.session.timeZone", session_zone)
    rows = [("820454399",), ("820454400",), ("0",), ("-1",), ("bad",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    years = [r.y for r in df.select(epoch_year(F.col("s")).alias("y")).collect()]
    assert years == [1995, 1996, 1970, 1969, None, None]
    tokyo = [r.y for r in df.select(epoch_year(F.col("s"), "Asia/Tokyo").alias("y")).collect()]
    assert tokyo == [1996, 1996, 1970, 1970, None, None]


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles"])
def test_epoch_seconds_round_down(spark, conf, session_zone):
    conf("spark.sql.session.timeZone", session_zone)
    text = ["2024-01-01 00:00:07.179575", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    found = [r.s for r in df.select(epoch_seconds(F.col("t").cast("timestamp_ntz")).alias("s")).collect()]
    assert found == [1704067207, -1, 0]


def test_vectors_match_numpy(spark):
    vectors = np.random.default_rng(3).normal(scale=30, size=(20, 7))
    df = spark.createDataFrame([(v.tolist(), i % 7) for i, v in enumerate(vectors)], "v array<double>, c int")
    rows = df.select(
        "v", "c",
        scale_vector(F.col("v"), 255).alias("scaled"),
        softmax(F.col("v")).alias("p"),
        cross_entropy_loss(F.col("v"), F.col("c")).alias("loss"),
    ).collect()
    for r in rows:
        v = np.array(r.v)
        weights = np.exp(v - v.max())
        assert np.array_equal(r.scaled, v / 255)
        assert np.allclose(r.p, weights / weights.sum()) and math.isclose(sum(r.p), 1)
        assert math.isclose(r.loss, math.log(weights.sum()) - (v[r.c] - v.max()), abs_tol=1e-12)


def test_softmax_of_large_logits_and_edge_rows(spark):
    df = spark.createDataFrame([([1000.0, 1000.0], 0), (None, 0), ([0.0] * 10, 3), ([1.0], 5)], "v array<double>, c int")
    rows = df.select(softmax(F.col("v")).alias("p"), cross_entropy_loss(F.col("v"), F.col("c")).alias("l")).collect()
    assert rows[0].p == [0.5, 0.5] and rows[1].p is None and rows[1].l is None
    assert math.isclose(rows[2].l, math.log(10)) and rows[3].l is None


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_epoch_year_is_null_outside_the_calendar(spark, zone):
    values = [-(2**63), 2**63 - 1, 100_000_000_000_000, -62135596801, 253402300800, None]
    df = spark.createDataFrame([(v,) for v in values], "s long")
    assert [r.y for r in df.select(epoch_year(F.col("s"), zone).alias("y")).collect()] == [None] * 6
