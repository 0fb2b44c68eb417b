import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe import learn
from tallyframe.functions import scale_vector


@pytest.fixture(scope="module")
def scored(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(4, 6)) * 3
    rows = [(i, (centres[i % 4] + rnd.normal(size=6) * 0.3).tolist(), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, pixels array<double>, label int")
    df = df.withColumn("held_out", learn.held_out("id"))
    model = learn.fit_classifier(df.where(~F.col("held_out")), "pixels", "label", 6, 4, hidden=16, max_iter=60)
    return learn.score(model, df, "pixels")


def test_learns_separable_classes(scored):
    found = {r.held_out: r for r in learn.evaluate(scored, "label", "held_out").collect()}
    assert found[True].n + found[False].n == 400 and 40 < found[True].n < 120
    assert found[True].accuracy > 0.95 and found[True].loss < math.log(4) / 4


def test_scores_are_probabilities(scored):
    for r in scored.limit(20).collect():
        assert math.isclose(sum(r.probabilities), 1, rel_tol=1e-9)
        weights = np.exp(np.array(r.logits) - max(r.logits))
        assert np.allclose(weights / weights.sum(), r.probabilities)
        assert r.prediction == int(np.argmax(r.probabilities))


def test_held_out_rows_stay_the_same(spark):
    df = spark.range(10_000)
    share = df.where(learn.held_out("id", 0.3)).count() / 10_000
    assert abs(share - 0.3) < 0.03
    assert df.repartition(7).where(learn.held_out("id", 0.3)).count() / 10_000 == share


def test_rows_of_pixels_are_flattened_and_scaled(spark):
    rnd = np.random.default_rng(2)
    images = []
    for i in range(200):
        image = rnd.integers(0, 40, size=(4, 4))
        image[i % 2 * 2:i % 2 * 2 + 2] += 200
        images.append((i, image.tolist(), i % 2))
    df = spark.createDataFrame(images, "id int, image array<array<int>>, label int")
    scaled = df.withColumn("pixels", F.transform("image", lambda row: scale_vector(row, 255)))
    model = learn.fit_classifier(scaled, "pixels", "label", 16, 2, hidden=8, max_iter=30)
    scored = learn.score(model, scaled, "pixels")
    assert scored.columns == ["id", "image", "label", "pixels", "prediction", "logits", "probabilities"]
    assert learn.evaluate(scored, "label").first().accuracy > 0.95


def test_training_rows_are_spread_and_bounded(spark):
    df = spark.range(0, 40_000, 1, 8).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("f"), (F.col("id") % 2).alias("y"))
    rows = learn.training_rows(df, "f", "y", max_rows=4_000)
    assert rows.rdd.getNumPartitions() > 1 and 3_600 < rows.count() <= 4_400
    again = learn.training_rows(df.repartition(3), "f", "y", max_rows=4_000)
    assert sorted(r._vector[0] for r in rows.collect()) == sorted(r._vector[0] for r in again.collect())
    assert learn.training_rows(df, "f", "y").count() == 40_000


def test_copies_do_not_swamp_a_sample(spark):
    df = spark.range(0, 9_000, 1, 4).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.col("id") * 1.0)).alias("f"), F.lit(1).alias("y"))
    try:
        assert learn.training_rows(df, "f", "y", max_rows=600).count() <= 660
    except ValueError as copies:
        assert "name a key" in str(copies)
    assert 500 < learn.training_rows(df, "f", "y", max_rows=600, key="id").count() <= 660
    same = df.withColumn("f", F.array(F.lit(1.0)))
    with pytest.raises(ValueError, match="name a key"):
        learn.training_rows(same, "f", "y", max_rows=600)


def test_split_by_label_keeps_quotas(spark):
    rows = spark.range(20_000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") < 19_000, "often"))
    split = rows.withColumn("held_out", learn.held_out_by_label(rows, "id", "label", 0.25))
    shares = {r.label: (r.n, r.held) for r in split.groupBy("label").agg(F.count("id").alias("n"), F.count_if("held_out").alias("held")).collect()}
    assert shares[None][1] == 0
    for label in ("rare", "often"):
        n, held = shares[label]
        assert 0 <= n * 0.25 - held <= 12
    again = rows.repartition(7)
    held = again.withColumn("held_out", learn.held_out_by_label(again, "id", "label", 0.25)).where("held_out").count()
    assert held == split.where("held_out").count()
    assert rows.limit(0).withColumn("h", learn.held_out_by_label(rows.limit(0), "id", "label")).count() == 0
