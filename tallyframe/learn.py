"""Dense classifier over vector columns: fit, score, evaluate."""

from __future__ import annotations

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sinks.tables import store_once

#: Training rows that make a task worth its overhead.
ROWS_OF_A_TASK = 500


def _vector(df: DataFrame, features: str) -> Column:
    """The array column as a vector; rows of a nested array are put end to end."""
    kind = df.select(features).schema[0].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    return array_to_vector(F.flatten(features) if nested else F.col(features))


#: Steps of a split's hash; a label's held-out rows are within one step of its quota.
STEPS = 4096


def _number(key: Column | str, digits: int) -> Column:
    """A number that the text of a key decides."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def held_out(key: Column | str, share: float = 0.2) -> Column:
    """True for about ``share`` of the keys, always the same ones; a null key is not held out."""
    return F.coalesce(_number(key, 8) < int(share * 2**32), F.lit(False))


def held_out_by_label(df: DataFrame, key: str, label: str, share: float = 0.2) -> Column:
    """True for ``share`` of the keys of every label, as near below as a hash in ``STEPS`` steps comes.

    One counting job; what reaches the driver is ``STEPS`` counts per label at
    most. No row is sorted, ranked or joined. A null label is not held out.
    """
    step = _number(key, 3)
    counted = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), step.alias("step")).count().collect()
    by_label: dict = {}
    for row in counted:
        by_label.setdefault(row["label"], {})[row["step"]] = row["count"]
    parts = round(share * 10_000)
    held = F.lit(False)
    for value, steps in sorted(by_label.items(), key=lambda x: str(x[0])):
        total, upto, first_kept = sum(steps.values()), 0, 0
        for at in range(STEPS):
            upto += steps.get(at, 0)
            if upto * 10_000 > parts * total:
                break
            first_kept = at + 1
        held = held | ((F.col(label) == F.lit(value)) & (step < first_kept))
    return F.coalesce(held, F.lit(False))


def training_rows(df: DataFrame, features: str, label: str, max_rows: int = 100_000, key: str | None = None) -> DataFrame:
    """``_vector`` and ``label`` of at most about ``max_rows`` rows, spread over tasks.

    The rows are those whose hash, of the features, the label and the ``key``
    if given, is below a threshold, so no task gathers them. Equal rows share a hash: the
    threshold falls until the sample is small enough, and a row that is copied more
    often than that fails the job; ``key`` tells copies apart.
    """
    kept = [features, label] + ([key] if key else [])
    rows = df.select(
        _vector(df, features).alias("_vector"), F.col(label).cast("double").alias("label"), F.xxhash64(*kept).alias("_h")
    )
    n = rows.count()
    sample, size, share = rows, n, 1.0
    for _ in range(20):
        if size <= 1.1 * max_rows:
            break
        share *= max_rows / size
        sample = rows.where(F.col("_h") < int((share - 0.5) * 2**64))
        size = sample.count()
    if size > 1.1 * max_rows or (n and not size):
        raise ValueError(f"equal rows make no sample of {max_rows} rows; name a key")
    tasks = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // ROWS_OF_A_TASK))
    return store_once(sample, "training").repartition(tasks, "_h").drop("_h")


def fit_classifier(
    df: DataFrame,
    features: str,
    label: str,
    inputs: int,
    classes: int,
    hidden: int = 128,
    max_iter: int = 100,
    seed: int = 7,
    max_rows: int = 100_000,
    key: str | None = None,
) -> MultilayerPerceptronClassificationModel:
    """Train ``inputs`` → ``hidden`` → ``classes`` on an array column.

    Nested arrays, such as rows of pixels, are flattened first.

    Runs Spark jobs: each iteration is a distributed pass whose tasks send back
    one gradient. It is trained on ``training_rows``, about ``max_rows`` at the
    most. Hidden units are sigmoid and the optimiser is L-BFGS; there is no
    dropout.
    """
    classifier = MultilayerPerceptronClassifier(
        layers=[inputs, hidden, classes],
        featuresCol="_vector",
        labelCol="label",
        maxIter=max_iter,
        seed=seed,
    )
    return classifier.fit(training_rows(df, features, label, max_rows, key))


def score(model: MultilayerPerceptronClassificationModel, df: DataFrame, features: str) -> DataFrame:
    """``df`` with ``prediction`` and the arrays ``logits`` and ``probabilities``."""
    scored = model.transform(df.withColumn("_vector", _vector(df, features)))
    return (
        scored.withColumn("logits", vector_to_array("rawPrediction"))
        .withColumn("probabilities", vector_to_array("probability"))
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("_vector", "rawPrediction", "probability")
    )


def evaluate(scored: DataFrame, label: str, *keys: str) -> DataFrame:
    """Row count ``n``, ``accuracy`` and mean log ``loss`` per ``keys``, in one pass.

    A label outside the classes fails the job.
    """
    place = F.col(label).cast("int")
    known = place.between(0, F.size("probabilities") - 1)
    probability = F.when(known, F.get("probabilities", place)).when(
        place.isNotNull(), F.raise_error(F.lit("a label is outside the classes")).cast("double")
    )
    hit = (F.col("prediction") == F.col(label)).cast("double")
    likelihood = F.greatest(probability, F.lit(1e-15))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        F.avg(-F.log(likelihood)).alias("loss"),
    )
