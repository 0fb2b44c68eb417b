"""Drawing documents that resemble a target: hashed features, array-scored weights, a bracketed cutoff.

The two corpora are counted per feature bucket, which leaves one gain per
bucket; the gains travel to the documents as one array. Scores are weights plus
Gumbel noise that the document's id decides, so the highest scores are a sample
without replacement. The cutoff is bracketed by a quantile sketch, the rows
outside the bracket are counted exactly, and only the bracket is sorted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import col, stored

#: Runs of ASCII letters and digits and of everything beyond ASCII; upper case counts as a letter here.
FEATURE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Relative error of the quantile sketch is one over this.
SKETCH = 10_000


def words_of(text: Column) -> Column:
    """The words of a text, A to Z in lower case; a null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FEATURE_WORD), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, UPPER, UPPER.lower()))


def features_of(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of one to ``longest`` words, repeats included."""

    def runs(found: Column, n: int) -> Column:
        if n == 1:
            return found
        heads = F.slice(found, F.lit(1), F.greatest(F.size(found) - n + 1, F.lit(0)))
        return F.transform(heads, lambda w, i: F.concat_ws(" ", w, *(F.get(found, i + k) for k in range(1, n))))

    every = F.transform(F.array(words), lambda found: F.concat(*(runs(found, n) for n in range(1, longest + 1))))[0]
    return F.transform(every, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """How many features of all texts fall into each bucket: ``bucket``, ``n``; at most ``buckets`` rows."""
    every = features_of(words_of(col(texts, text_col)), longest, buckets)
    return texts.select(F.explode(every).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> list[int]:
    """By bucket, a thousand times the log ratio of its smoothed shares in ``target`` and ``docs``."""
    s = bucket_counts(docs, text_col, longest, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text_col, longest, buckets).withColumnRenamed("n", "t")
    both = stored(s.join(t, "bucket", "full").na.fill(0), "buckets")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()

    def gain(s: Column, t: Column) -> Column:
        ratio = (t + 1.0) * float(total["s"] + buckets) / ((s + 1.0) * float(total["t"] + buckets))
        return F.floor(F.ln(ratio) * 1000.0).cast("bigint")

    unseen = both.sparkSession.range(1).select(gain(F.lit(0), F.lit(0)).alias("g")).first()["g"]
    found = [unseen] * buckets
    for row in both.select("bucket", gain(F.col("s"), F.col("t")).alias("g")).collect():  # no more than ``buckets``
        found[row["bucket"]] = row["g"]
    return found


def noise(key: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate that ``seed`` and the key decide, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.ln(-F.ln(share)) * -1000.0).cast("bigint")


def score_documents(
    docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``.

    The weight is the mean gain of the features, rounded down, and 0 without
    features. A null text has no words; a null id is the empty text to the
    noise. Other columns are not read.
    """
    table = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    read = docs.select(col(docs, id_col).alias("doc_id"), words_of(col(docs, text_col)).alias("words"))
    read = read.select("doc_id", F.size("words").cast("bigint").alias("n_words"), features_of(F.col("words"), longest, len(gain)).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))
    read = read.select("doc_id", "n_words", F.size("f").cast("bigint").alias("n_features"), total.alias("total"))
    mean = F.expr("(total - pmod(total, n_features)) div n_features")
    read = read.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0).cast("bigint")))
    return read.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with their ``rank`` from 1 in a total order, by a distributed sort.

    The sort deals the rows out by ranges. What is kept of every range is how
    many rows it has; no task sees more than its range.
    """
    placed = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.expr("coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0)")
    starts = sizes.select(F.col("_range").alias("_r"), before.alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = placed.join(starts, F.col("_range") == F.col("_r"))
    return joined.select(*rows.columns, (F.col("_before") + within).alias("rank"))


def cutoff(rows: DataFrame, most: int, score: str, key: str, sketch: int = SKETCH) -> tuple:
    """The score and key of the row that is ``most``-th by falling score, then rising key (nulls last).

    A quantile sketch proposes an interval of scores around the place. The rows
    above it and in it are counted exactly: an interval that misses the place
    is widened and counted again, so a poor sketch costs time only. The rows in
    the interval alone are sorted.
    """
    n, low, high = rows.agg(F.count(score), F.min(score), F.max(score)).first()
    if not 1 <= most <= n:
        raise ValueError(f"there is no row {most} of {n}")
    place, width = 1 - most / n, 2 / sketch
    while True:
        shares = [max(0.0, place - width), min(1.0, place + width)]
        if shares == [0.0, 1.0]:
            bottom, top = low, high
        else:
            bottom, top = rows.agg(F.percentile_approx(score, shares, sketch)).first()[0]
        value = F.col(score)
        above, inside = rows.agg(F.count_if(value > top), F.count_if((value >= bottom) & (value <= top))).first()
        if above < most <= above + inside:
            break
        if shares == [0.0, 1.0]:
            raise ValueError("the scores have no order")
        width *= 8
    bracket = rows.where((value >= bottom) & (value <= top)).select(score, key)
    found = ranked(bracket, F.desc(score), F.asc_nulls_last(key)).where(F.col("rank") == most - above).first()
    return found[score], found[key]


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """The rows of ``score_documents`` with ``rank``: 1, 2, 3 … for those drawn, null for the others.

    Of the N documents with ``least_words`` words or more, the
    ``floor(percent * N / 100)`` with the highest scores are drawn, ties to the
    smaller id. Rows that share score and id are interchangeable and get ranks
    of their own. Nothing is drawn from an empty table.
    """
    scored = stored(scored, "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    most = percent * fit.count() // 100
    unranked = F.lit(None).cast("bigint").alias("rank")
    if most == 0:
        return scored.select("*", unranked)
    score, key = cutoff(fit, most, "score", "doc_id")
    same = F.col("score") == F.lit(score)
    upto = F.lit(True) if key is None else F.coalesce(F.col("doc_id") <= F.lit(key), F.lit(False))
    chosen = F.coalesce((F.col("n_words") >= least_words) & ((F.col("score") > F.lit(score)) | (same & upto)), F.lit(False))
    drawn = ranked(scored.where(chosen), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(scored.where(~chosen).select("*", unranked))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
) -> DataFrame:
    """All documents with the weight, score and rank of a draw towards ``target``.

    Returns ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank`` (null: not drawn), one row per row of ``docs``. Null and empty
    texts have no features and weight 0. An empty target leaves every bucket
    its smoothed share. Other columns of either frame are not read.
    """
    gain = gains(docs, target, text_col, longest, buckets)
    return draw(score_documents(docs, gain, id_col, text_col, longest, seed), percent, least_words)
