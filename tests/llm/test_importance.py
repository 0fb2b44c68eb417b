import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest, buckets):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, longest, buckets, seed, percent, least):
    read = [(i, *features(t, longest, buckets)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in read:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text, longest, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in read:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = fit[: percent * len(fit) // 100]
    return sorted([(*r[:1], *r[2:], None) for r in rows if r[1] < least] + [(*r[:1], *r[2:], k + 1 if k < len(drawn) else None) for k, r in enumerate(fit)], key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    vocabulary = ["The", "and", "Élan", "x1", "naïve", "zz", "don't", "漢字", "42", "A-B"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "word " * 50_000), (1003, "\x00a" * 30)]


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 37), (3, 100)])
def test_draw_is_that_of_brute_force(spark, docs, longest, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("the naïve élan 42",), (None,), ("zz zz",)], "text string")
    found = importance.resample(df, target, longest=longest, buckets=64, seed=7, percent=percent)
    rows = found.select("doc_id", "n_features", "weight", "score", "rank").collect()
    expected = brute(docs, ["the naïve élan 42", None, "zz zz"], longest, 64, 7, percent, 20)
    assert sorted(map(tuple, rows), key=repr) == expected


@pytest.mark.parametrize("scores", [[5] * 3000, list(range(3000)), [1] * 1500 + [2] * 1500, [i % 7 for i in range(3000)]])
def test_cutoff_with_a_poor_sketch(spark, scores):
    """A sketch of two shares misses, and the exact counts widen the bracket."""
    rows = spark.createDataFrame(list(enumerate(scores)), "doc_id long, score long").repartition(7)
    order = sorted(enumerate(scores), key=lambda r: (-r[1], r[0]))
    for most, sketch in ((1, 50), (299, 2), (1500, 10_000), (2999, 50), (3000, 10_000)):
        assert importance.cutoff(rows, most, "score", "doc_id", sketch) == order[most - 1][::-1]


def test_repeated_rows_and_ids(spark):
    rows = [(i, 30, 30, 0, s) for i, s in [(1, 5), (1, 5), (1, 5), (None, 5), (2, 5), (None, 9), (3, 1)]]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    found = importance.draw(df, percent=45).collect()
    assert sorted(((r.rank, r.doc_id, r.score) for r in found if r.rank), key=repr) == [(1, None, 9), (2, 1, 5), (3, 1, 5)]
    assert len(found) == 7
    assert {r.rank for r in importance.draw(df, percent=100).collect()} == set(range(1, 8))


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 3, 4, 5, 6)], "doc_id long, text string, rank int, score int, bucket int, words int")
    target = spark.createDataFrame([], "text string, bucket int")
    row = importance.resample(docs, target, percent=100).first()
    assert (row["n_features"], row["rank"]) == (30, 1) and row["weight"] == math.floor(1000 * math.log(10030 / (31 * 10000)))
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target, percent=10).first()["rank"] is None


def test_ranks_come_from_a_distributed_sort(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 5000).alias("score"))
    found = importance.ranked(rows.repartition(9), F.desc("score"), F.asc("doc_id")).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 5001)) and [r["score"] for r in found] == list(range(4999, -1, -1))
