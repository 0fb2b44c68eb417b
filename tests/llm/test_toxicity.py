import random

import numpy as np
import pytest

from tallyframe.llm import toxicity

CLEAN = ["house", "river", "morning", "paper", "window", "garden", "teacher", "letter", "clover", "track", "stream"]


def texts(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "vulkost", "grobniks"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(600)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9999, 0, None)], "doc_id long, quality int, toxic int")
    return toxicity.fit_toxicity(toxicity.labelled_sample(docs, labels))


def test_held_out_accuracy(spark, trained):
    rows = texts(300, seed=9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, trained).collect()}
    assert all(found[i].predicted == y for i, _, y in rows)
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == (r.predicted == 1) for r in found.values())


@pytest.mark.parametrize("word", ["gr-ob.nik", "g r o b n i k", "grobbnik", "groxbnik", "GROBNIK!", "vul*kost", "gr0bnik"])
def test_gapped_insults(trained, word):
    text = f"house river {word} morning paper"
    assert trained.probabilities(trained.margins([text], {}))[0] >= 0.7


def test_texts_of_any_kind(spark, trained):
    rows = [(1, None), (2, ""), (None, "house"), (3, "a b"), (4, "x" * 200_000), (5, "grobnik " * 50_000), (5, "漢字 漢字"), (6, "1234 %%")]
    docs = spark.createDataFrame([(i, t, 1.5, 3) for i, t in rows], "doc_id long, text string, Score double, code int")
    found = toxicity.score_toxicity(docs, trained)
    assert found.columns == ["doc_id", "text", "code", "score", "predicted"]
    assert [r.doc_id for r in found.collect() if r.predicted] == [5]
    assert found.count() == len(rows) and found.where("score is null").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), trained).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(i, "grobnik") for i in range(5)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (2, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        model = toxicity.fit_toxicity(toxicity.labelled_sample(docs, labels))
        assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}


def test_held_out_rows_are_not_learned_from(spark):
    ids = spark.range(200).withColumn("held", toxicity.held_out(toxicity.F.col("id"))).collect()
    import zlib

    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)
    docs = spark.createDataFrame([(r.id, "x") for r in ids] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(r.id, r.id % 2) for r in ids], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, toxic=30, clean=1000).collect()
    assert not {r.doc_id for r in sample} & {r.id for r in ids if r.held}
    assert sum(r.toxic for r in sample) == 30 and len({r.doc_id for r in sample}) == len(sample)


def brute_features(run):
    """All three-letter subsequences, one by one."""
    codes = [toxicity._letter_code(c) for c in run]
    found = {}
    for i in range(len(run)):
        for j in range(i + 1, len(run)):
            for k in range(j + 1, len(run)):
                key = (codes[i], codes[j], codes[k])
                found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return found


def test_kernel_against_all_subsequences():
    rng = random.Random(2)
    runs = ["".join(rng.choice("abéß字") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    weights = np.random.default_rng(1).normal(size=toxicity.LETTERS**3)
    got = toxicity.linear_scores(runs, weights)
    for run, score in zip(runs, got, strict=True):
        own = brute_features(run)
        norm = sum(v * v for v in own.values()) ** 0.5
        flat = {(a * 32 + b) * 32 + c: v for (a, b, c), v in own.items()}
        assert score == pytest.approx(sum(v * weights[k] for k, v in flat.items()) / norm)
        assert toxicity.features(run)[list(flat)] == pytest.approx(np.array(list(flat.values())) / norm)
