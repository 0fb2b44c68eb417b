import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.public_model())


def every_segmentation(model, text):
    whole = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    found = []

    def go(at, ids, score):
        if at == len(whole):
            found.append((score, tuple(ids)))
        for end in range(at + 1, len(whole) + 1):
            piece = whole[at:end]
            if piece in model.ids:
                go(end, ids + [model.ids[piece]], score + model.score[model.ids[piece]])
            elif end == at + 1:
                go(end, ids + [model.bytes[b] for b in piece.encode()], score + model.unknown)

    go(0, [], 0.0)
    return sorted(found, key=lambda s: -s[0])


def test_against_every_segmentation(model):
    rng = random.Random(3)
    texts = ["", "a", " ", "  a b", "the cat", "über 漢字", "\n\t", "a a a a", "x "]
    texts += ["".join(rng.choice("athe in  é\n漢x") for _ in range(rng.randint(1, 11))) for _ in range(150)]
    for text in texts:
        want, got = every_segmentation(model, text), model.encode(text, 5)
        assert [s for s, _ in got] == [s for s, _ in want[:5]]
        ids = [tuple(i.tolist()) for _, i in got]
        assert len(set(ids)) == len(ids) and set(zip([s for s, _ in got], ids, strict=True)) <= set(want)
        assert all(model.decode(i) == text for _, i in got)


def test_together_as_alone(model):
    words = ["".join(random.Random(i).choice("abcdeéß漢😀") for _ in range(1 + i % 9)) for i in range(200)]
    fresh = pieces.Pieces(pieces.public_model())
    fresh.learn(set(words))
    assert all(fresh.known[w] == model.solve(pieces.SPACE + w) for w in words)


def test_texts_of_any_kind(spark, model):
    rows = [(1, None), (1, ""), (None, "a word"), (2, "  two\n spaces  "), (3, "w" * 30_000), (4, "many words " * 20_000), (4, "many words " * 20_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, nbest string")
    found = pieces.encode_pieces(df, most=3).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    for r in found:
        assert [n.score for n in r.nbest] == sorted((n.score for n in r.nbest), reverse=True)
        assert all(n.n_ids == len(n.ids) and n.ids_crc32 == zlib.crc32(np.array(n.ids, "<u4").tobytes()) for n in r.nbest)
    assert [[n.n_ids for n in r.nbest] for r in found if r.doc_id == 1] == [[0], [0]]
    best = pieces.encode_pieces(df, most=1).selectExpr("doc_id", "nbest[0].ids AS ids", "'old' AS text")
    texts = sorted(r.text for r in pieces.decode_pieces(best).collect())
    assert texts == sorted(t or "" for _, t in rows)
    assert pieces.encode_pieces(df.limit(0)).collect() == []


def test_whole_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pieces.encode_pieces(docs, most=2, keep_ids=False).where("not round_trip or size(nbest) < 2").count() == 0
