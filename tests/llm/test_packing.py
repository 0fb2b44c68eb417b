import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import packing

TEXTS = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "word " * 3000), (4, "x" * 5000), (5, "é😀\n\n  z <|endoftext|>"), (6, "a <|endoftext|> b<|endoftext|><|endoftext|>c<|endoftext |>")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, most=1024):
    """Places have no gap, and no sequence is too long."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return by_sequence


def test_pieces_hold_the_tokenizers_ids(spark, tokenizer):
    df = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, ids int")
    rows = packing.pack_documents(df, keep_ids=True).collect()
    checked(rows)
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts[r.doc_id].append(r)
    for doc_id in (2, 3, 4, 5, None):
        want = [*tokenizer.encode(dict(TEXTS)[doc_id] or "", add_special_tokens=False).ids, 2]
        assert [i for r in texts[doc_id] for i in r.ids] == want
        assert [r.start for r in texts[doc_id]] == [sum(x.length for x in texts[doc_id][:k]) for k in range(len(texts[doc_id]))]
        assert all(r.length == 1024 for r in texts[doc_id][1:])
    assert len(texts[1]) == 2


def test_ids_are_those_of_the_json_vocabulary(tokenizer):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    encode = packing.public_byte_bpe()
    assert [encode(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_sequences_give_the_ids_back(spark):
    df = spark.createDataFrame([(i, f"some words of document {i} " * (i % 5)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack_documents(df, keep_ids=True).cache()
    by_place = {(r.sequence_id, r.offset): r.ids for r in packed.collect()}
    for s in packing.sequences(packed).collect():
        assert s.ids == [i for at in s.starts for i in by_place[s.sequence_id, at]]


def test_few_sequences(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 900, 3000)
    sequence, _ = packing.best_fit(lengths, packing.Capacity())
    assert len(set(sequence)) <= 1.02 * np.ceil(lengths.sum() / 1024)


def test_every_capacity_holds():
    lengths = np.array([5, 5, 5, 5, 3, 3, 2, 1, 1, 1, 1])
    capacity = packing.Capacity(tokens=10, documents=3, attention=40, weights=(1, 1, 1))
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in set(sequence):
        inside = lengths[sequence == s]
        assert inside.sum() <= 10 and len(inside) <= 3 and (inside**2).sum() <= 40
    with pytest.raises(ValueError, match="capacity"):
        packing.best_fit(np.array([7]), capacity)


def test_groups_are_packed_apart(spark):
    df = spark.createDataFrame([(i, "two words") for i in range(300)], "doc_id long, text string")
    pieces = packing.tokenized_pieces(df, keep_ids=False).cache()
    rows = packing.pack_pieces(pieces, group=50).collect()
    assert len(rows) == 300 and len(checked(rows)) <= 6


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df).collect() == []


def test_long_runs_of_blanks(tokenizer):
    encode = packing.public_byte_bpe()
    for text in (" " * 1_100_000, "a" + " " * 1_100_000 + "b c", "x \n" + "\n" * 150_000 + " \u3000" * 60_000 + "é" + "\t" * 120_000 + "z"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(5, 1, 2, 3, 4), (1024, 5, 6, 7, 8)], "length long, _group int, sequence_id int, p0 int, `a.b` int")
    found = packing.pack_pieces(df)
    assert found.columns == ["length", "_group", "p0", "a.b", "sequence_id", "offset"]
    assert sorted((r["length"], r["_group"], r["p0"], r["a.b"], r["offset"]) for r in found.collect()) == [(5, 1, 3, 4, 0), (1024, 5, 7, 8, 0)]
