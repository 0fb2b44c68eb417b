import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import periods, registry

SF = "/root/testdata/sf0.001"


def brute(words, least):
    """Every period at every place, one word after the other."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, 2 * p) and i > start:
                found.setdefault((start, i - start + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def sample(rng, kind):
    size, letters = rng.randint(0, rng.choice([10, 60, 200])), rng.choice([1, 2, 2, 3, 4])
    if kind == 0:
        return [rng.randrange(letters) for _ in range(size)]
    if kind == 1:
        words = ([rng.randrange(letters) for _ in range(rng.randint(1, 12))] * 40)[:size]
        for _ in range(rng.randint(0, 3) if words else 0):
            words[rng.randrange(len(words))] = rng.randrange(letters)
        return words
    if kind == 2:  # Fibonacci words have the most runs
        a, b = [0], [0, 1]
        while len(b) < size:
            a, b = b, b + a
        return b[:size]
    words = []
    while len(words) < size:
        words += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9)
    return words * rng.randint(1, 2)


@pytest.mark.parametrize("kind", range(4))
def test_runs_are_those_of_brute_force(kind):
    rng = random.Random(kind)
    for _ in range(300):
        least = rng.choice([2, 3, 5, 6, 7, 12, 12, 17])
        laid, expected = [], []
        for number in range(rng.randint(1, 4)):
            words = sample(rng, kind)
            expected += [(s + len(laid), n, p) for s, n, p in brute(words, least)]
            laid += [*words, 1000 + number]
        found = periods.find_runs(np.array(laid, np.int64), least)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(expected)


def test_successors_in_ranges():
    rng = np.random.default_rng(3)
    values = rng.permutation(200)
    wavelet = periods.Wavelet(values)
    left = rng.integers(0, 200, 500)
    right = left + rng.integers(0, 201 - left)
    value = rng.integers(0, 260, 500)
    below = wavelet.below(left, right, value)
    for a, b, v, n in zip(left, right, value, below, strict=True):
        assert n == (values[a:b] < v).sum()
    some = right - left > below
    found = wavelet.nth(left[some], right[some], below[some])
    for a, b, v, x in zip(left[some], right[some], value[some], found, strict=True):
        assert x == min(values[a:b][values[a:b] >= v])


def test_windows_find_every_period():
    for least in (2, 5, 12, 13, 40):
        spans = periods.windows(12, least)
        for p in range(1, 2000):
            again = max(least, 2 * p) - p
            assert any(low <= p <= high and 2 ** (k + 1) - 1 <= again for k, low, high in spans)


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    s, m, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])))
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), s, m, p, m and 1000 * m // p, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.queries()["op11_periods"](spark, SF).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        if len((texts[r.doc_id] or "").split()) < 3000:
            assert tuple(r)[1:8] == expected_row(r.doc_id, texts[r.doc_id])
            some += r.n_runs > 0
    assert some > 5


def test_edges(spark):
    texts = [None, "", " \n", "a " * 11, "a " * 12, "x y " * 12, "a b c d e f " * 2, "w " * 200_000, "a " * 12]
    df = spark.createDataFrame([(i or None, t, 7, 8) for i, t in enumerate(texts)], "Doc_ID long, TEXT string, runs int, collapsed int")
    rows = {r.doc_id: r for r in periods.period_runs(df).collect()}
    assert len(rows) == len(texts)
    runs = {i: [tuple(x) for x in rows[i or None].runs] for i in range(len(texts))}
    assert runs[0] == runs[1] == runs[2] == runs[3] == []
    assert rows[3].collapsed == "a a a a a a a a a a a" and rows[None].collapsed == ""
    assert runs[4] == runs[5] == runs[8] == [(0, 12, 1)]
    assert rows[5].collapsed == "x y" and runs[6] == [(0, 12, 6)] and rows[6].collapsed == "a b c d e f"
    assert runs[7] == [(0, 200_000, 1)] and rows[7].collapsed == "w"
    assert periods.period_runs(df.limit(0)).count() == 0


def test_words_are_split_at_ascii_white_space_alone():
    import pyarrow as pa

    texts = [f"a{chr(c)}b" for c in (*range(1, 0x21), 0x85, 0xA0, 0x1680, 0x2003, 0x3000)]
    words, counts = periods._split(pa.array(texts))
    assert [t.encode().split() for t in texts] == [
        [w.encode() for w in words.to_pylist()[a : a + n]] for a, n in zip(np.cumsum(counts) - counts, counts, strict=True)
    ]
