import math

import numpy as np

from tallyframe.llm import embeddings


def reference(rows, least):
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [embeddings.unit(np.array([v]))[0] if ok else None for (_, v), ok in zip(rows, usable, strict=True)]
    n = len(rows)
    links = [[b for b in range(n) if b != a and usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[a], *(root[b] for b in links[a])]) for a in range(n)]
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if root[b] == root[a] and rows[b][0] is not None]
        low = min(ids, default=None)
        out.append((rows[a][0], len(links[a]), low, rows[a][0] is not None and rows[a][0] == low))
    return sorted(out, key=repr)


def checked(spark, rows, kind="float", least=0.9, **options):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, kept string")
    found = embeddings.near_duplicates(df, least, **options).collect()
    assert sorted((tuple(r) for r in found), key=repr) == reference(rows, least)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = np.concatenate([base, *(base + spread * rng.normal(size=base.shape) for _ in range(3))])
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_against_all_pairs(spark):
    checked(spark, vectors(1, 400, 40, 0.3), tile_bytes=40 * 8 * 60)
    checked(spark, vectors(2, 200, 6, 0.2), kind="double")


def test_vectors_of_any_kind(spark):
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (1, [-1.0, 0.0]), (None, [1.0, 0.1])]
    rows += [(20, None), (21, []), (22, [0.0, 0.0]), (23, [1.0, None]), (24, [float("nan"), 1.0]), (25, [float("inf"), 1.0])]
    rows += [(30, [1.0]), (31, [3.0]), (32, [1.0, 0.0, 0.0]), (None, [0.0, 5.0, 0.0]), (None, [0.0, 5.0, 0.0])]
    rows += [(40, [1e-300, 1e-300, 0.0, 0.0]), (41, [1e300, 1e300, 0.0, 0.0]), (42, [0.0, 0.0, 0.0, 1e-320])]
    checked(spark, rows, kind="double")


def test_many_copies(spark):
    checked(spark, [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(500 + i, [1.0, 2.0, 3.1 + i / 1000]) for i in range(60)], tile_bytes=200)


def test_empty_table(spark):
    checked(spark, [])
    checked(spark, [(1, None), (2, [0.0])])


def test_pairs_end_early_but_none_is_lost():
    rng = np.random.default_rng(4)
    a = embeddings.unit(rng.normal(size=(300, 48)) * np.linspace(3, 0.1, 48))
    b = embeddings.unit(a[:200] + 0.05 * rng.normal(size=(200, 48)))
    turn = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    found = {(i, j) for x, y in embeddings.near_pairs(a, b, a @ turn, b @ turn, 0.9) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i, j in zip(*np.nonzero(a @ b.T >= 0.9), strict=True)} and len(found) >= 200
