import random

import pytest

from tallyframe.llm import substring


def reference(rows, window):
    """Windows of smaller ids, in order of id."""
    low, out = {}, []
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                low[key] = min(low.get(key, i), i)
    for i, text in rows:
        words = (text or "").encode().split()
        hit = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and low.get(tuple(words[k : k + window]), i) < i:
                hit[k : k + window] = [True] * window
        out.append((i, b" ".join(w for w, h in zip(words, hit, strict=True) if not h).decode(), len(words), sum(hit)))
    return sorted(out, key=repr)


def removed(spark, rows, window, **options):
    schema = "doc_id long, k1 string, text string, n_words string, hot int"
    df = spark.createDataFrame([(i, "k", t, "n", 1) for i, t in rows], schema)
    done = substring.remove_repeats(df, window, **options)
    assert done.columns == ["doc_id", "k1", "text", "hot", "n_words", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in done.collect()), key=repr)


def random_rows(seed, n, letters="abc", most=30):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]
    texts += ["\n".join(rng.choice(texts).split() + rng.choice(texts).split()) for _ in range(n // 2)]
    return [(rng.randrange(n), t) for t in texts]


@pytest.mark.parametrize("window, hot", [(4, 5000), (6, 5000), (4, 1)])
def test_against_all_windows(spark, window, hot):
    rows = random_rows(window, 60)
    assert removed(spark, rows, window, hot=hot) == reference(rows, window)


def test_texts_of_any_kind(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(5, passage), (3, f"before {passage} after"), (3, passage), (8, f"x\t{passage}\r\ny {passage}"), (None, passage)]
    rows += [(1, None), (2, ""), (9, "short"), (9, "short"), (11, "a " * 30_000), (12, "a " * 14), (13, "b" * 100_000), (14, "é\x85ü " * 20)]
    assert removed(spark, rows, 13) == reference(rows, 13)


def test_empty_table(spark):
    assert removed(spark, [], 13) == []


def test_automaton_against_all_windows():
    rng = random.Random(7)
    for _ in range(40):
        passages = [([rng.choice("ab") for _ in range(rng.randint(1, 15))], rng.randrange(9)) for _ in range(8)]
        automaton = substring.SuffixAutomaton()
        for words, number in passages:
            automaton.add(words, number)
        automaton.close()
        for words, _ in passages + [([rng.choice("abc") for _ in range(12)], 0)]:
            for window in (2, 4):
                want = []
                for k in range(len(words) - window + 1):
                    part = words[k : k + window]
                    having = [n for w, n in passages if any(w[i : i + window] == part for i in range(len(w)))]
                    want.append(min(having, default=substring.NEVER))
                assert automaton.lowest(words, window) == want
