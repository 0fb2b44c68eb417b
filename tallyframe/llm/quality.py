"""Quality by weak supervision: rules vote or abstain, their accuracies are learned, a posterior decides.

Rules are not all required to pass. Each votes for good, for bad, or not at
all; expectation maximisation over all documents estimates how often each rule
is right and how common good documents are, without labels; and a document is
kept if it is more likely good than not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import col, stored

BLANK = " \t\n\x0b\x0c\r"
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# What ends a sentence or a quotation, by script: Latin, Greek and Hebrew, Armenian, Arabic, Urdu,
# Indic, Thai, Burmese, Tibetan, Khmer, Ethiopic, Chinese and Japanese.
ENDS = ".!?:\"'" + "…”’»" + "·;׃" + "։" + "؟" + "۔" + "।॥" + "ฯ๚๛" + "၊။" + "།༎" + "។៕" + "።፧" + "。！？：．｡」』"
# Scripts without blanks between words: Thai and Lao, Tibetan, Burmese, Khmer, kana, Han and their extensions.
UNSPACED = re.compile(
    "[฀-໿ༀ-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+"
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FURTHER = ("n_lines", "n_distinct", "n_upper", "n_lettered", "n_ended", "n_unspaced")


def measure(text: str) -> tuple[int, ...]:
    """``COUNTS`` and ``FURTHER`` of one whole text.

    ``n_repeat_words`` counts the words in three-word windows that the text has
    more than once. ``n_upper`` and ``n_lettered`` count distinct words in
    capitals and with a letter of any script; ``n_lines`` lines with a word, ``n_ended``
    those that end a sentence; ``n_unspaced`` the code points of scripts written
    without blanks between words.
    """
    words = text.translate(_TO_SPACE).split(" ") if any(c in text for c in _ODD_SPACE) else None
    words = [w for w in words if w] if words is not None else text.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [s for s in text.split("\n") if s.strip(BLANK)]
    ended = sum(s.rstrip(BLANK)[-1] in ENDS for s in lines)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), "int64", n)
    upper = sum(map(str.isupper, numbers))
    lettered = sum(w.isalpha() or any(map(str.isalpha, w)) for w in numbers)
    unspaced = 0 if text.isascii() else sum(map(len, UNSPACED.findall(text)))
    further = len(lines), len(numbers), upper, lettered, ended, unspaced
    return n, word_chars, symbols, len(lines) - len(set(lines)), _repeated(ids, len(numbers)), *further


# Fixed value: what Python's split takes for white space and the word pattern does not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TO_SPACE = str.maketrans(dict.fromkeys(BLANK, " "))


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # three numbers no longer fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[starts + j] = True
    return int(covered.sum())


Test = Callable[[pd.DataFrame], pd.Series]


@dataclass(frozen=True)
class Rule:
    """Votes bad where one test holds, good where another does, and else abstains."""

    name: str
    bad: Test | None = None
    good: Test | None = None

    def votes(self, m: pd.DataFrame) -> np.ndarray:
        cast = np.zeros(len(m), "int64")
        if self.good:
            cast[self.good(m).to_numpy(bool)] = 1
        if self.bad:
            cast[self.bad(m).to_numpy(bool)] = -1
        return cast


def _share(part: str, whole: str) -> Test:
    return lambda m: m[part] / m[whole].clip(lower=1)


_word_length, _symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
_same_lines, _same_words = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
_capitals, _lettered, _ended = _share("n_upper", "n_distinct"), _share("n_lettered", "n_distinct"), _share("n_ended", "n_lines")


def _spaced(m: pd.DataFrame) -> pd.Series:
    """Whether blanks tell words apart, so that the length of words says something."""
    return m["n_unspaced"] * 2 <= m["word_chars"]


def _typical(m: pd.DataFrame) -> pd.Series:
    tidy = (m["n_words"] >= 50) & (_symbols(m) <= 0.1) & (_capitals(m) <= 0.2) & (_lettered(m) >= 0.8)
    return tidy & (~_spaced(m) | _word_length(m).between(2.5, 13))


# A defect votes bad and its absence says nothing; what prose has in common votes good.
RULES = (
    Rule("too_short", bad=lambda m: m["n_words"] < 50),
    Rule("odd_words", bad=lambda m: _spaced(m) & ~_word_length(m).between(2, 15)),
    Rule("symbols", bad=lambda m: _symbols(m) > 0.2),
    Rule("same_lines", bad=lambda m: _same_lines(m) > 0.3),
    Rule("same_words", bad=lambda m: _same_words(m) > 0.5),
    Rule("capitals", bad=lambda m: _capitals(m) > 0.4),
    Rule("no_letters", bad=lambda m: _lettered(m) < 0.6),
    Rule("unended", bad=lambda m: (_ended(m) < 0.05) & (m["n_lines"] >= 5)),
    Rule("prose", good=lambda m: _typical(m) & (_ended(m) >= 0.3)),
    Rule("varied_prose", good=lambda m: _typical(m) & (_same_words(m) <= 0.2)),
)


@dataclass
class VoteModel:
    """Evidence of each rule's votes, as log odds of good, and the share of good documents.

    ``when_good[r]`` and ``when_bad[r]`` are the probabilities that rule ``r``
    votes bad, abstains or votes good on a good and on a bad document.
    """

    when_good: np.ndarray
    when_bad: np.ndarray
    good: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes (-1, 0, 1); abstaining is no evidence."""
        odds = np.log(self.when_good / self.when_bad)
        against, in_favour = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        total = (votes == -1) @ against + (votes == 1) @ in_favour
        return 1 / (1 + np.exp(-np.clip(total + np.log(self.good / (1 - self.good)), -500, 500)))


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel | None:
    """Expectation maximisation over the distinct vote patterns and how many documents have each.

    It starts from the view that a document with any bad vote is bad with
    probability 0.9, and any other good with 0.9, and estimates for both
    classes how often each rule casts each vote, so a rule that votes good on
    everything carries no weight. That first view also enters as half a document
    per vote, so rules that never vote together with another keep it. A bad vote never counts in favour and a good
    vote never against. The share of good documents stays between 0.05 and
    0.95. Without votes there is no model.
    """
    if not len(votes):
        return None
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype("float64")
    good = np.where((votes == -1).any(axis=1), 0.1, 0.9)
    model = None
    for _ in range(rounds):
        tables = []
        for weight, first in ((counts * good, (0.05, 0.5, 0.45)), (counts * (1 - good), (0.45, 0.5, 0.05))):
            seen = np.einsum("p,prv->rv", weight, cast) + np.array(first)
            tables.append(seen / seen.sum(axis=1, keepdims=True))
        model = VoteModel(*tables, float(np.clip(counts @ good / counts.sum(), 0.05, 0.95)))
        after = model.posterior(votes)
        if np.abs(after - good).max() < 1e-9:
            break
        good = after
    return model


def vote(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of ``docs`` without the text, the counts, and ``votes``, one of -1, 0, 1 per rule."""
    names = [c for c in docs.columns if c.lower() not in (*COUNTS, *FURTHER, "votes")]
    text_at = names.index(text_col)
    picked = docs.select(*(col(docs, c) for c in names))
    kept = [i for i in range(len(names)) if i != text_at]
    fields = [picked.schema.fields[i] for i in kept] + [T.StructField(c, T.LongType()) for c in (*COUNTS, *FURTHER)]
    fields.append(T.StructField("votes", T.ArrayType(T.IntegerType())))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = [measure(t or "") for t in batch.column(text_at).to_pylist()]
            m = pd.DataFrame(counts, columns=[*COUNTS, *FURTHER], dtype="int64")
            cast = np.stack([rule.votes(m) for rule in rules], axis=1)
            columns = [*(batch.column(i) for i in kept), *(pa.array(m[c]) for c in (*COUNTS, *FURTHER))]
            columns.append(pa.array(list(cast.astype("int32")), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return picked.mapInArrow(judged, T.StructType(fields))


def judge_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of ``vote`` with ``posterior``, ``base_failed`` and ``kept``.

    All documents take part in the estimate: they are counted by vote pattern,
    of which there are at most 3 ** rules, whatever the number of documents,
    and only these counts reach the driver. ``base_failed`` is fewer than 50
    words, or more than half of the words repeated; such a document is never
    kept. A null text counts as an empty one. Repeated rows are judged alike;
    an empty table gives no rows. Columns of the input with an added name are
    replaced.
    """
    voted = stored(vote(docs, text_col, rules), "votes")
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    votes = np.array([r["votes"] for r in patterns], "int64").reshape(-1, len(rules))
    model = fit_votes(votes, np.array([r["n"] for r in patterns], "float64"))
    good = model.posterior(votes) if model else []
    rows = [(list(map(int, v)), float(p)) for v, p in zip(votes, good, strict=True)]
    table = docs.sparkSession.createDataFrame(rows, "pattern array<int>, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # At most 3 ** rules rows, so the broadcast is of a fixed size.
    joined = voted.drop("posterior", "base_failed", "kept").join(F.broadcast(table), F.col("votes") == F.col("pattern"), "left")
    joined = joined.drop("pattern").withColumn("base_failed", failed)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
