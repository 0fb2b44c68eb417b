"""Toxicity by a string-kernel support vector machine over gapped letter subsequences.

The kernel of two letter runs counts their common subsequences of three
letters, each weighted by ``DECAY`` to the length it spans in both, so a run
with letters put in between, left out or appended stays close to the run it was
made from. A text is a bag of runs and as toxic as its worst run. Seeds for the
toxic runs come from labelled texts, Nyström landmarks make the kernel a finite
map, and the machine's weights over landmarks fold into one weight per
three-letter subsequence, so a run is scored without any landmark.
"""

from __future__ import annotations

import re
import warnings
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import col, sliced, stored

DECAY = 0.6
LETTERS = 32
#: Longer runs are scored as windows of this many letters.
WINDOW, STRIDE = 12, 4
#: Scores of words that a task keeps at a time.
CACHE = 400_000
SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:\s+\S){2,}(?=\s|$)")
# Letters that digits and signs stand for.
LOOKALIKE = str.maketrans("013457@$", "oieastas")


def _letter_code(ch: str) -> int:
    base = unicodedata.normalize("NFKD", ch)[0]
    return ord(base) - 97 if "a" <= base <= "z" else 26 + ord(base) % 6


class _Codes(dict):
    def __missing__(self, ch: str) -> int:
        self[ch] = _letter_code(ch)
        return self[ch]


_codes = _Codes()


def words_of(text: str) -> set[str]:
    """The distinct lower-case words; three or more lone characters in a row are one word as well."""
    text = text.lower()
    words = set(text.split())
    for found in SPACED.finditer(text):
        words.add("".join(found.group().split()))
    return words


def runs_of(word: str) -> list[str]:
    """The letters of a word without signs in between, as runs of at most ``WINDOW`` letters."""
    letters = word if word.isalpha() else "".join(filter(str.isalpha, word.translate(LOOKALIKE)))
    n = len(letters)
    if n <= WINDOW:
        return [letters] if n >= 3 else []
    return [letters[i : i + WINDOW] for i in [*range(0, n - WINDOW, STRIDE), n - WINDOW]]


class _Subsequences:
    """Positions and weights of all three-letter subsequences of runs of one length."""

    def __init__(self):
        self.known = {}

    def __call__(self, n: int):
        if n not in self.known:
            at = np.array(list(combinations(range(n), 3)), dtype="int64").T
            self.known[n] = (*at, DECAY ** (at[2] - at[0] + 1.0))
        return self.known[n]


_subsequences = _Subsequences()


def _norms(codes: np.ndarray) -> np.ndarray:
    """Length of the feature vector of each run, by the kernel's recursion of each with itself."""
    rows, n = codes.shape
    total = np.zeros(rows)
    one = np.zeros((n + 1, rows))  # weighted common subsequences of one letter, up to a position
    two = np.zeros((n + 1, rows))
    for a in range(n):
        new_one, new_two = DECAY * one, DECAY * two
        tail_one, tail_two = np.zeros(rows), np.zeros(rows)
        for j in range(n):
            same = (codes[:, a] == codes[:, j]) * DECAY**2
            total += same * two[j]
            tail_one, tail_two = DECAY * tail_one + same, DECAY * tail_two + same * one[j]
            new_one[j + 1] += tail_one
            new_two[j + 1] += tail_two
        one, two = new_one, new_two
    return np.sqrt(total)


def _by_length(runs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the runs of each length are, and their letter codes, in bounded blocks."""
    lengths = np.fromiter(map(len, runs), "int64", len(runs))
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        for i in range(0, len(where), 4096):
            block = where[i : i + 4096]
            joined = "".join([runs[k] for k in block])
            yield block, np.fromiter(map(_codes.__getitem__, joined), "int64", len(joined)).reshape(-1, n)


def linear_scores(runs: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the subsequence weights of each run, in its normalised feature space."""
    scores = np.zeros(len(runs))
    for where, codes in _by_length(runs):
        first, second, third, decay = _subsequences(codes.shape[1])
        at = (codes * LETTERS**2).astype("int32")[:, first]
        at += (codes * LETTERS).astype("int32")[:, second]
        at += codes.astype("int32")[:, third]
        scores[where] = (weights[at] @ decay) / _norms(codes)
    return scores


def features(run: str) -> np.ndarray:
    """The normalised feature vector of one run, over all three-letter subsequences."""
    codes = np.array([_codes[c] for c in run])
    first, second, third, decay = _subsequences(len(run))
    at = (codes[first] * LETTERS + codes[second]) * LETTERS + codes[third]
    vector = np.bincount(at, weights=decay, minlength=LETTERS**3)
    return vector / np.linalg.norm(vector)


@dataclass
class ToxicityModel:
    """Weights of the subsequences, and the curve from a text's worst run to its score."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def margins(self, texts: list[str], cache: dict) -> np.ndarray:
        """The largest margin of any run of each text; below all margins where there is no run."""
        bags = [words_of(t) for t in texts]
        if len(cache) > CACHE:
            cache.clear()
        fresh = list(set().union(*bags) - cache.keys())
        runs, owner = [], []
        for i, word in enumerate(fresh):
            found = runs_of(word)
            runs += found
            owner += [i] * len(found)
        best = np.full(len(fresh), -2.0)
        np.maximum.at(best, np.array(owner, "int64"), linear_scores(runs, self.weights) + self.bias)
        cache.update(zip(fresh, best.tolist(), strict=True))
        return np.array([max(map(cache.__getitem__, bag), default=-2.0) for bag in bags])

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * margins + self.offset)))


def _batches(texts: list[str], size: int = 512) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def training_part(doc_id: Column) -> Column:
    """Whether a row's label may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 6000, seed: int = 8) -> DataFrame:
    """A bounded sample of labelled texts: the ids with the smallest hashes of each class.

    At most ``toxic`` and ``clean`` ids, which is what makes the join a
    broadcast of proven size; an id that several rows carry counts with one of
    its texts. Rows without an id, a text or a label are left out.
    """
    marked = labels.select(col(labels, "doc_id").alias("id"), col(labels, "toxic").alias("toxic"))
    marked = marked.where(training_part(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("id", F.lit(seed))
    picked = [marked.where(F.col("toxic") == k).orderBy(order, "id").limit(n) for k, n in ((1, toxic), (0, clean))]
    ids = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"))
    found = texts.join(ids, F.col("doc_id") == F.col("id")).where("text is not null")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _grams(word: str) -> set[str]:
    return {f"^{word}"[i : i + 4] for i in range(len(word) - 2)}


def _counted(sample: DataFrame, parts, name: str) -> DataFrame:
    """Toxic and clean texts of the sample that hold each part of a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[toxic].update({p for w in words_of(text) for r in runs_of(w) for p in parts(r)})
        every = list(held[0].keys() | held[1].keys())
        for i in range(0, len(every), 50_000):
            some = every[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({name: some, "toxic": [held[1][g] for g in some], "clean": [held[0][g] for g in some]})

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, f"{name} string, toxic bigint, clean bigint")
    return rows.groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _cover(held: list[list[str]], gain: dict[str, float], least: int, most: int) -> list[str]:
    """Seeds in the order in which each gains most from the texts that none before it explains."""
    left, chosen = [set(h) for h in held], []
    while len(chosen) < most:
        votes = Counter(g for h in left for g in h)
        if not votes:
            break
        best = max(votes, key=lambda g: (votes[g] * gain[g], g))
        if votes[best] < least:
            break
        chosen.append(best)
        left = [h for h in left if best not in h]
    return chosen


def _at_most(ordered: DataFrame, most: int, what: str) -> list:
    """The first rows of an ordered frame, with a warning if there are more."""
    rows = ordered.limit(most + 1).collect()
    if len(rows) > most:
        warnings.warn(f"only the first {most} {what} are used", stacklevel=3)
    return rows[:most]


def fit_toxicity(
    sample: DataFrame,
    odds: float = 15.0,
    least: int = 3,
    seeds: int = 200,
    landmarks: int = 160,
    negatives: int = 12_000,
    positives: int = 2_000,
    parts: int = 20_000,
) -> ToxicityModel:
    """Train on a sample of ``labelled_sample``'s form.

    1. Four-letter parts of words that toxic texts hold ``odds`` times as often
       as clean ones are candidates; the fewest that cover the toxic texts,
       each at least ``least`` not covered before, are the seeds. Copies of one
       text thus give one seed and not all their words. Only the ``parts``
       candidates that most toxic texts hold are looked at.
    2. Runs with a seed and those odds are positive, at most ``positives``. Runs of clean texts, at
       most ``negatives``, are negative, those with a seed before the others.
    3. A squared-hinge machine on Nyström features over ``landmarks`` runs.
    4. A logistic curve from the worst margin of each text to its label.

    What reaches the driver is bounded by the parameters; a warning says when
    ``parts`` or ``positives`` leaves anything out. Without labels of
    both kinds, or without any seed, every score is 0.
    """
    sample = stored(sample, "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(None)
    ratio = ((F.col("toxic") + 0.2) / (toxic + 1)) / ((F.col("clean") + 0.2) / (clean + 1))
    candidates = _counted(sample, _grams, "gram").withColumn("ratio", ratio)
    candidates = candidates.where((F.col("toxic") >= least) & (F.col("ratio") >= odds))
    best = _at_most(candidates.orderBy(F.desc("toxic"), "gram"), parts, "candidate parts of words")
    gain = {r["gram"]: float(np.log(r["ratio"])) for r in best}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({g for w in words_of(t) for r in runs_of(w) for g in _grams(r)} & gain.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"grams": pa.array(found, pa.list_(pa.string()))})

    chosen = sample.where("toxic = 1").select("text").mapInArrow(held, "grams array<string>").collect()
    seeded = set(_cover(sorted(r["grams"] for r in chosen), gain, least, seeds))
    if not seeded:
        return ToxicityModel(None)

    runs = _counted(sample, lambda r: (r,), "run")
    has_seed = F.concat(F.lit("^"), "run").rlike("|".join(re.escape(s) for s in sorted(seeded)))
    order = F.xxhash64("run")
    positive = runs.where(has_seed & (ratio >= odds)).orderBy(F.desc("toxic"), order)
    positive = [r["run"] for r in _at_most(positive, positives, "positive runs")]
    taken = set(positive)
    negative = [r["run"] for r in runs.where("clean > 0").orderBy(~has_seed, order).limit(negatives).collect() if r["run"] not in taken]
    half = landmarks // 2
    base = positive[:half] + negative[: landmarks - half]
    weights, bias = _machine(positive, negative, base)
    model = ToxicityModel(weights, bias)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in sliced(batches):
            texts = batch.column(0).to_pylist()
            margins = np.concatenate([model.margins(part, cache) for part in _batches(texts)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"margin": margins, "toxic": batch.column(1).cast(pa.int32())})

    fitted = sample.select("text", F.col("toxic").cast("int")).mapInArrow(worst, "margin double, toxic int").collect()
    fitted = sorted(fitted)
    model.slope, model.offset = _curve(np.array([r[0] for r in fitted]), np.array([r[1] for r in fitted], "float64"))
    return model


def _machine(positive: list[str], negative: list[str], base: list[str], ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights over three-letter subsequences and a bias, by Newton steps on the squared hinge loss."""
    rows = np.stack([features(r) for r in base])
    values, vectors = np.linalg.eigh(rows @ rows.T)
    kept = values > 1e-8 * values.max()
    to_map = rows.T @ (vectors[:, kept] / np.sqrt(values[kept]))
    every = positive + negative
    x = np.stack([linear_scores(every, to_map[:, j]) for j in range(to_map.shape[1])] + [np.ones(len(every))], axis=1)
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.r_[np.full(len(positive), 0.5 / len(positive)), np.full(len(negative), 0.5 / max(1, len(negative)))]
    penalty = np.eye(x.shape[1]) * ridge / 10
    penalty[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        h = (x[inside] * cost[inside, None]).T @ x[inside] + penalty
        new = np.linalg.solve(h, (x[inside] * cost[inside, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return to_map @ w[:-1], float(w[-1])


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve; both classes weigh the same, targets are smoothed."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / zeros)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (weight * (p - target)) + 1e-5 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(2)
        step = np.linalg.solve(h, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or above).

    Whole texts are read; a null text counts as an empty one. Columns of the
    input with these two names, in any case, are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    text = kept.index(text_col)
    picked = docs.select(*(col(docs, c) for c in kept))
    fields = T.StructType([*picked.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            if model.weights is None:
                scores = np.zeros(len(texts))
            else:
                parts = [model.margins(part, cache) for part in _batches(texts)]
                scores = model.probabilities(np.concatenate(parts)) if parts else np.zeros(0)
            columns = [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return picked.mapInArrow(scored, fields)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training."""
    return F.coalesce(~training_part(doc_id), F.lit(False))
