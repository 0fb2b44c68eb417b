"""Maximal periodic runs of words, by internal pattern matching.

Many documents are laid end to end, each closed by a word of its own. Doubling
gives the classes of equal blocks of 1, 2, 4, … words and with them the suffix
array; a wavelet matrix over the suffix array answers range-successor queries.
A run of period p holds, in its first p words, an aligned dyadic block of about
p / 4 words or more, and the same block p words later: each block looks for
its occurrences in the window where such a p may lie. Occurrences close to
each other form an arithmetic progression, which gives the candidate periods,
and extension to both sides, again by the blocks, gives the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import col

#: Documents are worked on together up to about this many words; one document is never cut.
TOGETHER = 1 << 17
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Blocks:
    """Classes of equal blocks of ``2 ** k`` words for every k at which any block repeats.

    ``rank[k][i]`` is the place in the suffix array where the class of the
    block at ``i`` begins, ``size[k][i]`` how many positions share it.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.order = np.argsort(words, kind="stable")
        self.rank: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        slots, keys = np.arange(n), words[self.order].astype(np.int64)
        rank = np.empty(n, np.int64)
        size = np.ones(n, np.int64)
        half = 0
        while len(slots):
            # The slots of one class are neighbours, and now sorted by their keys.
            new = np.ones(len(slots), bool)
            new[1:] = keys[1:] != keys[:-1]
            heads = np.flatnonzero(new)
            lengths = np.diff(np.append(heads, len(slots)))
            rank[self.order[slots]] = np.repeat(slots[heads], lengths)
            size[self.order[slots]] = np.repeat(lengths, lengths)
            slots = slots[np.repeat(lengths > 1, lengths)]
            if not len(slots):
                break
            self.rank.append(rank.copy())
            self.size.append(size.copy())
            half = half * 2 or 1
            members = self.order[slots]
            after = np.where(members + half < n, rank[np.minimum(members + half, n - 1)] + 1, 0)
            keys = rank[members] * (n + 1) + after
            sorting = np.argsort(keys, kind="stable")
            self.order[slots], keys = members[sorting], keys[sorting]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are the same; ``i < j``."""
        total = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.rank))):
            total += (self.rank[k][i + total] == self.rank[k][j + total]).astype(np.int64) << k
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` are the same; ``i < j``."""
        total = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.rank))):
            a, b = i - total - (1 << k), j - total - (1 << k)
            total += ((a >= 0) & (self.rank[k][np.maximum(a, 0)] == self.rank[k][np.maximum(b, 0)])).astype(np.int64) << k
        return total


class Wavelet:
    """A wavelet matrix over the suffix array: range counts and range successors, many at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros = np.empty((self.bits, len(values) + 1), np.int32)
        values = values.astype(np.int32)
        for level in range(self.bits):
            unset = (values >> (self.bits - 1 - level)) & 1 == 0
            self.zeros[level, 0] = 0
            np.cumsum(unset, out=self.zeros[level, 1:])
            values = np.concatenate([values[unset], values[~unset]])

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values in ``[left, right)`` are smaller than ``value``."""
        found = np.where(value >= 1 << self.bits, right - left, 0)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[left], zeros[right]
            up = (value >> (self.bits - 1 - level)) & 1 == 1
            found += np.where(up & (value < 1 << self.bits), b - a, 0)
            left = np.where(up, zeros[-1] + left - a, a)
            right = np.where(up, zeros[-1] + right - b, b)
        return found

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest of the values in ``[left, right)``, from 0."""
        value = np.zeros(len(left), np.int64)
        for zeros in self.zeros:
            a, b = zeros[left], zeros[right]
            up = n >= b - a
            value = value * 2 + up
            n = np.where(up, n - (b - a), n)
            left = np.where(up, zeros[-1] + left - a, a)
            right = np.where(up, zeros[-1] + right - b, b)
        return value


def windows(levels: int, least: int) -> list[tuple[int, int, int]]:
    """For each block size 2 ** k, the distances at which its blocks look for themselves.

    A run of period p has ``max(least, 2 * p) - p`` words or more that come
    again p words later. An aligned block of ``2 ** k`` words lies in any
    ``2 ** (k + 1) - 1`` words; the largest such block is sought.
    """
    found: dict[int, tuple[int, int]] = {}
    p = 1
    while True:
        k = (max(least, 2 * p) - p + 1).bit_length() - 2
        grows = 2 * p >= least  # with p, from here on
        if grows and k >= levels:
            break
        last = (1 << (k + 2)) - 2 if grows else p
        if k < levels:
            low, high = found.get(k, (p, last))
            found[k] = (min(low, p), max(high, last))
        p = last + 1
    return [(k, *found[k]) for k in sorted(found)]


def find_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs of at least ``max(least, 2 * period)`` words: starts, lengths, smallest periods.

    ``words`` are numbers; the last is unlike all others.
    """
    blocks = Blocks(words)
    at: list[np.ndarray] = []
    by: list[np.ndarray] = []
    wavelet = None
    for k, low, high in windows(len(blocks.rank), least):
        i = np.arange(0, len(words), 1 << k)
        i = i[blocks.size[k][i] > 1]
        if not len(i):
            continue
        wavelet = wavelet or Wavelet(blocks.order)
        left = blocks.rank[k][i]
        right = left + blocks.size[k][i]
        before = wavelet.below(left, right, i + low)
        for first in range(low, high + 1, 1 << k):
            upto = wavelet.below(left, right, i + min(first + (1 << k), high + 1))
            some = upto > before
            _candidates(blocks, wavelet, i[some], left[some], right[some], before[some], upto[some], at, by)
            before = upto
    if not at:
        return (np.empty(0, np.int64),) * 3
    i, p = np.concatenate(at), np.concatenate(by)
    back = blocks.behind(i, i + p)
    start, length = i - back, back + p + blocks.ahead(i, i + p)
    true = length >= np.maximum(least, 2 * p)
    start, length, p = start[true], length[true], p[true]
    # Of several periods of one stretch the smallest counts.
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], p[new]


def _candidates(blocks, wavelet, i, left, right, before, upto, at, by) -> None:
    """Distances from ``i`` to occurrences in one window, which is no wider than the block.

    One or two occurrences are taken as they are. More form a progression of
    the block's period q. If the block's own q-periodic stretch reaches them,
    q is all that they tell; else each is a candidate.
    """
    if not len(i):
        return
    count = upto - before
    first = wavelet.nth(left, right, before)
    last = np.where(count > 1, wavelet.nth(left, right, upto - 1), first)
    at.append(i)
    by.append(first - i)
    two = count == 2
    at.append(i[two])
    by.append(last[two] - i[two])
    many = count > 2
    if not many.any():
        return
    i, first, last, count = i[many], first[many], last[many], count[many]
    q = (last - first) // (count - 1)
    same = i + q + blocks.ahead(i, i + q) > first + q
    at.append(i[same])
    by.append(q[same])
    i, first, q, count = i[~same], first[~same], q[~same], count[~same]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at.append(np.repeat(i, count))
    by.append(np.repeat(first - i, count) + nth * np.repeat(q, count))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has."""
    lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.string()))
    flat = lists.flatten()
    whole = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(whole.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return flat.filter(whole), np.diff(ends[offsets - offsets[0]])


def _collapsed(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text how many words it has, its runs by start and period, and its words without repeated periods."""
    words, counts = _split(texts)
    n, docs = len(words), len(counts)
    owner = np.repeat(np.arange(docs), counts)
    starts = np.cumsum(counts) - counts + np.arange(docs)  # one more place for each text before
    numbers = words.dictionary_encode().indices.to_numpy()
    laid = np.empty(n + docs, np.int64)
    places = np.arange(n) + owner
    laid[places] = numbers
    laid[starts + counts] = n + 1 + np.arange(docs)
    start, length, period = find_runs(laid, least)
    steps = np.zeros(n + docs + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    kept = np.cumsum(steps)[places] == 0
    of = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort((period, start))
    of, start, length, period = of[order], start[order], length[order], period[order]
    ends = np.searchsorted(of, np.arange(docs + 1))
    fields = [pa.array(x, pa.int64()) for x in (start - starts[of], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=docs))])
    left = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(kept)))
    return pa.array(counts, pa.int64()), runs, pc.binary_join(left, " ")


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs``, ``collapsed``.

    A run is a stretch of words with smallest period p, at least ``least`` and
    ``2 * p`` words long, that no neighbouring word extends. ``runs`` has all
    of them by start and period, ``collapsed`` the words, joined by blanks,
    that are in no run or only in the first period of every run they are in.

    Words are runs of anything but ASCII white space. A null or empty text has
    no words and no runs. Equal rows are treated alike, other columns are not
    read, and an empty table gives no rows. A text is worked on whole, by one
    task, in n log n steps and about 16 n bytes for every doubling of the
    longest block that repeats.
    """
    picked = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            bytes_to = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            group = bytes_to // (6 * TOGETHER)  # about six bytes a word
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    found = _collapsed(texts.slice(a, b - a), least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *found], ["doc_id", "n_words", "runs", "collapsed"])

    return picked.mapInArrow(worked, f"doc_id {id_type}, n_words bigint, runs {RUN}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, of those the first, and of those the one of smallest period; null without runs."""
    keys = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))
    return F.transform(F.array(F.array_min(keys)), lambda k: F.struct(k["s"].alias("start"), (-k["n"]).alias("length"), k["p"].alias("period")))[0]
