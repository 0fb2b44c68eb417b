"""Removal of word windows that an earlier document has too, by suffix automata.

Texts are not compared with every reference: a window goes to the shard that
its rarest-ordered five words (its anchor, the smallest hash of its five-word
groups) name, so equal windows always meet. A shard's suffix automaton is sent
to where the shard's passages are, instead of broadcasting all automata, whose
size would grow with the corpus. Anchors that only one text holds cannot carry
a repeat and are never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import col, shuffle_partitions, sliced, stored

GROUP = 5
#: Words of one automaton; the passages of one shard are never cut by it.
SHARD_WORDS = 60_000
#: Anchors that more texts hold send windows one by one, under keys of their own.
HOT = 5_000
NEVER = (1 << 63) - 1

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def anchors(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of each window of a text, from the words of the window alone."""
    n = len(words)
    if n < window:
        return np.zeros(0, "int64")
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", n)
    size = min(GROUP, window)
    groups = hashed[: n - size + 1] * _FACTORS[0]
    for j in range(1, size):
        groups += hashed[j : n - size + 1 + j] * _FACTORS[j]
    groups ^= groups >> np.uint64(31)
    groups *= _FACTORS[0]
    groups ^= groups >> np.uint64(29)
    low = groups[: n - window + 1].copy()
    for j in range(1, window - size + 1):
        np.minimum(low, groups[j : n - window + 1 + j], out=low)
    return low.view("int64")


class SuffixAutomaton:
    """All word sequences of a shard's passages, each with the smallest id that has it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [NEVER]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.low.append(NEVER)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, number: int) -> None:
        """Add the passage of the document ``number``."""
        last, following, length, link, low = 0, self.next, self.length, self.link, self.low
        for word in words:
            q = following[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0:
                    q = following[p].setdefault(word, new)
                    if q != new:
                        link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                        break
                    p = link[p]
                last = new
            if number < low[last]:
                low[last] = number

    def close(self) -> None:
        """Carry the smallest ids from the sequences to their suffixes."""
        low, link = self.low, self.link
        for state in sorted(range(1, len(low)), key=self.length.__getitem__, reverse=True):
            if low[state] < low[link[state]]:
                low[link[state]] = low[state]

    def lowest(self, words: list, window: int) -> list[int]:
        """For each window of a passage, the smallest id that has it; ``NEVER`` if none.

        The walk keeps the longest suffix read so far that the shard has, up to
        the window's length.
        """
        following, length, link, low = self.next, self.length, self.link, self.low
        state, matched, found = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            if matched > window:
                matched = window
            while matched == window and length[link[state]] >= window:
                state = link[state]
            if i >= window - 1:
                found.append(low[state] if matched == window else NEVER)
        return found


def _compressed(docs: DataFrame, text_at: int) -> DataFrame:
    """The same columns with the text as a compressed block, the form in which it is shuffled."""
    fields = list(docs.schema.fields)
    fields[text_at] = T.StructField(fields[text_at].name, T.BinaryType())

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches):
            blocks = [pack((t or "").encode()) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(blocks, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(compress, T.StructType(fields))


def _words(blocks: pa.Array) -> Iterator[list[bytes]]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(b).split() for b in blocks.to_pylist())


def _held_anchors(texts: DataFrame, window: int) -> DataFrame:
    """``anchor`` and ``k1`` for the distinct anchors of each text."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.unique(anchors(t.encode().split(), window)) for t in batch.column(0).to_pylist()]
            sizes = [len(f) for f in found]
            for i in range(0, len(found), 500):
                keys = np.repeat(batch.column(1)[i : i + 500].to_numpy(), sizes[i : i + 500])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[i : i + 500])), pa.array(keys)], ["anchor", "k1"])

    return texts.select("text", "k1").mapInArrow(held, "anchor bigint, k1 bigint")


def _passages(candidates: DataFrame, window: int, text_at: int) -> DataFrame:
    """The passages of texts under each repeated anchor, with the shard they belong to.

    ``candidates`` ends with ``repeated``, ``hot`` (arrays of anchors) and
    ``first_id``; two columns before them are the key of the text.
    """

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys1, keys2 = batch.column(batch.num_columns - 5).to_pylist(), batch.column(batch.num_columns - 4).to_pylist()
            repeated = batch.column(batch.num_columns - 3)
            hot, firsts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            rows: list[tuple] = []
            for r, words in enumerate(_words(batch.column(text_at))):
                own = anchors(words, window)
                inside = np.isin(own, repeated[r].values.to_numpy())
                if not inside.any():
                    continue
                single = np.isin(own, hot[r].values.to_numpy()) if len(hot[r].values) else np.zeros(len(own), bool)
                starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | single[1:]] & inside)
                change = np.flatnonzero(np.r_[(own[1:] != own[:-1]) | single[1:], True] & inside) + 1
                for s, e in zip(starts.tolist(), change.tolist(), strict=True):
                    passage = b" ".join(words[s : e + window - 1])
                    shard = xxhash.xxh64_intdigest(passage) - (1 << 63) if single[s] else int(own[s])
                    rows.append((shard, passage, keys1[r], keys2[r], firsts[r], s))
                if len(rows) >= 20_000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "passage", "k1", "k2", "first_id", "start"])

    return candidates.mapInArrow(passages, "shard bigint, passage binary, k1 bigint, k2 bigint, first_id bigint, start int")


def _lowest_ids(references: DataFrame, window: int) -> DataFrame:
    """The smallest id of each window of every distinct passage, by the automaton of its shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in sliced(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield through_automaton(held)
                    held, size = [], 0
                words = row[2].split(b" ")
                held.append((row[0], row[1], words, row[3]))
                size += len(words)
        if held:
            yield through_automaton(held)

    def through_automaton(held: list[tuple]) -> pa.RecordBatch:
        automaton, names = SuffixAutomaton(), {}
        numbered = [[names.setdefault(w, len(names)) for w in words] for _, _, words, _ in held]
        for words, (_, _, _, first) in zip(numbered, held, strict=True):
            automaton.add(words, first)
        automaton.close()
        lows = [automaton.lowest(words, window) for words in numbered]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held]), pa.array([h[1] for h in held]), pa.array(lows, pa.list_(pa.int64()))],
            ["shard", "pk", "lows"],
        )

    rows = references.select("shard", "pk", "passage", "first_id")
    rows = rows.repartition(shuffle_partitions(references.sparkSession), "shard").sortWithinPartitions("shard", "pk")
    return rows.mapInArrow(search, "shard bigint, pk bigint, lows array<bigint>")


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The columns of ``docs`` with what is left of the text, and ``n_words``, ``n_removed``.

    A word goes if one of the windows that cover it, ``window`` consecutive
    words, also starts in a document with a smaller id; windows are judged on
    the input. What stays is joined by single spaces. Equal texts are one
    reference with the smallest of their ids. Rows that share an id are never
    smaller than each other; a null id is smaller than none and has none
    smaller; a null text has no words; texts shorter than a window lose
    nothing. Columns of the input with the added names, in any case, are
    replaced. An empty table gives no rows.
    """
    added = ("n_words", "n_removed")
    names = [c for c in docs.columns if c.lower() not in added]
    id_at, text_at = names.index(id_col), names.index(text_col)
    plain = docs.select(*(col(docs, c).alias(f"_{i}") for i, c in enumerate(names)))
    text = F.coalesce(f"_{text_at}", F.lit(""))
    plain = plain.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(window), text)})
    keyed = _compressed(plain, text_at)
    number = F.col(f"_{id_at}").cast("bigint")

    held = _held_anchors(plain.select(text.alias("text"), "k1"), window)
    counted = held.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi"))
    shared = stored(counted.where("lo <> hi").select("anchor", (F.col("n") > hot).alias("hot")), "anchors")

    repeated = held.join(shared.withColumnRenamed("anchor", "a"), F.col("anchor") == F.col("a"))
    repeated = repeated.groupBy("k1").agg(
        F.collect_set("anchor").alias("repeated"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")
    )
    first = plain.groupBy("k1", "k2").agg(F.coalesce(F.min(number), F.lit(NEVER)).alias("first_id"))
    first = first.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first_id")
    per_text = repeated.join(first, F.col("k1") == F.col("f1")).select("f1", "f2", "repeated", "hot", "first_id")

    candidates = keyed.join(per_text, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")))
    kept_order = [*plain.columns, "repeated", "hot", "first_id"]
    found = _passages(candidates.select(*kept_order), window, text_at).withColumn("pk", F.xxhash64("passage"))
    references = found.groupBy("shard", "pk", "passage").agg(F.min("first_id").alias("first_id"))
    lows = _lowest_ids(references, window).withColumnsRenamed({"shard": "s", "pk": "p"})
    hits = found.select("shard", "pk", "k1", "k2", "first_id", "start")
    hits = hits.join(lows, (F.col("shard") == F.col("s")) & (F.col("pk") == F.col("p")))
    at = F.filter(F.transform("lows", lambda low, i: F.when(low < F.col("first_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = hits.select("k1", "k2", at.alias("at")).where(F.size("at") > 0)
    hits = hits.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.flatten(F.collect_set("at")).alias("at"))

    judged = keyed.join(first, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    judged = judged.join(hits, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    judged = judged.select(*plain.columns[: len(names)], number.alias("number"), "first_id", "at")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(names)
        for batch in sliced(batches):
            numbers, firsts = (batch.column(i).to_pylist() for i in (width, width + 1))
            out, n_words, n_removed = [], [], []
            for r, (words, own, earliest) in enumerate(zip(_words(batch.column(text_at)), numbers, firsts, strict=True)):
                n = len(words)
                if own is not None and own > earliest and n >= window:
                    kept = []
                elif own is not None and batch.column(width + 2)[r].is_valid:
                    edges = np.zeros(n + 1, "int64")
                    starts = np.unique(batch.column(width + 2)[r].values.to_numpy())
                    edges[starts] += 1
                    edges[starts + window] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                else:
                    kept = words
                out.append(b" ".join(kept).decode())
                n_words.append(n)
                n_removed.append(n - len(kept))
            columns = [*batch.columns[:width], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], *added])

    fields = [*plain.schema.fields[: len(names)], *(T.StructField(n, T.LongType()) for n in added)]
    done = judged.mapInArrow(remove, T.StructType(fields))
    return done.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), *added)
