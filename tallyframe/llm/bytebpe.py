"""Byte-level BPE in higher-order functions: ranked merges are folded over the bytes of distinct words.

The vocabulary becomes a literal: small maps from a piece's bytes to its rank,
found by a hash of the piece. Words are the matches of the
vocabulary's pattern. Decoding joins the pieces of the ids. No occurrence of a
word is ever shuffled:

* ``encode_by_task`` folds the distinct words of every task. Arrow batches number
  the words and lay the folded ids out again; the folding between is the higher-order function.
* ``encode`` has no Python at all: words that are frequent in the corpus are folded ahead and
  become a literal of bounded size, any other word is folded where it stands.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from tallyframe.llm.common import col, stored

#: What ``\s`` is in the pattern, spelled out for Java, whose own is ASCII alone.
SPACES = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Words that become part of the plan, and their bytes: at most 8 MB of text.
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
#: Distinct words that a task keeps in mind; it forgets them all before a batch that could exceed this.
KEPT = 1 << 20
#: Words of a batch that are laid out at a time.
LAID = 1 << 18
#: Entries of a literal map that are found by one hash.
ENTRIES = 2
#: First bytes of a piece that tell which lengths to look up; three or more.
BEGINNING = 4
#: The character that stands for id 0; those above it are no surrogates.
FIRST = 0x10000
LATIN = "".join(map(chr, range(256)))


def java_pattern(pattern: str) -> str:
    """The pattern of a vocabulary with its white space as the Unicode property."""
    inside = re.sub(r"\[\^?[^\]]*\]", lambda m: m[0].replace("\\s", SPACES).replace("\\S", f"&&[^{SPACES}]"), pattern)
    return inside.replace("\\s", f"[{SPACES}]").replace("\\S", f"[^{SPACES}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a vocabulary file and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def two_parts(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two pieces whose merge, the last of the piece's own bytes, gives it."""
    parts, own = [piece[i : i + 1] for i in range(len(piece))], ranks[piece]
    while len(parts) > 2:
        low, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if low >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    if len(parts) != 2:
        raise ValueError(f"no merges of lower rank lead to the piece {piece!r}")
    return parts[0], parts[1]


@dataclass(frozen=True)
class Table:
    """A map that is looked up by a hash: an array of small maps."""

    maps: Column
    buckets: int

    @staticmethod
    def of(entries: dict[str, object], kind: str) -> Table:
        """A table that becomes one literal when the plan is made."""
        buckets = 1 << (len(entries) // ENTRIES).bit_length()
        dealt: list[dict[str, object]] = [{} for _ in range(buckets)]
        for key, value in entries.items():
            dealt[xxhash.xxh64_intdigest(key.encode(), seed=42) & (buckets - 1)][key] = value
        return Table(F.from_json(F.lit(json.dumps(dealt, separators=(",", ":"))), f"array<map<string,{kind}>>"), buckets)

    def bound(self, body: Callable[[Table], Column]) -> Column:
        """``body`` of this table, with the literal in the plan only once."""
        return _let(self.maps, lambda maps: body(Table(maps, self.buckets)))

    def get(self, key: Column) -> Column:
        """The value at ``key``, or null."""
        at = F.xxhash64(key).bitwiseAND(F.lit(self.buckets - 1)).cast("int")
        return F.try_element_at(F.get(self.maps, at), key)


class Vocabulary:
    """Ranks, which are also the ids, and the pattern that cuts a text into words.

    All single bytes must be pieces, and every other piece must come out of two
    pieces of lower rank when its own bytes are merged, as training gives; then the
    order of ranks is the order of merges.

    Inside a word an id is one character, ``FIRST`` and on, and a byte the
    character of that number, so that a merge is the replacement of two characters by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.pattern = java_pattern(pattern)
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        pieces: list[str | None] = [None] * size
        merges: list[str | None] = [None] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
            if len(piece) > 1:
                merges[rank] = "".join(chr(FIRST + ranks[part]) for part in two_parts(piece, ranks))
        literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<string>")
        self.ranks = Table.of({piece.decode("latin-1"): rank for piece, rank in ranks.items() if len(piece) > 1}, "int")
        lengths: dict[bytes, set[int]] = {}
        for piece in ranks:
            if len(piece) >= BEGINNING:
                begun = (n for n in range(2, BEGINNING) if piece[:n] in ranks)
                lengths.setdefault(piece[:BEGINNING], set()).update((len(piece), *begun))
        self.lengths = Table.of({begin.decode("latin-1"): sorted(held) for begin, held in lengths.items()}, "array<int>")
        self.merges = literal(merges)
        self.merged = literal([chr(FIRST + i) for i in range(size)])
        self.single = "".join(chr(FIRST + ranks[bytes([b])]) for b in range(256))
        self.pieces = literal(pieces)
        self.binary = pa.array([None if piece is None else bytes.fromhex(piece) for piece in pieces], pa.binary())
        self.digits = literal([i.to_bytes(4, "little").hex() for i in range(size)])

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def bound(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` of the function that folds a word, with the vocabulary in the plan only once.

        All pieces that a word's bytes hold anywhere are looked up, of the lengths that pieces with
        the same first bytes have. Their merges are folded over the word by rank; each takes, from the
        left, all places where its two parts have come to stand side by side.
        """
        short = F.array(*map(F.lit, range(2, BEGINNING)))

        def folded(word: Column, ranks: Table, lengths: Table, merges: Column, merged: Column) -> Column:
            def pieces(window: Column) -> Column:
                tried = F.coalesce(lengths.get(F.left(window, F.lit(BEGINNING))), short)
                return F.transform(F.filter(tried, lambda n: n <= F.length(window)), lambda n: ranks.get(F.left(window, n)))

            def ids(read: Column) -> Column:
                windows = F.regexp_extract_all(read, F.lit(f"(?s)(?=(.{{2,{self.longest}}}))"), F.lit(1))
                held = F.transform(windows, pieces)
                order = F.sort_array(F.array_distinct(F.array_compact(F.flatten(held))))
                start = F.translate(read, LATIN, self.single)
                return F.aggregate(order, start, lambda s, r: F.replace(s, F.get(merges, r), F.get(merged, r)))

            return _let(F.decode(word.cast("binary"), "ISO-8859-1"), ids)

        return self.ranks.bound(
            lambda ranks: self.lengths.bound(
                lambda lengths: _let(
                    F.struct(self.merges.alias("two"), self.merged.alias("one")),
                    lambda m: body(lambda word: folded(word, ranks, lengths, m["two"], m["one"])),
                )
            )
        )

    def fold(self, word: Column) -> Column:
        """The ids of one word, as characters."""
        return self.bound(lambda fold: fold(word))

    def ids(self, folded: Column) -> Column:
        """The numbers of ids that are characters."""
        characters = F.filter(F.split(folded, ""), lambda c: c != "")  # an empty text has one that is empty
        return F.transform(characters, lambda c: F.ascii(c) - FIRST)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their pieces, joined. An id without a piece gives null."""
        found = F.transform(ids, lambda i: F.get(self.pieces, i))
        return F.when(~F.exists(found, lambda p: p.isNull()), F.unhex(F.array_join(found, "")))

    def packed(self, ids: Column) -> Column:
        """The ids as unsigned 32-bit numbers, lowest byte first."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.digits, i)), ""))


def frequent_words(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Of the column ``word``, the most frequent distinct values, ``most`` at the most and short ones only.

    Counts are over all rows. Where the limit lies is read off a histogram of
    the counts' logarithms, so no task or driver sees more than its share;
    words seen once are left out, and so is the whole step of the histogram
    that would exceed the limit.
    """
    short = words.where(F.octet_length("word") <= FREQUENT_BYTES)
    counted = short.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = stored(counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")), "words")
    steps = counted.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in steps:
        total += row["n"]
        if total > most:
            break
        least = row["step"]
    return counted.where(F.lit(False) if least is None else F.col("step") >= least).select("word")


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", into: str = "ids", most: int = FREQUENT
) -> DataFrame:
    """All columns of ``docs`` and ``into``, the ids of the text; special tokens are ordinary text.

    A null or empty text has no ids. A column of the input with the name of
    ``into``, in any case, is replaced. ``most`` is how many distinct words are
    folded ahead; it changes the cost and not the ids.
    """
    text = col(docs, text_col)
    every = docs.select(F.explode(vocabulary.words(text)).alias("word"))
    once = frequent_words(every, most).select("word", vocabulary.fold(F.col("word")).alias("ids"))
    known = Table.of({row["word"]: row["ids"] for row in once.collect()}, "string")  # ``most`` rows at the most

    def folded(known: Table) -> Column:
        return vocabulary.bound(lambda fold: F.transform(vocabulary.words(text), lambda w: F.coalesce(known.get(w), fold(w))))

    names = [c for c in docs.columns if c.lower() != into.lower()]
    ids = vocabulary.ids(F.array_join(known.bound(folded), ""))
    return docs.select(*(col(docs, c).alias(c) for c in names), ids.alias(into))


def _numbered(batches: Iterator[pa.Array], kept: int) -> Iterator[pa.Array]:
    """Of lists of words: the words' numbers in the task, the words not seen before, and how many were seen before."""
    known: dict[str, int] = {}
    for words in batches:
        ends = np.cumsum(np.concatenate([[0], words.value_lengths().to_numpy(zero_copy_only=False)]))
        coded = words.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if known and len(known) + len(distinct) > kept:
            known.clear()
        before = len(known)
        number = np.fromiter((known.setdefault(w, len(known)) for w in distinct), np.int32, len(distinct))
        fresh = np.flatnonzero(number >= before)
        # Distinct words stand in the order of their first places, which are where the running maximum grows.
        first = np.searchsorted(np.maximum.accumulate(at), fresh) if len(at) else fresh
        rows = np.searchsorted(first, ends).astype(np.int32)  # fresh words ahead of each text
        yield pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(ends.astype(np.int32), number[at]),
                pa.ListArray.from_arrays(rows, coded.dictionary.take(pa.array(fresh))),
                pa.array(before + rows[:-1], pa.int32()),
            ],
            ["numbers", "fresh", "seen"],
        )


def _characters(folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of folded words, one after the other, and each word's count. Every id is one character of four bytes."""
    ends = np.frombuffer(folded.buffers()[1], np.int32)[folded.offset : folded.offset + len(folded) + 1]
    if not len(folded):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    four = np.frombuffer(folded.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 4).astype(np.int32)
    ids = ((four[:, 0] & 7) << 18 | (four[:, 1] & 63) << 12 | (four[:, 2] & 63) << 6 | four[:, 3] & 63) - FIRST
    return ids, np.diff(ends).astype(np.int64) // 4


def _laid_out(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The ids of texts from their words' numbers, the ids of fresh words and how many were seen before."""
    ids, counts, starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for numbers, folded, seen in batches:
        seen = seen.to_numpy(zero_copy_only=False)
        fresh = folded.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.concatenate([[0], numbers.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)]))
        at, words = numbers.flatten().to_numpy(), np.concatenate([[0], np.cumsum(fresh)])
        new, new_counts = _characters(folded.flatten())
        new_ends = np.concatenate([[0], np.cumsum(new_counts)])
        total = np.concatenate([[len(counts)], seen + fresh])
        forgot = np.flatnonzero((seen == 0) & (total[:-1] > 0))
        if np.any(np.delete(seen - total[:-1], forgot)):
            raise RuntimeError("rows came in another order than they were numbered")
        out, lengths = [], [np.zeros(1, np.int64)]
        cuts = np.unique(np.concatenate([[0], forgot, [len(seen)]]))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low in forgot:
                ids, counts = ids[:0], counts[:0]
            ids = np.concatenate([ids, new[new_ends[words[low]] : new_ends[words[high]]]])
            counts = np.concatenate([counts, new_counts[words[low] : words[high]]])
            starts = np.cumsum(counts) - counts
            for some in range(ends[low], ends[high], LAID):
                part = at[some : min(some + LAID, ends[high])]
                many = counts[part]
                behind = np.cumsum(many)
                place = np.arange(behind[-1]) + np.repeat(starts[part] - (behind - many), many)
                out.append(ids[place])
                lengths.append(many)
        upto = np.cumsum(np.concatenate(lengths))[ends]
        yield pa.ListArray.from_arrays(upto.astype(np.int32), np.concatenate(out) if out else np.zeros(0, np.int32))


def _as_bytes(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Of lists of ids: how many, the packed numbers, and the joined pieces."""
    counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends, numbers = np.concatenate([[0], np.cumsum(counts)]), ids.flatten()
    found = pieces.take(numbers)
    at = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)

    def binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), data])

    joined = found.buffers()[2] if len(found) else pa.py_buffer(b"")
    packed = binary(ends * 4, pa.py_buffer(numbers.to_numpy().astype("<u4")))
    return pa.StructArray.from_arrays([pa.array(counts), packed, binary(at[ends], joined)], ["n", "packed", "decoded"])


def encode_by_task(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text_col: str = "text",
    into: str = "ids",
    kept: int = KEPT,
    keep: list[str] | None = None,
    form: str = "ids",
) -> DataFrame:
    """What ``encode`` gives, with every distinct word of a task folded once instead of once per occurrence.

    A text carries the words that no earlier text of its task has; these are folded by the
    higher-order function of the vocabulary, and their ids are kept for the texts after it. Nothing is
    shuffled or broadcast but the vocabulary. ``kept`` bounds the words that a task keeps in mind beyond one batch;
    it changes the cost and not the ids. ``keep`` names the columns of the result besides
    ``into`` (default: all). Nulls, empty texts and columns are treated as in ``encode``.

    ``form="ids"`` gives an array of ids. ``form="bytes"`` gives a struct: ``n`` ids, ``packed`` as
    unsigned 32-bit numbers with the lowest byte first, and ``decoded``, the pieces of these ids joined.
    """
    if form not in ("ids", "bytes"):
        raise ValueError(f"unknown form {form!r}")
    pieces = vocabulary.binary
    others = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    own = [f"_{i}" for i in range(len(others))]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def words() -> Iterator[pa.Array]:
            for batch in batches:
                waiting.append(batch)
                yield batch.column(len(own))

        for found in _numbered(words(), kept):
            yield pa.RecordBatch.from_arrays([*waiting.pop().columns[: len(own)], *found.flatten()], [*own, *found.type.names])

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def found() -> Iterator[tuple[pa.Array, ...]]:
            for batch in batches:
                waiting.append(batch)
                yield tuple(batch.columns[len(own) :])

        for ids in _laid_out(found()):
            made = ids if form == "ids" else _as_bytes(ids, pieces)
            yield pa.RecordBatch.from_arrays([*waiting.pop().columns[: len(own)], made], [*own, "ids"])

    named = docs.select(*(col(docs, c).alias(n) for c, n in zip(others, own, strict=True)), vocabulary.words(col(docs, text_col)).alias("words"))
    types = named.schema.fields[: len(own)]
    schema = StructType([*types]).add("numbers", ArrayType(IntegerType())).add("fresh", ArrayType(StringType())).add("seen", IntegerType())
    rows = named.mapInArrow(numbered, schema)
    folded = vocabulary.bound(lambda fold: F.transform("fresh", fold))
    rows = rows.select(*own, "numbers", folded.alias("folded"), "seen")
    bytes_type = StructType().add("n", LongType()).add("packed", BinaryType()).add("decoded", BinaryType())
    rows = rows.mapInArrow(laid_out, StructType([*types]).add("ids", ArrayType(IntegerType()) if form == "ids" else bytes_type))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(others, own, strict=True)), F.col("ids").alias(into))
