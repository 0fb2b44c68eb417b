"""Near-duplicate documents by SimHash, found with a Gray-order hierarchical index.

The tree of the index is cut at one level. Above the cut, its upper nodes are
masked bit patterns that fingerprints share: of four blocks of bits, two
fingerprints with at most two differing bits agree in two, so they meet under
one of six patterns, and these patterns spread the fingerprints over the
cluster. Below the cut, one task sorts the fingerprints of a pattern by Gray
rank, factors the bits that neighbours share into nodes, and prunes whole nodes
as soon as the accumulated differences exceed the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import col, components, shuffle_partitions, sliced, stored

SEED = 42
FANOUT = 16
#: Fingerprints under one pattern that one task compares; more are dealt into tiles of this many.
TILE = 4096
#: Characters that a text counts as besides its own in the size of a tile; texts of as many again are usual.
WEIGHT = 2048
#: Pairs of a fingerprint and a node that a task holds at a time.
FRONTIER = 2_000_000


def fingerprint(text: str, size: int = 3) -> int:
    """The 64 majority bits of the XXH64 hashes of all word shingles; 0 without a word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), "int64", len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    size = min(size, len(words))
    parts = [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "uint64", len(parts))
    counts = np.zeros(64, "int64")
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="int64")
    majority = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(majority.view("uint64")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint as a signed long. Whole texts are read; null counts as empty."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    text = kept.index(text_col)
    picked = docs.select(*(col(docs, c) for c in kept))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) if t else 0 for t in batch.column(text).to_pylist()]
            column = pa.array(np.array(found, "uint64").view("int64"))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return picked.mapInArrow(fingerprints, T.StructType([*picked.schema.fields, T.StructField(name, T.LongType())]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence, in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Codes in Gray order under nodes that hold the bits all codes below them share."""

    def __init__(self, codes: np.ndarray):
        every = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.levels = [(every, self.codes)]  # masks and patterns, leaves first
        while len(self.levels[-1][0]) > 1:
            masks, patterns = self.levels[-1]
            starts = np.arange(0, len(masks), FANOUT)
            first = np.repeat(patterns[starts], np.diff(np.r_[starts, len(masks)]))
            shared = np.bitwise_and.reduceat(masks & ~(patterns ^ first), starts)
            self.levels.append((shared, patterns[starts] & shared))

    def within(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, code number) that differ in at most ``most`` bits."""
        masks, patterns = self.levels[-1]
        query = np.repeat(np.arange(len(queries)), len(masks))
        node = np.tile(np.arange(len(masks)), len(queries))
        differ = np.bitwise_count((queries[query] ^ patterns[node]) & masks[node]).astype("int8")
        for depth in range(len(self.levels) - 1, -1, -1):
            near = differ <= most
            query, node, differ = query[near], node[near], differ[near]
            if depth == 0:
                return query, node
            if depth == 1:
                leaves = np.resize(self.codes, len(self.levels[1][0]) * FANOUT).reshape(-1, FANOUT)
                near = np.bitwise_count(queries[query][:, None] ^ leaves[node]) <= most
                at, leaf = np.nonzero(near)
                leaf += node[at] * FANOUT
                real = leaf < len(self.codes)
                return query[at[real]], leaf[real]
            above = self.levels[depth][0]
            masks, patterns = self.levels[depth - 1]
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = child < len(masks)
            query, differ = np.repeat(query, FANOUT)[real], np.repeat(differ, FANOUT)[real]
            known, node = above[np.repeat(node, FANOUT)[real]], child[real]
            differ = differ + np.bitwise_count((queries[query] ^ patterns[node]) & masks[node] & ~known).astype("int8")
        raise AssertionError


class _Labels:
    """The smallest member that each of ``n`` members is joined with so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.of
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
        self.of = label

    def moved(self) -> np.ndarray:
        return np.flatnonzero(self.of != np.arange(len(self.of)))


def _joined(tree: GrayTree, most: int, known: np.ndarray | None = None) -> _Labels:
    """The components of a tree's codes with at most ``most`` differing bits, by pairs of two ``known`` components alone."""
    n = len(tree.codes)
    labels = _Labels(n)
    step = max(1, FRONTIER // (n + FANOUT))
    for start in range(0, n, step):
        a, b = tree.within(tree.codes[start : start + step], most)
        a = a + start
        new = a < b if known is None else (a < b) & (known[a] != known[b])
        labels.join(a[new], b[new])
    return labels


def linked(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct codes with at most ``most`` differing bits."""
    tree = GrayTree(codes)
    labels = _joined(tree, most)
    moved = labels.moved()
    return tree.codes[moved], tree.codes[labels.of[moved]]


def _patterns(code: Column, most: int, blocks: int) -> Column:
    """The masked patterns of a code, each with the number of its mask."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:], strict=False)]
    wanted = [sum(masks[i] for i in kept) for kept in combinations(range(blocks), blocks - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in wanted]
    return F.array(*(F.xxhash64(F.lit(i), code.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))


def _dealt(rows: DataFrame, key: str, member: str, tile: int, weight: Column | None = None) -> DataFrame:
    """Rows of keys with several members, by ``grp``: the key, or two of its tiles.

    A key with more than ``tile`` members, or members of more than that
    ``weight``, is dealt into tiles by hash, and every two tiles form a group,
    so a group never exceeds about two tiles.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1) if weight is None else weight).alias("weight"))
    sizes = sizes.where(F.col("n") > 1).select(F.col(key).alias("sized"), F.ceil(F.col("weight") / tile).cast("int").alias("tiles"))
    met = rows.join(sizes, F.col(key) == F.col("sized"))
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0))))
    dealt = met.withColumn("own", own).withColumn("other", other).where("own <> other or tiles = 1")
    group = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("grp")
    parts = dealt.select(group, *(c for c in rows.columns if c != key))
    return parts.repartition(shuffle_partitions(rows.sparkSession), "grp").sortWithinPartitions("grp")


def near_links(codes: DataFrame, most: int = 2, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the codes reachable over differences of ``most`` bits.

    ``codes`` has distinct longs in ``code``. The 64 bits are cut into
    ``blocks`` (``most + 2`` by default), and a pattern is any ``blocks -
    most`` of them; more blocks make longer patterns, hence smaller groups and
    more copies of each code. A pattern with more than ``tile``
    codes is dealt into tiles by hash, and every two tiles meet in a task, so
    no task holds more than about two tiles. A task gives links that span its
    components, fewer than its codes, and never all pairs.
    """
    spread = codes.select("code", F.explode(_patterns(F.col("code"), most, blocks or most + 2)).alias("pattern"))
    parts = _dealt(spread, "pattern", "code", tile)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), "int64")
        for batch in batches:
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            rows = np.concatenate([held, rows])
            cut = np.searchsorted(rows[:, 0], rows[-1, 0]) if len(rows) else 0
            yield from found(rows[:cut])
            held = rows[cut:]
        yield from found(held)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        ends = np.r_[starts[1:], len(rows)]
        links = [linked(rows[s:e, 1].copy().view("uint64"), most) for s, e in zip(starts, ends, strict=True) if e - s > 1]
        if links:
            a, b = (np.concatenate(side).view("int64") for side in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return parts.mapInArrow(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``code`` (the fingerprint) and ``component_id``.

    Documents with equal fingerprints are one node, however many there are,
    and nodes are linked at ``most`` differing bits or fewer. ``component_id``
    is the smallest id reachable. Repeated rows and ids give a row each; an id
    that is null is never the smallest, and a component of null ids has a null
    ``component_id``. Texts without a word have the code 0, which links like
    any other. Other columns are not read; an empty table gives no rows.
    """
    picked = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    coded = stored(with_fingerprint(picked, name="code").select("doc_id", "code"), "codes")
    nodes = stored(coded.groupBy("code").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(nodes.select(F.col("code").alias("node")), near_links(nodes.select("code"), most))
    found = nodes.join(found, F.col("code") == F.col("node")).select("code", "first_id", "component")
    found = stored(found, "components")
    lowest = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = found.join(lowest.withColumnRenamed("component", "c"), F.col("component") == F.col("c"))
    named = named.select(F.col("code").alias("k"), "component", "component_id")
    return coded.join(named, F.col("code") == F.col("k")).select("doc_id", "code", "component", "component_id")


#: Bits of a fingerprint that are compared in whole before the shingles are.
SKETCH = 512
#: How likely a pair of exactly the wanted similarity is in no table of the index.
MISSED = 1e-6
#: The chance that such a pair shares the pattern of a table, the longest pattern,
#: and the chance that the bits below it stay within the bound.
SHARE, LONGEST, KEPT = 1 / 12, 14, 0.85
#: Up to so many shingles, bits differ more than their angle says; such a text is in twice as many tables.
FEW = 5
#: One table in so many is searched first, and the others only between what these leave apart.
FIRST = 16
#: Rows of the index that a task searches at a time, and nodes whose rows it makes at a time.
ROWS, NODES = 1 << 17, 1 << 10


def _bands(agree: float) -> tuple[int, int]:
    """How many tables with patterns of how many bits leave a pair whose bits agree with this chance apart with one of ``MISSED`` at most."""
    if agree >= 1:
        return 1, LONGEST
    rows = max(1, min(LONGEST, round(np.log(SHARE) / np.log(agree))))
    return int(np.ceil(np.log(MISSED) / np.log1p(-KEPT * agree**rows))), rows


@lru_cache
def _tables(similarity: float) -> tuple[int, int, int]:
    """The tables of the index, the bits of their patterns, and the bits that may differ below a pattern.

    The cosine is least for two sets of one size; a few shingles differ in up
    to one bit in fourteen more than their angle says.
    """
    apart = 15 / 14 * float(np.arccos(min(1.0, 2 * similarity / (1 + similarity)))) / np.pi
    tables, length = _bands(1 - apart)
    below = 64 - length
    chances = np.cumsum([comb(below, k) * apart**k * (1 - apart) ** (below - k) for k in range(below + 1)])
    return tables, length, int(np.argmax(chances >= KEPT))


def _words(similarity: float) -> int:
    """The longs of a long fingerprint, which hold every table; that of a few shingles has twice as many."""
    tables, length, _ = _tables(similarity)
    return max(SKETCH, 64 * (-(-length * (tables - 1) // 64) + 1)) // 64


_SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(256)], "uint64")


def _word_hashes(text: str) -> np.ndarray:
    """The hashes of all words, in order."""
    words = text.encode().lower().split()
    distinct = set(words)
    hashes = map(xxhash.xxh64_intdigest, distinct)
    known = dict(zip(distinct, hashes, strict=True))
    return np.fromiter(map(known.__getitem__, words), "uint64", len(words))


def _shingles(each: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``size`` words; fewer words are one shingle."""
    size = min(size, len(each))
    found = each[: len(each) - size + 1].copy() if size else each
    for j in range(1, size):
        found = (found ^ (found >> np.uint64(29))) * _SEEDS[0] + each[j : len(each) - size + 1 + j]
    return np.unique(found)


def _long_fingerprint(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """The SimHash of a set of shingles with as many bits as its tables need, as unsigned longs."""
    seeds = _SEEDS[: _words(similarity) * (2 if len(shingles) <= FEW else 1)]
    counts = np.zeros(64 * len(seeds), "int64")
    for i in range(0, len(shingles), 255):
        mixed = shingles[i : i + 255, None] * seeds
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.view("uint8"), axis=1, bitorder="little").sum(axis=0, dtype="uint8")
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view("uint64")


def _table_codes(bits: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a matrix of long fingerprints the pattern and the code in every table.

    The code of a table is 64 bits in a row; its first bits, which no other
    table begins with, are the pattern, and the number of the table is in it.
    """
    tables, length, _ = _tables(similarity)
    tables *= 2 if bits.shape[1] > _words(similarity) else 1
    start = np.arange(tables, dtype="uint64") * np.uint64(length)
    word, shift = (start // np.uint64(64)).astype("int64"), start % np.uint64(64)
    after = np.minimum(word + 1, bits.shape[1] - 1)
    codes = (bits[:, word] >> shift) | (bits[:, after] << np.uint64(1)) << (np.uint64(63) - shift)
    number = np.arange(len(start), dtype="uint64") << np.uint64(length)
    return (number | codes & np.uint64((1 << length) - 1)).view("int64"), codes


def sketch(text: str, size: int = 5, similarity: float = 0.8) -> tuple[int, bytes, bytes, list[int]]:
    """The SimHash of the set of word shingles, and what else stands for that set.

    That is its first 64 bits, all bits, a digest of the whole set, and the
    patterns of the tables of the index, none for a text without a word.
    """
    found, digest = _sketched(text, size, similarity)
    if not found:
        return 0, b"", b"", []
    bits = np.frombuffer(found, "uint64")
    patterns = _table_codes(bits[None, :], similarity)[0][0].tolist()
    return int(bits[0]), found, digest, patterns


def _sketched(text: str, size: int, similarity: float) -> tuple[bytes, bytes]:
    """All bits of the SimHash of the set of word shingles, and a digest of the whole set; nothing without a word."""
    each = _word_hashes(text)
    if not len(each):
        return b"", b""
    shingles = _shingles(each, size)
    return _long_fingerprint(shingles, similarity).tobytes(), xxhash.xxh3_128_digest(shingles.tobytes())


def _spanning(bits: np.ndarray, most: int, alike=None, known=None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of sketches within ``most`` bits that are ``alike``, a test of two numbers.

    Pairs that are already connected are not compared, nor those that are so by
    their ``known`` components, of which one member each is linked.
    """
    first = np.arange(len(bits))
    if known is not None:
        _, at, of = np.unique(known, return_index=True, return_inverse=True)
        first = at[of]
    label = first.copy()
    for i in range(len(bits) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(rest):
            if (label == label[0]).all():
                break
            continue
        near = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype="int32") <= most]
        for j in near.tolist():
            if label[j] != label[i] and (alike is None or alike(i, j)):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    moved = np.flatnonzero((label != first) & (first == np.arange(len(label))))
    return moved, label[moved]


def _generous(similarity: float) -> int:
    """Bits in which sketches of sets of the similarity differ, and nine standard deviations more.

    The cosine is least for two sets of one size. Nine, because sets of a few
    shingles differ in some more bits than their angle says.
    """
    part = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(np.ceil(SKETCH * part + 9 * np.sqrt(SKETCH * part * (1 - part))))


def _by_group(batches: Iterator[pa.RecordBatch], links) -> Iterator[pa.RecordBatch]:
    """The links ``a``, ``b`` of each run of rows with one first value; ``links`` gives numbers of its rows.

    Rows are in the order of their second value, so that runs that share most
    rows link them with the same ones.
    """
    held: list[tuple] = []

    def found() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            held.sort(key=lambda h: h[1])
            ids = np.array([h[1] for h in held])
            bits = np.frombuffer(b"".join(h[2] for h in held), "uint64").reshape(len(held), -1)
            a, b = links(held, bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != row[0]:
                yield from found()
                held = []
            held.append(row)
    yield from found()


def _crowded(nodes: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Patterns that more than ``tile`` nodes may share, and in how many tiles to deal them.

    A pattern with more than ``tile`` nodes has more than its share in some
    task, so only what a task sees that often is counted.
    """
    tables, length, _ = _tables(similarity)
    every = max(1, nodes.count())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One array a task, and only the pages of patterns that occur are touched.
        counts, n = np.zeros(2 * tables << length, "uint32"), 0
        for batch in batches:
            n += len(batch)
            for patterns, _, _ in _rows(batch, similarity):
                np.add.at(counts, patterns.ravel(), np.uint32(1))
        often = np.flatnonzero(counts > tile * n // every)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(counts[often].astype("int64"))], ["crowd", "n"])

    found = nodes.select("sketch", "node").mapInArrow(counted, "crowd bigint, n bigint").groupBy("crowd").agg(F.sum("n").alias("n"))
    return found.select("crowd", (F.ceil(F.col("n") / tile) + 1).cast("int").alias("tiles"))


def _rows(batch: pa.RecordBatch, similarity: float, first: bool | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Patterns and codes by node and table, and the places of the nodes, from long fingerprints in the first column.

    All tables, or only the first ones to be searched, or only the others.
    """
    sketches = batch.column(0)
    sizes = pc.binary_length(sketches).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        chosen = np.flatnonzero(sizes == size)
        for start in range(0, len(chosen), NODES):
            at = chosen[start : start + NODES]
            bits = np.frombuffer(b"".join(sketches.take(pa.array(at)).to_pylist()), "uint64").reshape(len(at), -1)
            patterns, codes = _table_codes(bits, similarity)
            tables = slice(None) if first is None else (np.arange(patterns.shape[1]) % FIRST == 0) == first
            yield patterns[:, tables], codes[:, tables], at


def _met(codes: np.ndarray, groups: np.ndarray, most: int, known: np.ndarray | None = None) -> np.ndarray:
    """The smallest row that each row is joined with, over codes of one group with at most ``most`` differing bits.

    Rows of a group follow each other. Groups that one node of the tree holds
    have no level to prune and are compared together. Where ``known`` components
    are given, only pairs of two of them count.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    links = []
    for n in range(2, FANOUT + 1):
        rows = starts[sizes == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(codes[rows[:, i]] ^ codes[rows[:, j]]) <= most
        if known is not None:
            near &= known[rows[:, i]] != known[rows[:, j]]
        at, pair = np.nonzero(near)
        links.append((rows[at, i[pair]], rows[at, j[pair]]))
    for start, n in zip(starts[sizes > FANOUT].tolist(), sizes[sizes > FANOUT].tolist(), strict=True):
        order = start + np.argsort(gray_rank(codes[start : start + n]), kind="stable")
        tree = GrayTree(codes[order])
        labels = _joined(tree, most, None if known is None else known[order])
        moved = labels.moved()
        links.append((order[moved], order[labels.of[moved]]))
    every = _Labels(len(codes))
    every.join(*(np.concatenate(side) for side in zip(*links, strict=True)))
    return every.of


def _met_by_table(nodes: DataFrame, similarity: float, tile: int, first: bool | None, crowded: DataFrame, found, schema: str) -> DataFrame:
    """What ``found`` gives of the rows of the index that the trees of the ``first``, the other or all tables join.

    ``nodes`` has the long fingerprint ``sketch``, ``node`` and one more column,
    which goes with every row. Every table is an index of its own over 64 of
    the bits: nodes meet under a pattern, and below it the tree links codes
    within the bound. ``found`` takes the smallest row that each row is joined
    with, the nodes, and the further column, of the joined rows alone, by that
    row and node. If that column is ``known``, only pairs of two known
    components are joined.
    """
    _, length, most = _tables(similarity)
    more = nodes.columns[2]
    kind = nodes.schema[more].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for patterns, codes, at in _rows(batch, similarity, first):
                each = pa.array(np.repeat(at, patterns.shape[1]))
                columns = [pa.array(patterns.ravel()), pa.array(codes.ravel().view("int64")), batch.column(1).take(each), batch.column(2).take(each)]
                yield pa.RecordBatch.from_arrays(columns, ["pattern", "code", "node", more])

    rows = nodes.mapInArrow(spread, f"pattern bigint, code bigint, node bigint, {more} {kind}")
    rows = rows.join(crowded, F.col("pattern") == F.col("crowd"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    others = F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))
    dealt = rows.select("pattern", "code", "node", more, "tiles", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.where("own <> other or tiles = 1")
    pair = F.least("own", "other").cast("bigint") * F.col("tiles") + F.greatest("own", "other")
    group = F.col("pattern") + F.shiftleft(pair, (_tables(similarity)[0] * 2 << length).bit_length())
    parts = dealt.select(group.alias("grp"), "code", "node", more)
    parts = parts.repartition(shuffle_partitions(nodes.sparkSession), "grp").sortWithinPartitions("grp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                groups = rows.column(0).to_numpy()
                cut = int(np.searchsorted(groups, groups[-1]))
                yield from joined(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), len(rows) - cut
        if n:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        groups, codes, ids = (rows.column(k).to_numpy() for k in range(3))
        low = _met(codes.view("uint64"), groups, most, rows.column(3).to_numpy() if more == "known" else None)
        at = np.flatnonzero(np.bincount(low, minlength=len(low))[low] > 1)
        if len(at):
            at = at[np.lexsort((ids[at], low[at]))]
            yield from found(low[at], ids[at], rows.column(3).take(pa.array(at)))

    return parts.mapInArrow(search, schema)


def _first_links(nodes: DataFrame, similarity: float, tile: int, crowded: DataFrame) -> DataFrame:
    """Links that connect exactly what the first tables join and the sketches do not rule out.

    The rows of these few tables hold the sketches, so a task compares what its
    trees join and gives spanning links alone, however many tables join it.
    """
    most = _generous(similarity)

    def links(low: np.ndarray, ids: np.ndarray, sketches: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(b"".join(sketches.to_pylist()), "uint64").reshape(len(ids), -1)
        starts = np.flatnonzero(np.diff(low, prepend=-1))
        sizes = np.diff(np.r_[starts, len(ids)])
        first = np.repeat(starts, sizes)
        near = np.bitwise_count(bits ^ bits[first]).sum(axis=1, dtype="int32") <= most
        star = np.repeat(np.logical_and.reduceat(near, starts), sizes)
        a = np.flatnonzero(star & (first != np.arange(len(ids))))
        found = [(a, first[a])]
        for start, n in zip(starts[~star[starts]].tolist(), sizes[~star[starts]].tolist(), strict=True):
            found.append(tuple(start + side for side in _spanning(bits[start : start + n], most)))
        a, b = (ids[np.concatenate(side)] for side in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = nodes.select("sketch", "node", F.substring("sketch", 1, SKETCH // 8).alias("start"))
    return _met_by_table(rows, similarity, tile, True, crowded, links, "a bigint, b bigint")


def _candidates(nodes: DataFrame, similarity: float, tile: int, known: DataFrame | None = None, crowded: DataFrame | None = None) -> DataFrame:
    """Nodes by ``bucket``: those that the Gray-order index connects in one of its tables.

    ``nodes`` has the long fingerprint ``sketch`` and ``node``. With the ``known``
    components of ``_first_links``, the first tables are left out, and only nodes
    that another table connects with one of another component are in a bucket,
    so that a large group of near copies is not listed once a table. A bucket
    of the same nodes is kept once, however many tables have it.
    """

    def listed(low: np.ndarray, ids: np.ndarray, _: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        members = np.split(ids, np.flatnonzero(np.diff(low)) + 1)
        buckets = np.array([xxhash.xxh64_intdigest(m.tobytes()) for m in members], "uint64").view("int64")
        columns = [np.repeat(buckets, [len(m) for m in members]), ids]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "node"])

    if crowded is None:
        crowded = stored(_crowded(nodes, similarity, tile), "crowded")
    if known is None:
        rows = nodes.select("sketch", "node", F.col("node").alias("known"))
    else:
        known = known.withColumnRenamed("node", "k")
        rows = nodes.join(known, F.col("node") == F.col("k")).select("sketch", "node", "known")
    return _met_by_table(rows, similarity, tile, None if known is None else False, crowded, listed, "bucket bigint, node bigint").distinct()


def _loose_links(members: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links that span what the sketches of the nodes of a ``bucket`` do not rule out, but for what ``known`` connects."""
    most = _generous(similarity)
    parts = _dealt(members.select("bucket", "node", "sketch", "known"), "bucket", "node", tile)

    def links(held: list[tuple], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _spanning(bits, most, known=np.array([h[3] for h in held]))

    return parts.mapInArrow(lambda rows: _by_group(rows, links), "a bigint, b bigint")


def _loose(nodes: DataFrame, buckets: DataFrame, similarity: float, tile: int, known: DataFrame | None = None) -> DataFrame:
    """Links that connect exactly what the sketches of nodes of one ``bucket`` do not rule out.

    Near copies meet in most tables, so a few of the buckets connect nearly
    all of them; the others only add what is not connected by then. The
    ``known`` components of nodes, if given, are connected too.
    """
    if known is None:
        known = nodes.select("node", F.col("node").alias("known"))

    def links(chosen: DataFrame, known: DataFrame) -> DataFrame:
        """Links of the buckets that hold nodes of several known components."""
        known = known.select(F.col("node").alias("k"), "known")
        held = chosen.join(known, F.col("node") == F.col("k")).drop("k")
        open_ = held.groupBy("bucket").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high")
        held = held.join(open_.select(F.col("bucket").alias("o")), F.col("bucket") == F.col("o")).withColumnRenamed("node", "m")
        held = held.join(nodes.select("node", "sketch"), F.col("m") == F.col("node"))
        return stored(_loose_links(stored(held.select("bucket", "node", "sketch", "known"), "sketched"), similarity, tile), "loose")

    few = F.pmod("bucket", F.lit(16)) == 0
    def with_known(more: DataFrame) -> DataFrame:
        return known.where("node <> known").select(F.col("node").alias("a"), F.col("known").alias("b")).union(more)

    joined = with_known(links(buckets.where(few), known))
    known = stored(components(nodes.select("node"), joined).withColumnRenamed("component", "known"), "known")
    return with_known(links(buckets.where(~few), known))


def _true_links(texts: DataFrame, similarity: float, size: int, tile: int) -> DataFrame:
    """Links that span the nodes of one ``component`` whose sets of shingles have the similarity, by comparing them."""
    most = _generous(similarity)
    weight = F.lit(WEIGHT) + F.length("text")
    parts = _dealt(texts.select("component", "node", "sketch", "text"), "component", "node", tile * 2 * WEIGHT, weight)
    kept = T.StructType([f for f in parts.schema.fields if f.name != "text"] + [T.StructField("shingles", T.BinaryType())])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [_shingles(_word_hashes(t.as_py()), size).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], kept.names)

    def links(held: list[tuple], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(h[3], "uint64") for h in held]

        def alike(i: int, j: int) -> bool:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if not small or small / large < similarity:
                return False
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both / (small + large - both) >= similarity

        return _spanning(bits, most, alike)

    return parts.mapInArrow(lambda rows: _by_group(shingled(rows), links), "a bigint, b bigint")


def near_copy_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, tile: int = TILE) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key`` and ``group``, for groups of similar texts.

    Two texts are linked if the Jaccard similarity of their sets of
    ``size``-word shingles (64-bit hashes, ASCII letters in lower case) is
    ``similarity`` or more, which is computed from the sets. All candidates
    come from the Gray-order index: a long SimHash of the set is cut into
    tables of 64 bits, enough of them that a pair of exactly the similarity is
    linked in none with a chance of about one in a million, whatever was
    changed. The first 512 bits rule out candidates that are far apart, nine
    standard deviations beyond the similarity. Texts with equal sets are one
    node. Nulls, copies and empty tables as in ``simhash_groups``.
    """
    picked = docs.select(col(docs, "doc_id").alias("doc_id"), F.coalesce(col(docs, "text"), F.lit("")).alias("text"))
    picked = picked.withColumn("text_key", F.xxhash64("text"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [_sketched(t.as_py(), size, similarity) for t in batch.column(1)]
            digests, bits = (pa.array([f[k] for f in found], pa.binary()) for k in (1, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), digests, bits], ["doc_id", "text_key", "digest", "sketch"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    coded = stored(picked.mapInArrow(sketches, f"doc_id {kind}, text_key bigint, digest binary, sketch binary"), "sketches")
    # The sketch follows from the digest; one document stands for all with it.
    nodes = coded.groupBy("digest", "sketch")
    nodes = nodes.agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("one"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    crowded = stored(_crowded(nodes, similarity, tile), "crowded")
    first = components(nodes.select("node"), _first_links(nodes, similarity, tile, crowded))
    known = stored(first.withColumnRenamed("component", "known"), "known")
    buckets = stored(_candidates(nodes, similarity, tile, known, crowded), "buckets")
    nodes = nodes.withColumn("sketch", F.substring("sketch", 1, SKETCH // 8))
    loose = stored(_loose(nodes, buckets, similarity, tile, known), "loose")

    linked_nodes = components(nodes.select("node"), loose).select(F.col("node").alias("l"), "component")
    many = linked_nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component").alias("many"))
    wanted = nodes.join(linked_nodes, F.col("node") == F.col("l")).join(many, F.col("component") == F.col("many"))
    wanted = stored(wanted.select("component", "node", "sketch", F.col("one.doc_id").alias("i"), F.col("one.text_key").alias("k")), "wanted")
    texts = picked.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    texts = stored(texts.select("component", "node", "sketch", "text").dropDuplicates(["node"]), "texts")
    groups = components(nodes.select("node"), stored(_true_links(texts, similarity, size, tile), "links"))
    groups = groups.select(F.col("node").alias("g"), F.col("component").alias("group"))
    named = nodes.join(groups, F.col("node") == F.col("g")).select(F.col("digest").alias("d"), "group")
    return coded.join(named, F.col("digest") == F.col("d")).select("doc_id", "text_key", "group")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each group of ``near_copy_groups``: the smallest id.

    Of rows that share it the text with the smallest hash stays, and one of
    equal rows. A null id stays only in a group without any other. All columns
    stay, whatever their names.
    """
    groups = near_copy_groups(docs, similarity, size)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    kept = groups.groupBy("group").agg(F.min(first).alias("kept"))
    kept = kept.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_key").alias("kept_key"))
    plain = docs.select(col(docs, "doc_id").alias("id"), F.xxhash64(F.coalesce(col(docs, "text"), F.lit(""))).alias("key"), *(col(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    rows = plain.join(kept, same, "left_semi").dropDuplicates(["id", "key"])
    return rows.drop("id", "key").toDF(*docs.columns)
