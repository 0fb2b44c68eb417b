"""Packing of token sequences: vector best fit over tokens, documents and attention cost."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import col, sliced, stored

#: Pieces that one task packs, on average; what a group wastes is a sequence or two.
GROUP = 30_000
LONG = 100_000
LONG_RUN = re.compile(f"[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{LONG},}}")


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and how much each part counts in the choice of a sequence.

    ``attention`` bounds the sum of squared piece lengths, the cost of
    attention inside documents.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def byte_bpe(ranks_path: str, pattern: str, special: dict[str, int] | None = None):
    """An encoder for a byte-level vocabulary given as ranks; the file stays where it is.

    A text that holds a name in ``special`` has that id there.
    The pattern must take a run of white space as one piece, but for its last
    character where a word follows. Runs of ``LONG`` and more, on which the
    pattern's matcher would overflow, are cut out so beforehand.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    names = re.compile("|".join(f"({re.escape(n)})" for n in sorted(special or (), key=len, reverse=True)) or "(?!)")

    def encode(text: str) -> list[int]:
        if names.search(text) is None:
            return ordinary(text)
        ids, at = [], 0
        for found in names.finditer(text):
            ids += [*ordinary(text[at : found.start()]), special[found[0]]]
            at = found.end()
        return ids + ordinary(text[at:])

    def ordinary(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_RUN.finditer(text) if len(text) >= LONG else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += known.encode_ordinary(text[at : run.start()])
            ids += known._encode_single_piece(text[run.start() : end])
            at = end
        return ids + known.encode_ordinary(text[at:]) if at else known.encode_ordinary(text)

    return encode


def public_byte_bpe():
    """The public 50k byte-level vocabulary, in the form that encodes fastest.

    Its ids are those of ``byte_bpe_50k.json``, which the tests check on whole texts.
    """
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def tokenized_pieces(
    docs: DataFrame,
    encoder=public_byte_bpe,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    most: int = 1024,
    keep_ids: bool = True,
) -> DataFrame:
    """Token ids of whole texts, an end id added, cut into pieces of at most ``most`` ids.

    Only longer texts are cut, and the piece that is not full comes first. A
    null text is an empty one and gives a piece with the end id alone. Returns
    ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, unless
    ``keep_ids`` is off, ``ids``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(col(docs, id_col).alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<int>" if keep_ids else ""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in sliced(batches):
            which, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                n = len(ids)
                cuts = [0, *range(n % most or most, n, most), n]
                for k in range(len(cuts) - 1):
                    part = ids[cuts[k] : cuts[k + 1]]
                    which.append(row)
                    numbers.append(k)
                    starts.append(cuts[k])
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype("int32"))
            columns = [
                batch.column(0).take(pa.array(which, pa.int32())),
                pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return picked.mapInArrow(pieces, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest pieces first.

    Of the sequences that can take a piece under every capacity, it goes to
    the one whose residuals after it have the smallest weighted norm, each
    residual measured as a part of its capacity; ties go to the oldest. A
    sequence that cannot take even the shortest piece left is closed.
    """
    order = np.argsort(-lengths, kind="stable")
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype="float64")
    scale = np.array(capacity.weights) / limits**2
    sequence, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    free = np.empty((3, 1024))
    names = np.empty(1024, "int64")
    count, made = 0, 0
    shortest = lengths.min() if len(lengths) else 0
    least = np.array([shortest, 1.0, float(shortest) ** 2])
    for step, item in enumerate(order):
        need = np.array([lengths[item], 1.0, float(lengths[item]) ** 2])
        if np.any(need > limits):
            raise ValueError("a piece exceeds a capacity of an empty sequence")
        left = free[:, :count] - need[:, None]
        score = scale @ (left * left)
        score[(left < 0).any(axis=0)] = np.inf
        best = int(score.argmin()) if count else -1
        if best < 0 or np.isinf(score[best]):
            if count == free.shape[1]:
                free = np.concatenate([free, np.empty_like(free)], axis=1)
                names = np.concatenate([names, np.empty_like(names)])
            best, count = count, count + 1
            free[:, best], names[best] = limits, made
            made += 1
        sequence[item], offset[item] = names[best], capacity.tokens - free[0, best]
        free[:, best] -= need
        if step % 512 == 511:
            open_ = np.flatnonzero((free[:, :count] >= least[:, None]).all(axis=0))
            free[:, : len(open_)], names[: len(open_)] = free[:, open_], names[open_]
            count = len(open_)
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` in it.

    ``pieces`` has ``length`` and any other columns, which stay, whatever their
    names; those named like the two new ones are replaced. A piece that
    fills a sequence is one, without a shuffle. The others are dealt evenly
    over groups of about ``group`` rows, whatever their ids, and each group is
    packed by one task with memory for the group alone. No rows, no sequences.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    plain = pieces.select(*(col(pieces, c).alias(f"p{i}") for i, c in enumerate(names)))
    length = f"p{names.index('length')}"
    full = F.col(length) >= capacity.tokens
    rest = plain.where(~full)
    groups = max(1, -(-rest.count() // group))
    number = F.monotonically_increasing_id()
    alone = plain.where(full).select("*", (-1 - number).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(number), F.lit(groups)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_fit(pdf[length].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["_group"].to_numpy() * (1 << 32) + sequence
        pdf["offset"] = offset
        return pdf.drop(columns="_group")

    every = dealt.groupBy("_group").applyInPandas(packed, alone.schema).union(alone)
    return every.toDF(*names, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, capacity: Capacity = Capacity(), encoder=public_byte_bpe, keep_ids: bool = False, **columns: str
) -> DataFrame:
    """Tokenise whole documents and pack them; see ``tokenized_pieces`` and ``pack_pieces``.

    The pieces are stored before they are packed, so texts are encoded once
    and row numbers stay the same if a task runs again. Repeated rows and
    repeated or null ids are documents of their own. ``columns`` may name
    ``id_col`` and ``text_col``; other columns of the frame are not read.
    """
    pieces = tokenized_pieces(docs, encoder, most=capacity.tokens, keep_ids=keep_ids, **columns)
    return pack_pieces(stored(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: ``sequence_id``, ``ids``, and ``doc_ids`` and ``starts`` of its documents.

    Needs pieces with ``ids``. A sequence holds at most ``Capacity.documents`` pieces.
    """
    part = F.struct("offset", "doc_id", "ids")
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return parts.select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
