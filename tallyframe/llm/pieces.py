"""Encoding into the pieces of a SentencePiece model with the N best segmentations, and decoding.

A text is a lattice of pieces. No piece of such a model runs from a letter into
the next word, so the lattice falls into words, which are solved one by one and
kept. Of each distinct word the forward Viterbi scores give the best
segmentation and, with the backward ones, how much worse the second best is.
The words whose second best costs least are searched further: a backward A-star
from the end of the word, for which the forward scores are the exact remaining
cost, gives their segmentations in order.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import col

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words that a task keeps at a time.
CACHE = 1_000_000
NONE = float("inf")


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Words from this length on are solved one by one.
LONG = 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)


def _mix(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * FACTOR
    return hashes + letters


class Pieces:
    """The pieces of a model, their scores, and the segmentations of words."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.ids = {self.text[i]: i for i in range(size) if not special[i]}
        self.score = [model.get_score(i) for i in range(size)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.bytes] = True
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        #: A character without a piece costs more than any piece; its bytes stand for it.
        self.unknown = min(self.score[i] for i in self.ids.values()) - 10.0
        self.longest: dict[str, int] = {}
        for piece in self.ids:
            if any(c == SPACE for c in piece.lstrip(SPACE)):
                raise ValueError("a piece runs across words")
            self.longest[piece[:2]] = max(self.longest.get(piece[:2], 0), len(piece))
        self.known: dict[str, tuple] = {}
        self.searched: dict[tuple, list] = {}
        self.tables = {n: self._table(n) for n in range(1, max(map(len, self.ids)) + 1)}
        self.score_of = np.array([*self.score, self.unknown])

    def _table(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All beginnings of this length of pieces, by hash: hashes, letters, and the id where it is a piece."""
        found = sorted({p[:length] for p in self.ids if len(p) >= length})
        letters = _letters(found, length)
        hashes = letters[:, 0].astype("uint64")
        for k in range(1, length):
            hashes = _mix(hashes, letters[:, k])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], letters[order], np.array([self.ids.get(p, -1) for p in found], "int64")[order]

    def edges(self, word: str) -> list[list[tuple]]:
        """For each end in the word the pieces that stop there: start, score, ids."""
        n = len(word)
        ends: list[list[tuple]] = [[] for _ in range(n + 1)]
        ids, score = self.ids, self.score
        for i in range(n):
            one = ids.get(word[i])
            if one is None:
                ends[i + 1].append((i, self.unknown, tuple(self.bytes[b] for b in word[i].encode())))
            else:
                ends[i + 1].append((i, score[one], (one,)))
            for j in range(i + 2, min(n, i + self.longest.get(word[i : i + 2], 0)) + 1):
                found = ids.get(word[i:j])
                if found is not None:
                    ends[j].append((i, score[found], (found,)))
        return ends

    @staticmethod
    def forward(ends: list[list[tuple]]) -> list[float]:
        """The score of the best way to each place."""
        best = [0.0] * len(ends)
        for j in range(1, len(ends)):
            best[j] = max([best[i] + s for i, s, _ in ends[j]])
        return best

    def solve(self, word: str) -> tuple[tuple, float, float]:
        """Ids and score of the best segmentation, and what the second best loses (infinite if none).

        A segmentation other than the best has a piece outside it, so the best
        one through any such piece is the second best.
        """
        ends = self.edges(word)
        best = self.forward(ends)
        n = len(word)
        back = [-NONE] * (n + 1)
        back[n] = 0.0
        second, j, path, on_path = -NONE, n, [], {}
        while j:
            step = min((e for e in ends[j] if best[e[0]] + e[1] == best[j]), key=lambda e: e[0])
            path.append(step[2])
            on_path[j] = step[0]
            j = step[0]
        for j in range(n, 0, -1):
            for i, s, _ in ends[j]:
                rest = s + back[j]
                if rest > back[i]:
                    back[i] = rest
                if on_path.get(j) != i and best[i] + rest > second:
                    second = best[i] + rest
        return tuple(chain.from_iterable(reversed(path))), best[n], best[n] - second

    def solve_many(self, words: list[str]) -> list[tuple[tuple, float, float]]:
        """``solve`` for words of one length at once."""
        n, rows = len(words[0]), len(words)
        letters = _letters(words, n)
        lengths = [k for k in sorted(self.tables, reverse=True) if k <= n]
        score: dict[tuple, np.ndarray] = {}
        piece: dict[tuple, np.ndarray] = {}
        for i in range(n):
            going, hashes = np.arange(rows), letters[:, i].astype("uint64")
            for k in range(1, min(lengths[0], n - i) + 1):
                if k > 1:
                    hashes = _mix(hashes, letters[going, i + k - 1])
                table, spelled, ids = self.tables[k]
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                same = table[at] == hashes
                same[same] = (spelled[at[same]] == letters[going[same], i : i + k]).all(axis=1)
                going, hashes = going[same], hashes[same]
                found = ids[at[same]]
                hit = found >= 0
                if k == 1 or hit.any():
                    piece[i, k] = np.full(rows, -1)
                    piece[i, k][going[hit]] = found[hit]
                    score[i, k] = np.full(rows, self.unknown if k == 1 else -NONE)
                    score[i, k][going[hit]] = self.score_of[found[hit]]
                if not len(going):
                    break
        best, back = np.full((n + 1, rows), -NONE), np.full((n + 1, rows), -NONE)
        taken = np.zeros((n + 1, rows), "int64")
        best[0], back[n] = 0.0, 0.0
        for j in range(1, n + 1):
            for k in lengths:  # the longest first, so that it wins ties
                if (j - k, k) in score:
                    way = best[j - k] + score[j - k, k]
                    better = way > best[j]
                    best[j][better], taken[j][better] = way[better], k
        place = np.full(rows, n)
        for j in range(n, 0, -1):
            here = place == j
            taken[j][~here] = 0
            place = np.where(here, j - taken[j], place)
        second = np.full(rows, -NONE)
        chosen = np.zeros((n + 1, rows), "int64")
        for j in range(n, 0, -1):
            for k in lengths:
                if (j - k, k) in score:
                    rest = score[j - k, k] + back[j]
                    np.maximum(back[j - k], rest, out=back[j - k])
                    on = taken[j] == k
                    chosen[j][on] = piece[j - k, k][on]
                    np.maximum(second, np.where(on, -NONE, best[j - k] + rest), out=second)
        which, ends = np.nonzero(taken.T)
        flat = chosen[ends, which].tolist()
        cuts = np.searchsorted(which, np.arange(rows + 1)).tolist()
        total, loss = best[n].tolist(), (best[n] - second).tolist()
        solved = []
        for r, word in enumerate(words):
            ids = flat[cuts[r] : cuts[r + 1]]
            if -1 in ids:
                places = ends[cuts[r] : cuts[r + 1]].tolist()
                parts = [(i,) if i >= 0 else tuple(self.bytes[b] for b in word[e - 1].encode()) for i, e in zip(ids, places, strict=True)]
                ids = chain.from_iterable(parts)
            solved.append((tuple(ids), total[r], loss[r]))
        return solved

    def learn(self, words: set[str]) -> None:
        """Solve the words not yet known, those of one length together."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for word in words - self.known.keys():
            by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                full = [SPACE + w for w in part]
                self.known.update(zip(part, self.solve_many(full) if length < LONG else map(self.solve, full), strict=True))

    def nbest(self, word: str, most: int) -> list[tuple[float, tuple]]:
        """The ``most`` best segmentations by backward A-star; each is found in its turn.

        Of equal scores the newest way goes first, so ties are followed to the
        end one after the other and never side by side.
        """
        ends = self.edges(word)
        best = self.forward(ends)
        agenda = [(-best[-1], 0, len(word), 0.0, None)]
        made, found = 1, []
        while agenda and len(found) < most:
            total, _, place, done, path = heapq.heappop(agenda)
            if place == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((-total, tuple(ids)))
                continue
            for i, s, ids in ends[place]:
                heapq.heappush(agenda, (-(best[i] + s + done), -made, i, s + done, (ids, path)))
                made += 1
        return found

    def _options(self, word: str, most: int) -> list[tuple[float, tuple]]:
        found = self.searched.get((word, most))
        if found is None:
            if len(self.searched) >= CACHE // 10:
                self.searched.clear()
            found = self.searched[word, most] = self.nbest(SPACE + word, most)
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the space mark that it begins with."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, text: str, most: int = 1) -> list[tuple[float, np.ndarray]]:
        """The ``most`` best segmentations of a whole text: score and ids, best first.

        A segmentation among them changes only words whose second best is among
        the ``most - 1`` cheapest, because each cheaper change alone would
        already be a better one. Of equal ones the earlier word counts first.
        """
        words = self.words(text)
        if not words:
            return [(0.0, np.zeros(0, "int32"))]
        try:
            solved = list(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            solved = list(map(self.known.__getitem__, words))
        own, scores, losses = zip(*solved, strict=True)
        ids = np.fromiter(chain.from_iterable(own), "int32")
        score = sum(scores)
        found = [(score, ids)]
        if most == 1:
            return found
        losses = np.array(losses)
        if len(losses) >= most:
            near = np.flatnonzero(losses <= np.partition(losses, most - 2)[most - 2])
        else:
            near = np.arange(len(losses))
        near = near[np.argsort(losses[near], kind="stable")][: most - 1]
        cheap = [k for k in near.tolist() if losses[k] < NONE]
        if not cheap:
            return found
        starts = np.concatenate([[0], np.cumsum(list(map(len, own)))])
        options = [self._options(words[k], most) for k in cheap]
        agenda, made = [(0.0, (0,) * len(cheap), 0)], []
        while agenda and len(made) < most:
            loss, ranks, last = heapq.heappop(agenda)
            made.append((loss, ranks))
            for c in range(last, len(cheap)):
                if ranks[c] + 1 < len(options[c]):
                    step = options[c][ranks[c]][0] - options[c][ranks[c] + 1][0]
                    heapq.heappush(agenda, (loss + step, (*ranks[:c], ranks[c] + 1, *ranks[c + 1 :]), c))
        for loss, ranks in made[1:]:
            parts, at = [], 0
            for k, rank, option in sorted(zip(cheap, ranks, options, strict=True), key=lambda x: x[0]):
                if rank:
                    parts += [ids[at : starts[k]], np.array(option[rank][1], "int32")]
                    at = starts[k + 1]
            found.append((score - loss, np.concatenate([*parts, ids[at:]])))
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if self.is_byte[ids].any():
            parts = [bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in ids.tolist()]
            text = b"".join(parts).decode(errors="replace")
        else:
            text = "".join(map(self.text.__getitem__, ids.tolist()))
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode_pieces(
    docs: DataFrame, most: int = 4, model_file=public_model, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """One row per document: ``doc_id``, ``nbest`` and ``round_trip``.

    ``nbest`` lists up to ``most`` segmentations of the whole text, best
    first: ``score`` (the sum of the pieces' scores), ``n_ids``, ``ids_crc32``
    (of little-endian unsigned 32-bit ids) and, with ``keep_ids``, ``ids``.
    ``round_trip`` says whether decoding the best gives the text back, which
    fails only for texts that hold the model's space mark. A null or empty
    text has one segmentation without ids. Repeated rows give a row each;
    other columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(col(docs, id_col).alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    fields = [("score", pa.float64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []
    kind = "score: double, n_ids: bigint, ids_crc32: bigint" + (", ids: array<int>" if keep_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(model_file())
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows, back = [], []
                texts = part.column(1).to_pylist()
                model.learn({w for t in texts for w in model.words(t)})
                for text in texts:
                    found = model.encode(text, most)
                    rows.append([(s, len(i), zlib.crc32(i.astype("<u4").tobytes()), *([i] if keep_ids else [])) for s, i in found])
                    back.append(model.decode(found[0][1]) == text)
                named = [[dict(zip([f[0] for f in fields], r, strict=True)) for r in each] for each in rows]
                nbest = pa.array(named, pa.list_(pa.struct(fields)))
                yield pa.RecordBatch.from_arrays([part.column(0), nbest, pa.array(back)], ["doc_id", "nbest", "round_trip"])

    return picked.mapInArrow(encode, f"doc_id {id_type}, nbest array<struct<{kind}>>, round_trip boolean")


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", model_file=public_model) -> DataFrame:
    """All columns of ``encoded`` and the ``text`` of its ids; null ids give a null text."""
    names = [c for c in encoded.columns if c.lower() != "text"]
    at = names.index(ids_col)
    picked = encoded.select(*(col(encoded, c) for c in names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields) + ", text string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(model_file())
        for batch in batches:
            texts = [None if i is None else model.decode(np.array(i, "int64")) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return picked.mapInArrow(decode, schema)
