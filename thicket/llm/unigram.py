"""Unigram encoding and decoding of SentencePiece pieces.

A text is cut into the pieces whose log scores sum highest (Viterbi). Pieces
live in a double-array trie over UTF-8 bytes: from node ``s`` byte ``c`` leads to
``base[s] + c`` if ``check`` there is ``s``. A character that no piece covers alone
may stand as unknown, at the lowest score less ``PENALTY``, and falls back to its
bytes' pieces. Spaces are written as the marker ``▁`` and each text that isn't
empty gets one in front; decoding turns markers into spaces and drops that one.

No piece reaches over the start of a word or a line feed (checked), so a text's
best path is that of its words in turn. New words of a batch go through the
trie side by side, position by position, in numpy; a worker keeps the ids of
words it has seen, in a cache of bounded size. Nothing is shuffled.

Model files with merge ranks for scores (BPE) have no log scores; theirs are
taken from the rank by Zipf's law: ``-ln(1 + rank)``.

Defined cases: a null text is the empty one, without ids; a marker that stands
in the text itself comes back as a space, as in the library, and ``restored`` says
so; ties go to the path whose last piece begins first; repeated rows stay; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thicket.llm.kernels import UnitCache, forget, gathered, kept, map_rows, per_row, texts_of
from thicket.llm.token_counts import pretokens

PENALTY = 10.0
MARK = "▁"
#: Words of up to so many bytes are solved side by side; longer ones each alone.
WIDE = 256


@dataclass
class Trie:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: list[bytes], values: list[int]) -> Trie:
        """A double array for distinct keys, none empty."""
        order = sorted(range(len(keys)), key=keys.__getitem__)
        base, check, value = (np.full(1 << 16, fill, np.int32) for fill in (0, -1, -1))
        check[0] = 0
        free, hints = 1, {}
        work = [(0, 0, len(order), 0)]
        while work:
            node, lo, hi, depth = work.pop()
            if lo < hi and len(keys[order[lo]]) == depth:
                value[node] = values[order[lo]]
                lo += 1
            children, at = [], lo
            while at < hi:
                byte, end = keys[order[at]][depth], at + 1
                while end < hi and keys[order[end]][depth] == byte:
                    end += 1
                children.append((byte, at, end))
                at = end
            if not children:
                continue
            while check[free] >= 0:
                free += 1
            # The first offset from there on at which all children find room, a window of offsets at a time.
            # Nodes with as many children begin where the last of them found it.
            codes = np.array([c for c, _, _ in children])
            offset = max(1, free - children[0][0], hints.get(len(children), 0))
            while True:
                if offset + 2048 > len(check):
                    base, check, value = (np.concatenate([a, np.full(len(a), fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                fits = (check[np.arange(offset, offset + 512)[:, None] + codes] < 0).all(axis=1)
                if fits.any():
                    offset += int(fits.argmax())
                    break
                offset += 512
            base[node] = hints[len(children)] = offset
            check[offset + codes] = node
            work += [(offset + byte, a, b, depth + 1) for byte, a, b in children]
        return cls(base, check, value)

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The nodes that the bytes lead to, -1 where there is none."""
        to = self.base[nodes] + data
        return np.where(self.check[to] == nodes, to, -1)


class Vocabulary:
    """Pieces with log scores, in a trie, and the ids of the 256 byte pieces (-1 if there is none)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], ids: list[int] | None = None, unknown: int = 0) -> None:
        for piece in pieces:
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError(f"pieces reach across words: {piece!r}")
        ids = list(range(len(pieces))) if ids is None else ids
        self.data = [p.replace(MARK, " ").encode() for p in pieces]
        self.trie = Trie.of(self.data, ids)
        self.scores = np.zeros(max([*ids, *byte_ids, unknown]) + 1)
        self.scores[ids] = scores
        self.unknown_score = min(scores) - PENALTY
        self.byte_ids, self.unknown = np.array(byte_ids, np.int32), unknown
        self.fallback = min(byte_ids) >= 0
        self.longest = max(map(len, self.data))
        texts = [b""] * len(self.scores)
        texts[unknown] = " ⁇ ".encode()
        for i, d in zip(ids, self.data):
            texts[i] = d
        if self.fallback:
            for byte, i in enumerate(byte_ids):
                texts[i] = bytes([byte])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_ids, ids = [-1] * 256, []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids.append(i)
        scores = [model.get_score(i) for i in ids]
        if all(s <= 0 and s == int(s) for s in scores):
            scores = [-float(np.log1p(-s)) for s in scores]
        return cls([model.id_to_piece(i) for i in ids], scores, byte_ids, ids, model.unk_id())

    def solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and their number for each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        found: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        at = 0
        while at < len(order):
            if sizes[order[at]] > WIDE:
                ids, n = self._alone(words[order[at]])
                end = at + 1
            else:
                width = max(8, int(sizes[order[at]]) * 3 // 2)
                end = min(int(np.searchsorted(sizes[order], width, side="right")), at + (1 << 20) // width)
                end = max(end, at + 1)
                ids, n = self._together([words[i] for i in order[at:end]])
            found.append(ids)
            counts[order[at:end]] = n
            at = end
        joined = np.concatenate(found) if found else np.zeros(0, np.int32)
        by_order = counts[order]
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(by_order) - by_order
        return gathered(joined, starts, counts), counts

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max())
        grid = np.zeros((width + 1, len(words)), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        grid[row, np.repeat(np.arange(len(words)), n)] = flat
        best = np.full((width + 1, len(words)), -np.inf)
        best[0] = 0.0
        came, piece = np.zeros((width + 1, len(words)), np.int32), np.full((width + 1, len(words)), -1, np.int32)
        opens = (grid & 0xC0) != 0x80
        for i in range(width):
            who = np.flatnonzero((n > i) & opens[i] & (best[i] > -np.inf))
            if not len(who):
                continue
            lead = grid[i, who]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(words), bool)
            size = np.zeros(len(words), np.int64)
            size[who] = char
            live, nodes = who, np.zeros(len(who), np.int64)
            for step in range(min(self.longest, width - i)):
                inside = n[live] > i + step
                live, nodes = live[inside], nodes[inside]
                nodes = self.trie.step(nodes, grid[i + step, live].astype(np.int64))
                hit = nodes >= 0
                live, nodes = live[hit], nodes[hit]
                if not len(live):
                    break
                value = self.trie.value[nodes]
                ends = value >= 0
                self._better(best, came, piece, i, i + step + 1, live[ends], best[i, live[ends]] + self.scores[value[ends]], value[ends])
                single[live[ends & (size[live] == step + 1)]] = True
            for c in range(1, 5):
                alone = who[(char == c) & ~single[who]]
                if len(alone):
                    self._better(best, came, piece, i, min(i + c, width), alone, best[i, alone] + self.unknown_score, np.full(len(alone), -1, np.int32))
        # Back from the ends, all words at once; then forward order by (word, start).
        who, at = np.arange(len(words)), n.copy()
        taken = []
        while len(who):
            start, value = came[at, who], piece[at, who]
            taken.append((who, start, at, value))
            at, going = start.astype(np.int64), start > 0
            who, at = who[going], at[going]
        who, start, end, value = (np.concatenate(x) for x in zip(*taken))
        order = np.lexsort((start, who))
        return self._expanded(flat, (np.cumsum(n) - n)[who[order]], who[order], start[order], end[order], value[order], len(words))

    @staticmethod
    def _better(best: np.ndarray, came: np.ndarray, piece: np.ndarray, start: int, end: int, who: np.ndarray, score: np.ndarray, value: np.ndarray) -> None:
        win = score > best[end, who]
        who = who[win]
        best[end, who], came[end, who], piece[end, who] = score[win], start, value[win]

    def _alone(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores.tolist()
        n = len(word)
        best, came, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = word[i]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            node, at, single = 0, i, False
            while at < n:
                to = int(base[node]) + word[at]
                if check[to] != node:
                    break
                node, at = to, at + 1
                found = int(value[node])
                if found >= 0:
                    single |= at - i == size
                    score = best[i] + scores[found]
                    if score > best[at]:
                        best[at], came[at], piece[at] = score, i, found
            if not single and best[i] + self.unknown_score > best[i + size]:
                best[i + size], came[i + size], piece[i + size] = best[i] + self.unknown_score, i, -1
            i += size
        path, at = [], n
        while at:
            path.append((came[at], at, piece[at]))
            at = came[at]
        start, end, found = (np.array(x) for x in zip(*reversed(path)))
        zero = np.zeros(len(start), np.int64)
        return self._expanded(np.frombuffer(word, np.uint8), zero, zero, start, end, found, 1)

    def _expanded(self, flat: np.ndarray, origin: np.ndarray, who: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their bytes' pieces, or as the unknown piece where there are none."""
        size = np.where(value < 0, end - start, 1) if self.fallback else np.ones(len(value), np.int64)
        out = np.repeat(np.where(value < 0, self.unknown, value).astype(np.int32), size)
        if self.fallback:
            unknown = np.repeat(value < 0, size)
            out[unknown] = self.byte_ids[gathered(flat, (origin + start)[value < 0], (end - start)[value < 0].astype(np.int64))]
        return out, np.bincount(who, weights=size, minlength=words).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that lie one after another, counts[i] of them for text i."""
        data = gathered(self.bytes, self.starts[ids], self.lengths[ids])
        sizes = per_row(counts, self.lengths[ids])
        ends = np.cumsum(sizes)
        raw = data.tobytes()
        return [raw[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip((ends - sizes).tolist(), ends.tolist())]


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.cache = vocabulary, UnitCache(vocabulary.solve)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and their number for each."""
        joined, starts, ends, per_text = pretokens(texts)
        ids, lengths = self.cache.tokens(joined, starts, ends)
        return ids, per_row(per_text, lengths)


def encode(docs: DataFrame, vocabulary: Vocabulary | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, n_byte_pieces, restored of each document; restored: whether decoding its ids gave the text back."""
    vocabulary = Vocabulary.read(vocabulary) if isinstance(vocabulary, str) else vocabulary
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary
    id_type = docs.schema[id_col].dataType.simpleString()
    key = ("unigram", uuid.uuid4().hex)

    def fresh() -> Encoder:
        forget()  # what earlier stages have kept in this worker
        return Encoder(held.value)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = kept(key, fresh)
        own, texts = encoder.vocabulary, texts_of(batch, text_col)
        ids, n = encoder.encode(texts)
        back = own.decode(ids, n)
        is_byte = np.isin(ids, own.byte_ids) if own.fallback else np.zeros(len(ids), bool)
        ends = np.cumsum(n)
        plain = ids.astype("<u4")
        columns = [
            batch.column(batch.schema.get_field_index(id_col)),
            pa.array(n),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))),
            pa.array([zlib.crc32(plain[a:b]) for a, b in zip(ends - n, ends)], pa.int64()),
            pa.array(per_row(n, is_byte.astype(np.int64))),
            pa.array([a == b for a, b in zip(back, texts)]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ids_crc32", "n_byte_pieces", "restored"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, n_tokens long, ids array<int>, ids_crc32 long, n_byte_pieces long, restored boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary | str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; a null is no ids."""
    vocabulary = Vocabulary.read(vocabulary) if isinstance(vocabulary, str) else vocabulary
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
        texts = held.value.decode(np.concatenate(rows), np.array([len(r) for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_rows(encoded.select(id_col, ids_col), work, f"doc_id {id_type}, text string")
