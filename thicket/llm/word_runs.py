"""Periodic runs of words within texts, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q, at least
``max(least, power * q)`` words long, that cannot be made longer with that period.

1. Words get numbers within their document, so they are compared as such.
2. Words of a run come in three-word grams that occur several times in the document
   (``power - 1`` times, or a little less for short periods); stretches of such
   grams hold every run whole, and only they are looked at further. Words of
   ordinary prose drop out here.
3. Each stretch is scanned right to left with a stack of suffixes, which gives the
   longest Lyndon word that begins at each word; once by the order of the numbers
   and once by the reverse one. Every run has a Lyndon root of its period among
   these. Suffixes are compared by their longest common extension: a few words
   directly, then a binary search over rolling hashes modulo 2^61 - 1.
4. A Lyndon word is extended to both sides at its own length as the period, again
   by common extensions, and the stretch found is held word by word against
   itself shifted by the period; where that fails it is found from the words alone.

A row is one document's work, linear in its words but for the logarithm of the
binary searches, and nothing is shuffled. Numbers are kept in arrays of 4 and 8
bytes a word, texts are cut a megabyte at a time.

Reported runs are always right, as they are held against the words; two different stretches with
one hash (2^-61 for each comparison) could hide one.

Defined cases: null and empty texts have no words and no runs, and an empty
collapsed text; repeated rows are looked at each for itself; an empty table gives
no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, count, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.kernels import GROUP_BYTES, WHITE, map_rows, spans, texts_of

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
#: So many words are compared one by one before hashes are.
DIRECT = 8


def pieces(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of about GROUP_BYTES."""
    at = 0
    while at < len(data):
        end = at + GROUP_BYTES
        while end < len(data) and not WHITE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def numbered_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number."""
    table: defaultdict[bytes, int] = defaultdict(count().__next__)
    found = [np.zeros(0, np.int32)]
    for piece in pieces(data):
        words = piece.split()
        found.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
    return np.concatenate(found), list(table)


def stretches(ids: np.ndarray, least: int, power: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of words that hold every run whole."""
    shortest, often = max(least, power), min(power - 1, max(least, power) - 2)
    if len(ids) < shortest:
        return []
    if often < 2 or shortest < 3:
        return [(0, len(ids))]
    # Each word of a run comes at least `power` times; that alone rules most texts out.
    starts, ends = spans(np.bincount(ids)[ids] >= power)
    if not (ends - starts >= shortest).any():
        return []
    wide = ids.astype(np.int64)
    pairs = np.unique(wide[:-1] * (int(wide.max()) + 1) + wide[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * (int(wide.max()) + 1) + wide[2:], return_inverse=True, return_counts=True)
    starts, ends = spans(n[at] >= often)
    long = ends - starts >= shortest - 2
    return list(zip(starts[long].tolist(), (ends[long] + 2).tolist()))


class Stretch:
    """Words with their rolling hashes, for common extensions."""

    def __init__(self, words: np.ndarray) -> None:
        self.array, self.words, self.n = words, array("q", words.astype(np.int64).tobytes()), len(words)
        self.hashes = array("q", accumulate(self.words, lambda h, w: (h * BASE + w + 1) % PRIME, initial=0))
        self.powers = array("q", accumulate(repeat(BASE, self.n), lambda h, b: h * b % PRIME, initial=1))

    def same(self, i: int, j: int, size: int) -> bool:
        """Whether the words from i and from j on have one hash over size words."""
        h = self.hashes
        return ((h[j] - h[i]) * self.powers[size] + h[i + size] - h[j + size]) % PRIME == 0

    def ahead(self, i: int, j: int) -> int:
        """How many words from i < j on are the same."""
        words, most, n = self.words, self.n - j, 0
        while n < most and words[i + n] == words[j + n]:
            n += 1
            if n == DIRECT:
                return self._searched(most, lambda a, b: self.same(i + a, j + a, b - a))
        return n

    def back(self, i: int, j: int) -> int:
        """How many words before i < j are the same."""
        words, n = self.words, 0
        while n < i and words[i - 1 - n] == words[j - 1 - n]:
            n += 1
            if n == DIRECT:
                return self._searched(i, lambda a, b: self.same(i - b, j - b, b - a))
        return n

    @staticmethod
    def _searched(most: int, same: Callable[[int, int], bool]) -> int:
        """The largest n up to most with same(DIRECT, n), by doubling and halving."""
        if same(DIRECT, most):
            return most
        low, step = DIRECT, DIRECT
        while low + step <= most and same(low, low + step):
            low, step = low + step, 2 * step
        high = min(most + 1, low + step)  # same() fails there
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if same(low, mid) else (low, mid)
        return low

    def lyndon(self, sign: int) -> array:
        """Where the longest Lyndon word that begins at each word ends; sign -1 turns the order of words around."""
        words, n, stack = self.words, self.n, []
        out = array("q", bytes(8 * n))
        for i in range(n - 1, -1, -1):
            own = words[i]
            while stack:
                j = stack[-1]
                other = words[j]
                if own == other:
                    same = self.ahead(i, j)
                    if j + same == n:  # the shorter suffix comes first
                        break
                    smaller = sign * words[i + same] < sign * words[j + same]
                else:
                    smaller = sign * own < sign * other
                if not smaller:
                    break
                stack.pop()
            out[i] = stack[-1] if stack else n
            stack.append(i)
        return out

    def repeats(self, i: int, q: int) -> tuple[int, int]:
        """The longest stretch around [i, i + q) with period q, from hashes and checked by the words."""
        start, end = i - self.back(i, i + q), i + q + self.ahead(i, i + q)
        w = self.array
        if (w[start : end - q] == w[start + q : end]).all() and (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == self.n or w[end] != w[end - q]):
            return start, end
        apart = np.flatnonzero(w[:-q] != w[q:])
        at = int(np.searchsorted(apart, i))
        before = int(apart[at - 1]) + 1 if at else 0
        return before, (int(apart[at]) if at < len(apart) else self.n - q) + q

    def runs(self, least: int, power: int) -> set[tuple[int, int, int]]:
        """(start, length, period) of each run."""
        found, words, n = set(), self.words, self.n
        for sign in (1, -1):
            ends, last = self.lyndon(sign), {}
            for i in range(n):
                q = ends[i] - i
                if power * q > n:
                    continue
                start, end = last.get(q, (0, 0))
                if start <= i and i + q <= end:
                    continue  # within the stretch that was found last
                if (i + q == n or words[i] != words[i + q]) and (i == 0 or words[i - 1] != words[i + q - 1]):
                    continue
                start, end = last[q] = self.repeats(i, q)
                if end - start >= max(least, power * q):
                    found.add((start, end - start, q))
        return found


def runs_of(ids: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a text's words, by start, then period."""
    found = [(start + s, length, q) for start, end in stretches(ids, least, power) for s, length, q in Stretch(ids[start:end]).runs(least, power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are in no run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def text_of(ids: np.ndarray, names: list[bytes]) -> str:
    """The words of numbers, joined by spaces."""
    return b" ".join(map(names.__getitem__, memoryview(np.ascontiguousarray(ids)))).decode()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, power: int = 4, alter: Callable[[object, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_words, runs, collapsed of each document.

    runs lists (start, length, period) by start, then period, in numbers of words from 0; collapsed is the text
    without the words that repeat a run's first period. alter(id, numbers of words) may change the words of a
    document before they are looked at; it gets and gives numbers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(batch.schema.get_field_index(id_col))
        sizes, found, texts = [], [], []
        for key, text in zip(keys, texts_of(batch, text_col)):
            ids, names = numbered_words(text.encode())
            ids = alter(key.as_py(), ids) if alter else ids
            own = runs_of(ids, least, power)
            sizes.append(len(ids))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            texts.append(text_of(ids[kept_words(len(ids), own)] if own else ids, names))
        yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(found, pa.list_(run)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(key: object, ids: np.ndarray) -> np.ndarray:
    """The words of one document in ten made periodic from a word on, by a checksum of its id; rows without id stay."""
    h = crc32(str(key).encode())
    if key is None or h % 10 or not len(ids):
        return ids
    n, g = len(ids), h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return np.concatenate([ids[:at], np.resize(ids[at : at + period], n - at)])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of find()'s rows; the four tell the run of greatest exponent, ties by start and period."""

    def line(r: Column) -> Column:
        return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
