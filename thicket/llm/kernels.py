"""Vectorised helpers that several operators use inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Work on a batch goes on in groups of rows of about so many bytes, so that memory stays bounded whatever the batch size.
GROUP_BYTES = 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, setup: Callable[[], None] | None = None) -> DataFrame:
    """df mapped batch by batch; large batches are sliced by the bytes they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            for part in sliced(batch):
                yield from work(part)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes each, or of one row."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def groups(sizes: Iterable[int], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


# Random 64-bit values for the bytes and an odd base: a polynomial hash over the words of a buffer.
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                table = np.full(max(n, GROUP_BYTES + 4096), base, dtype=np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads differences over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(flag.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[start:end]; equal strings, equal hashes."""
    up, down = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[buf] * up[: len(buf)], out=sums[1:])
        return mixed_bits((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, in order."""
    out: list[np.ndarray] = []
    for a, b in groups(map(len, texts)):
        if b - a == 1 and len(texts[a]) > 4 * GROUP_BYTES:
            out.append(_long_text(texts[a]))
            continue
        joined = np.frombuffer(b"\n".join(texts[a:b]), dtype=np.uint8)
        starts, ends = spans(~WHITE[joined])
        hashes = span_hashes(joined, starts, ends)
        bounds = np.cumsum([len(t) + 1 for t in texts[a:b]])
        out += np.split(hashes, np.searchsorted(starts, bounds[:-1]))
    return out


def _long_text(text: bytes) -> np.ndarray:
    """The same for one very long text, a few megabytes at a time, cut at white space."""
    buf, found, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(buf):
        end = min(len(buf), at + 2 * GROUP_BYTES)
        while end < len(buf) and not WHITE[buf[end]]:
            end += 1
        starts, ends = spans(~WHITE[buf[at:end]])
        found.append(span_hashes(buf[at:end], starts, ends))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start + length] of each, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


class Table:
    """Open-addressing hash table from 64-bit hashes to numbers from 0 on, in two arrays of a power of two."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        self.n = 0
        self._empty(max(4, (2 * len(hashes)).bit_length()))
        self.add(hashes, numbers)

    def _empty(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Adds distinct hashes that it does not have."""
        self.n += len(hashes)
        if 2 * self.n > len(self.keys):
            held = self.values >= 0
            keys, values = self.keys[held], self.values[held]
            self._empty((2 * self.n).bit_length() + 1)
            self._put(keys, values)
        self._put(hashes, numbers)

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        left, at = np.arange(len(hashes)), self._slot(hashes)
        while len(left):  # all that still look for a slot try theirs at once; one of those that meet in it stays
            free = left[self.values[at[left]] < 0]
            self.keys[at[free]] = hashes[free]
            self.values[at[free]] = numbers[free]
            left = left[(self.keys[at[left]] != hashes[left]) | (self.values[at[left]] != numbers[left])]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        at = self._slot(hashes)
        value = self.values[at]
        out = np.where(self.keys[at] == hashes, value, -1).astype(np.int64)
        left = np.flatnonzero((out < 0) & (value >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            value, hit = self.values[at[left]], self.keys[at[left]] == hashes[left]
            out[left[hit]] = value[hit]
            left = left[~hit & (value >= 0)]
        return out


class UnitCache:
    """What encode() gives for units of text, kept per worker by the units' hashes.

    encode(units) gives the ids of all given byte strings, one after another, and
    the number of ids of each. Past ``most`` units, or eight times as many ids, it
    starts anew, so that memory is bounded; a lost worker costs only its cache.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = Table(np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, 0
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def find(self, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Positions of the units joined[start:end] in self.starts and self.lengths, after encoding those that are new."""
        if self.n > self.most or self.used > 8 * self.most:
            self.clear()
        hashes = span_hashes(joined, starts, ends) if hashes is None else hashes
        at = self.table.get(hashes)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            data, first = joined.tobytes(), missed[first]
            ids, lengths = self.encode([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            end = self.n + len(new)
            self.ids = _room(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts, self.lengths = _room(self.starts, end), _room(self.lengths, end)
            self.lengths[self.n : end] = lengths
            self.starts[self.n : end] = self.used + np.cumsum(lengths) - lengths
            self.table.add(new, np.arange(self.n, end))
            at[missed] = self.n + back
            self.n, self.used = end, self.used + len(ids)
        return at

    def tokens(self, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.find(joined, starts, ends)
        lengths = self.lengths[at]
        return gathered(self.ids, self.starts[at], lengths), lengths


_kept: dict = {}
#: The C library's call that returns free memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make() gave for key in this worker process, over tasks. One of each kind (first of the key) is kept."""
    if key[0] not in _kept or _kept[key[0]][0] != key:
        _kept[key[0]] = (key, make())
    return _kept[key[0]][1]


def forget() -> None:
    """Drops what operators have kept in this worker process and gives free memory back to the system, as an idle worker lives on beside the next stage's."""
    _kept.clear()
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if len(a) >= n:
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of highest n of a written table, at most ``most``, as whole steps of an eighth of a doubling: a small histogram is all the driver sees before."""
    step, left, least = F.floor(8 * F.log2("n")), most, None
    for at, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if n > left:
            break
        least, left = at, left - n
    return counts.where(step >= least) if least is not None else counts.limit(0)


def per_row(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive lengths, counts[i] of them for row i."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a column, a null as the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
