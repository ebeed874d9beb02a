"""SimHash fingerprints of texts, and components of near-equal ones.

A bit of a 64-bit fingerprint is 1 if it is set in over half the XXH64 hashes of the
text's shingles, repeats included. Fingerprints that differ in at most ``BITS`` (2)
bits link.

1. One pass writes (id, fingerprint); equal fingerprints are one node from here on.
2. Every fingerprint has eight positional bytes. Two bits spoil at most two bytes, so
   linked fingerprints share at least six, the guaranteed minimum. The inverted
   index posts a fingerprint under bytes by their positions. One byte alone would
   be shared with a 256th of all rows, so postings are kept under four positional
   bytes at once: of the four pairs of neighbouring bytes at least two are whole,
   which makes six postings a fingerprint.
3. Fingerprints that meet in a posting list tally their shared positional bytes; pairs
   with fewer than six go, the others are verified by their differing bits.
4. A list of over ``LONG`` fingerprints is posted again under two of its other four
   bytes (a pair with six shared bytes has two of them, whichever they are). Such a
   list has six bytes in common, so at most 65,536 members; where it is long still,
   each member looks for the 136 values of its two free bytes that are one or two
   bits away, so no list costs its square.

Links leave a task as a forest of stars over what it met, never as all pairs, and
components() joins them up. Nothing gathers on the driver.

Defined cases: null, empty and blank texts have fingerprint 0, linked like any other;
fewer words than a shingle's are one shingle; rows of one id are rows of their own;
a component's id is its smallest document id, null only if all are; an empty table
gives no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import components, forest
from thicket.llm.kernels import map_rows, texts_of
from thicket.llm.ngram_join import groups_of
from thicket.llm.word_runs import pieces
from thicket.storage import Scratch, small

BITS, BYTES = 2, 8
#: Positional bytes that linked fingerprints share at least.
SHARED = BYTES - BITS
SEED = 42
#: Posting lists of up to so many fingerprints are held against each other as they are.
LONG = 2048
#: Lists of up to so many long postings are broadcast.
MOST_KEYS = 1_000_000
#: Pairs that a task holds before it thins them.
PAIRS = 1 << 20
#: What 16 free bits differ by, if by one or two bits.
FLIPS = np.array([sum(1 << b for b in bits) for n in (1, 2) for bits in combinations(range(16), n)], np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, a megabyte of it at a time; A-Z count as a-z."""
    held: list[bytes] = []
    whole = True
    for piece in pieces(text):
        held += piece.lower().split()
        if len(held) >= words:
            ends = np.cumsum([len(w) + 1 for w in held])
            starts = np.concatenate([[0], ends[:-words]]).tolist()
            joined = b" ".join(held)
            yield np.fromiter([_hash(joined[a:b]) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64, len(starts))
            held, whole = held[len(held) - words + 1 :], False
    if whole and held:
        yield np.array([_hash(b" ".join(held))], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of a text, 0 of one without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words):
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp of each document; fp is the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([fingerprint(t.encode(), words) for t in texts_of(batch, text_col)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, fp long")


def byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(0xFF).cast("long"))


def key_of(fp: Column, positions: tuple[int, ...]) -> Column:
    """A long that holds the bytes at up to six positions."""
    return sum((byte(fp, p) * F.lit(1 << (8 * i)) for i, p in enumerate(positions)), F.lit(0).cast("long"))


def postings(nodes: DataFrame) -> DataFrame:
    """list, key, fp: each fingerprint under the six choices of two of its four pairs of bytes."""
    lists = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(BYTES // 2), 2)]
    under = F.array(*[F.struct(F.lit(i).alias("list"), key_of(F.col("fp"), p).alias("key")) for i, p in enumerate(lists)])
    return nodes.select("fp", F.explode(under).alias("at")).select("at.list", "at.key", "fp")


def finer(posts: DataFrame) -> DataFrame:
    """list, key, fp of long lists under two more of their bytes; key has the list's bytes first."""
    lists = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(BYTES // 2), 2)]
    rest = [[pair for pair in combinations([p for p in range(BYTES) if p not in own], SHARED - 4)] for own in lists]

    def under(own: int) -> Column:
        return F.array(*[F.struct(F.lit(len(lists) + own * len(rest[own]) + i).alias("list"), (F.col("key") + key_of(F.col("fp"), pair) * F.lit(1 << 32)).alias("key")) for i, pair in enumerate(rest[own])])

    chosen = F.coalesce(*[F.when(F.col("list") == i, under(i)) for i in range(len(lists))])
    return posts.select("fp", F.explode(chosen).alias("at")).select("at.list", "at.key", "fp")


def verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs share SHARED positional bytes at least and then differ in BITS bits at most."""
    apart = x ^ y
    shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = np.zeros(len(x), bool)
    kept = np.flatnonzero(shared >= SHARED)
    out[kept] = np.bitwise_count(apart[kept]) <= BITS
    return out


def met(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that link, of lists of up to LONG rows: row by row with those after it."""
    left = np.repeat(starts + sizes, sizes) - np.arange(len(fps)) - 1
    left[np.repeat(sizes > LONG, sizes)] = 0
    at, step = np.flatnonzero(left > 0), 1
    while len(at):
        good = at[verified(fps[at], fps[at + step])]
        yield fps[good], fps[good + step]
        step += 1
        at = at[left[at] >= step]


def probed(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that link, of one long list with six bytes in common: members that have a value one or two bits away."""
    there = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [p for p in range(BYTES) if there >> (8 * p) & 0xFF]
    free = (free + [p for p in range(BYTES) if p not in free])[:2]
    own = sum(((fps >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << (8 * i) for i, p in enumerate(free))
    at = np.full(1 << 16, -1, np.int64)
    at[own] = np.arange(len(fps))
    for flip in FLIPS:
        other = at[own ^ flip]
        good = np.flatnonzero(other > np.arange(len(fps)))
        yield fps[good], fps[other[good]]


def links(posts: DataFrame) -> DataFrame:
    """u, v: a forest of the links that posting lists tell."""

    def told(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x, y in pairs:
            if len(x):
                held.append((x.view(np.int64), y.view(np.int64)))
                n += len(x)
            if n > PAIRS:
                u, v = forest(*(np.concatenate(c) for c in zip(*held)))
                held, n = [(u, v)], 0
        if held:
            u, v = forest(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1 << 62):
            keys, fps = (group.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = np.ascontiguousarray(fps).view(np.uint64)
            starts = np.flatnonzero(np.append(True, np.diff(keys) != 0))
            sizes = np.diff(np.append(starts, len(keys)))
            yield from told(met(fps, starts, sizes))
            for k in np.flatnonzero(sizes > LONG).tolist():
                yield from told(probed(fps[starts[k] : starts[k] + sizes[k]]))

    one = posts.select((F.col("key") * F.lit(64) + F.col("list")).alias("bucket"), "fp")
    return one.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "u long, v long")


def near(nodes: DataFrame, tables: Scratch) -> DataFrame:
    """node, component of the fingerprints (column fp, distinct) that link with another."""
    posts = postings(nodes)
    sizes = posts.groupBy("list", "key").count().where(F.col("count") > LONG).select("list", "key")
    hot = small(tables.written(sizes, "long-postings"), MOST_KEYS)
    found = links(posts.join(hot, ["list", "key"], "left_anti")).union(links(finer(posts.join(hot, ["list", "key"], "left_semi"))))
    return components(found)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    tables, kept = Scratch(), Scratch()
    rows = kept.written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = tables.written(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "fingerprint-classes")
    found = near(classes.select("fp"), tables)
    labelled = kept.written(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("component", "fp").alias("component")), "components")
    tables.clear()
    lowest = labelled.groupBy("component").agg(F.min("own").alias("component_id"))
    named = labelled.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
