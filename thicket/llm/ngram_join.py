"""N-gram Jaccard join of texts, to components of linked documents.

A document's set is its distinct shingles of ``words`` words; two documents link
when ``100 * intersection >= threshold * union``. The join is exact:

1. One pass counts shingles that come twice or more within a task's chunk of
   documents; their sums over all chunks, the ``most_frequent`` highest, tell the
   frequent shingles. All sets are ordered by (that count, hash): rare first. Any
   common order gives right results; this one keeps frequent shingles out of
   prefixes.
2. One pass writes for each document its size, a 128-bit digest of its set, its
   prefix (the first ``n - ceil(threshold * n) + 1`` shingles, of which two linked
   sets share one) and a sketch: the parities of the set's counts in ``k`` ranges
   of hashes, k the next power of two from n on. Equal sets become one node.
3. Prefix rows meet by shingle, in order of set sizes; a row stays if the next
   smaller or larger set there passes the length filter, as then none else does.
   A frequent shingle's rows are dealt into blocks, so no task gets them all;
   some of them (``PIVOTS`` or so) go to every block.
4. Candidates: pairs of a bucket that pass the length, the positional and the
   suffix filter (where sketches differ bounds the sets' difference from below).
   Sets alone are never moved for that. Distinct pairs are verified once each
   on whole sets, which are cut again from the texts of documents in pairs alone.

A large group of near copies would have pairs by the square of its size, while
its component needs only a tree. So step 4 goes in turns. At first a bucket of up to
``FEW`` rows tells all its pairs, and a larger one for each row only its first
candidate among the bucket's common hubs and among its neighbours. ``TURNS`` such turns
follow each other, with other hubs and neighbours, for pairs that are not yet in one
component; then *all* pairs of the larger buckets are taken that are not yet in one. No
pair is lost, as a pair within a component needs no link; the rows of the
component that has most of a bucket meet the others only. Nothing gathers on the
driver but the frequent shingles (at most ``most_frequent`` numbers).

Defined cases: null texts and texts without words have the empty set and link
with nothing; fewer words than ``words`` are one shingle; rows with the same id
and different texts are nodes of their own; a component's id is its smallest
document id, null only if all are; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.components import components
from thicket.llm.kernels import Table, commonest, forget, map_rows, mixed_bits, sliced, texts_of, word_hashes
from thicket.storage import Scratch, small

#: Sketches have from LEAST_CELLS to MOST_CELLS parities, a power of two.
LEAST_CELLS, MOST_CELLS = 64, 1 << 13
CHUNK = 1 << 20
BLOCK = 1024
#: Rows of a frequent shingle that go to all of its blocks, about.
PIVOTS = 48
#: Buckets of up to so many rows tell all pairs at once; rows of larger ones are held against so many hubs and neighbours.
FEW, HUBS, NEAR = 4, 12, 12
#: Turns of hubs before all pairs are taken.
TURNS = 3
#: Tables of ids of up to so many rows are broadcast.
MOST_IDS = 1_000_000
_FACTORS = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; A-Z count as a-z."""
    out = []
    with np.errstate(over="ignore"):
        for own in word_hashes([t.encode().lower() for t in texts]):
            size = min(words, len(own))
            n = len(own) - size + 1 if size else 0
            mixed = np.full(n, size, np.uint64)
            for i in range(size):
                mixed += own[i : n + i] * _FACTORS[i]
            out.append(np.unique(mixed_bits(mixed)))
    return out


def needed(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Least intersection of linked sets of sizes n and m: the smallest i with 100 i >= threshold (n + m - i)."""
    return -(-threshold * (n + m) // (100 + threshold))


def frequent(docs: DataFrame, text_col: str, words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of frequent shingles; the counts leave out shingles that come once in a chunk, and repeats of a text there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0
        forget()

        def counted() -> pa.RecordBatch:
            shingles, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(shingles[twice].view(np.int64)), pa.array(n[twice])], ["h", "n"])

        for batch in batches:
            for part in sliced(batch):
                for own in shingle_sets(texts_of(part, text_col), words):
                    key = hashlib.blake2b(own, digest_size=8).digest()
                    if key in seen:
                        continue
                    seen.add(key)
                    held.append(own)
                    size += len(own)
                    if size >= CHUNK:
                        yield counted()
                        held, seen, size = [], set(), 0
        if held:
            yield counted()

    tables = Scratch()
    counts = tables.written(docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4"), "shingle-counts")
    top = commonest(counts, most).toPandas()
    tables.clear()
    return top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: int, most_frequent: int) -> DataFrame:
    """row, doc_id, n, s1, s2, sketch, prefix, often of each document; often has the counts of the prefix's shingles, 0 of those that are not frequent."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, words, most_frequent))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["row", "doc_id", "n", "s1", "s2", "sketch", "prefix", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        row = TaskContext.get().partitionId() << 33
        hashes, counts = held.value
        table = Table(hashes, np.arange(len(hashes)))
        for batch in batches:
            for part in sliced(batch):
                found = shingle_sets(texts_of(part, text_col), words)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in found), "<i8").reshape(-1, 2)
                joined = np.concatenate(found)
                at = table.get(joined)
                often = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
                prefixes, counted, sketches, end = [], [], [], 0
                for own in found:
                    n, end = len(own), end + len(own)
                    most = n - (threshold * n + 99) // 100 + 1 if n else 0
                    by = often[end - n : end]
                    first = np.argsort(by, kind="stable")[:most] if by.any() else slice(0, most)
                    prefixes.append(own[first])
                    counted.append(by[first])
                    sketches.append(sketch(own))
                offsets = pa.array(np.cumsum([0] + [len(p) for p in prefixes]).astype(np.int32))
                columns = [
                    pa.array(np.arange(row, row + len(found))),
                    part.column(part.schema.get_field_index(id_col)),
                    pa.array([len(s) for s in found], pa.int32()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array(sketches, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes).view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counted).astype(np.int32))),
                ]
                row += len(found)
                yield pa.RecordBatch.from_arrays(columns, names)
        forget()

    schema = f"row long, doc_id {id_type}, n int, s1 long, s2 long, sketch binary, prefix array<long>, often array<int>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of hashes in each of k cells, k from the set's size."""
    k = min(max(1 << max(len(own) - 1, 0).bit_length(), LEAST_CELLS), MOST_CELLS)
    return np.packbits(np.bincount((own & np.uint64(k - 1)).astype(np.int64), minlength=k).astype(np.uint8) & 1).tobytes()


class Rows:
    """Rows of buckets as columns, in the order of their buckets, with their sketches in matrices by length."""

    names = ("bucket", "row", "comp", "n", "pos", "side", "sketch")

    def __init__(self, batch: pa.RecordBatch) -> None:
        for name in self.names[:-1]:
            setattr(self, name, batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64))
        data = batch.column(batch.schema.get_field_index("sketch")).to_pylist()
        self.words = np.array([len(x) for x in data]) // 8
        self.at, self.own, self.folded = np.zeros(len(data), np.int64), {}, {}
        for k in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == k)
            self.at[rows] = np.arange(len(rows))
            self.own[k] = np.frombuffer(b"".join([data[i] for i in rows]), np.uint64).reshape(-1, k)
            if k > 1:  # cells are the low bits of hashes, so a sketch of half the cells is the sum of both halves
                self.folded[k] = self.own[k][:, : k // 2] ^ self.own[k][:, k // 2 :]

    def __len__(self) -> int:
        return len(self.row)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each bucket starts, and how many rows it has."""
        starts = np.flatnonzero(np.append(True, np.diff(self.bucket) != 0))
        return starts, np.diff(np.append(starts, len(self.bucket)))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many cells the sketches of rows i and j differ; 0 for sketches that are not of one length or of half another."""
        out = np.zeros(len(i), np.int64)
        a, b = self.words[i], self.words[j]
        i, j = np.where(a >= b, i, j), np.where(a >= b, j, i)
        a, b = np.maximum(a, b), np.minimum(a, b)
        for k in np.unique(a).tolist():
            for more, less in ((self.own, self.own[k]), (self.folded, self.own.get(k // 2))):
                if less is None or k not in more:
                    continue
                both = np.flatnonzero((a == k) & (b == less.shape[1]))
                step = max(1, (1 << 17) // less.shape[1])
                for x in range(0, len(both), step):
                    part = both[x : x + step]
                    out[part] = np.bitwise_count(more[k][self.at[i[part]]] ^ less[self.at[j[part]]]).sum(axis=1)
        return out

    def passing(self, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
        """Which of the pairs (i, j) are in two components and pass all filters."""
        out = np.zeros(len(i), bool)
        at = np.flatnonzero((self.comp[i] != self.comp[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0)))
        i, j = i[at], j[at]
        n, m, p, q = self.n[i], self.n[j], self.pos[i], self.pos[j]
        least = needed(n, m, threshold)
        keep = (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1) >= least)
        at, i, j, most = at[keep], i[keep], j[keep], (n + m - 2 * least)[keep]
        out[at[self.apart(i, j) <= most]] = True
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """a < b of the rows of pairs, each once."""
        a, b = self.row[i], self.row[j]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b"])


def groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no value of the first column, by which rows are sorted, is in two of them, but for values of over ``most`` rows."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        first, last = int(np.searchsorted(keys, keys[0], "right")), int(np.searchsorted(keys, keys[-1]))
        if waiting and waiting[-1].column(0)[-1].as_py() != keys[0]:
            yield joined(waiting)
            waiting = []
        if last:  # the value that waits ends within this batch
            yield joined([*waiting, batch.slice(0, first)])
            if last > first:
                yield batch.slice(first, last - first)
            waiting = [batch.slice(last)]
        else:
            waiting.append(batch)
        if sum(x.num_rows for x in waiting) > most:
            yield joined(waiting)
            waiting = []
    if waiting:
        yield joined(waiting)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def hub_pairs(rows: Rows, threshold: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of buckets, at most about two a row: all pairs of buckets of up to FEW rows; else each row with the first hub and the first neighbour that passes."""
    starts, size = rows.buckets()
    many = np.repeat(size > FEW, size)
    left = np.repeat(starts + size, size) - np.arange(len(rows)) - 1
    found_i, found_j = [], []
    at = np.flatnonzero(left > 0)
    for step in range(1, max(NEAR, FEW) + 1):
        at = at[left[at] >= step]
        if not len(at):
            break
        good = rows.passing(at, at + step, threshold)
        found_i.append(at[good])
        found_j.append(at[good] + step)
        at = at[~(good & many[at])]
    # Hubs are the rows of least hash, so that buckets of the same copies have them in common.
    large = np.flatnonzero(size > FEW)
    spread = mixed_bits(rows.row.astype(np.uint64) + (np.uint64(turn) << np.uint64(56)))
    bucket = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((spread, bucket))
    at, number = np.flatnonzero(many), np.full(len(size), -1)
    number[large] = starts[large]
    for nth in range(HUBS):
        at = at[size[bucket[at]] > nth]
        if not len(at):
            break
        hub = order[number[bucket[at]] + nth]
        other = hub != at
        good = np.zeros(len(at), bool)
        good[other] = rows.passing(at[other], hub[other], threshold)
        found_i.append(at[good])
        found_j.append(hub[good])
        at = at[~good]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def all_pairs(rows: Rows, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidates of buckets, by steps."""
    starts, size = rows.buckets()
    left = np.repeat(starts + size, size) - np.arange(len(rows)) - 1
    at, step = np.flatnonzero(left > 0), 1
    while len(at):
        good = rows.passing(at, at + step, threshold)
        yield at[good], at[good] + step
        step += 1
        at = at[left[at] >= step]


def paired(buckets: DataFrame, threshold: int, turn: int | None) -> DataFrame:
    """a, b of the pairs of rows in a bucket that may link: a few for each row in a turn of hubs, else every one."""
    every = turn is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1 << 62 if every else 8 * BLOCK):
            rows = Rows(group)
            if every:
                steps = list(all_pairs(rows, threshold))
                i, j = (np.concatenate([s[x] for s in steps]) if steps else np.zeros(0, np.int64) for x in (0, 1))
            else:
                i, j = hub_pairs(rows, threshold, turn)
            if len(i):
                yield rows.pairs(i, j)

    order = ["bucket", "comp" if every else F.xxhash64("row", F.lit(turn)) if turn else "n", "row"]
    return buckets.select(*Rows.names).repartition("bucket").sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def read_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The rows of wanted (doc_id, s1, s2, ...) with own, their sets; only texts of wanted documents are cut."""
    ids = small(wanted.select(F.col("doc_id").alias("\u0000id")).distinct(), MOST_IDS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("\u0000id")), "left_semi").select("id", "text")
    id_type = texts.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [s.tobytes() for s in shingle_sets(texts_of(batch, "text"), words)]
        digests = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in found), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(found, pa.binary())], ["id", "s1", "s2", "own"])

    own = map_rows(texts, work, f"id {id_type}, s1 long, s2 long, own binary").alias("o")
    w = small(wanted, MOST_IDS).alias("w")
    same = (F.col("o.s1") == F.col("w.s1")) & (F.col("o.s2") == F.col("w.s2")) & F.col("o.id").eqNullSafe(F.col("w.doc_id"))
    return own.join(w, same).select(*[F.col(f"w.{c}") for c in wanted.columns], "own")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, threshold: int, tables: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link. Texts are read of the documents in pairs alone."""
    rows = tables.written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "paired-rows")
    wanted = tables.written(nodes.join(small(rows, MOST_IDS), "row", "left_semi").select("row", "doc_id", "s1", "s2"), "wanted")
    own = tables.written(read_sets(docs, wanted, id_col, text_col, words).select("row", "own").dropDuplicates(["row"]), "wanted-sets")

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= threshold * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.select("a", "b").join(own.select(F.col("row").alias("a"), F.col("own").alias("x")), "a")
    both = left.join(own.select(F.col("row").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    links = tables.written(map_rows(both, verify, "a long, b long"), "links")
    tables.clear(rows, wanted, own)
    return links


def spread(nodes: DataFrame) -> DataFrame:
    """row, n, pos, shingle, often, block, own: a row for each shingle of a node's prefix; frequent shingles are dealt into blocks, and own tells a row's own block from those a pivot goes to besides."""
    rows = nodes.select("row", "n", F.posexplode(F.arrays_zip("prefix", "often")).alias("pos", "at")).select("row", "n", "pos", F.col("at.prefix").alias("shingle"), F.col("at.often").alias("often"))
    blocks = F.ceil(F.col("often") / BLOCK)
    mine = F.when(F.col("often") > BLOCK, F.pmod(F.xxhash64("row"), blocks)).otherwise(F.lit(0).cast("long"))
    pivot = (F.col("often") > BLOCK) & (F.pmod(F.xxhash64("row", "shingle"), F.col("often")) < PIVOTS)
    rows = rows.withColumn("mine", mine).withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array("mine"))))
    return rows.select("row", "n", "pos", "shingle", "often", "block", (F.col("mine") == F.col("block")).alias("own"))


def spanning(met: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met with comp, and size, most, comps, often by shingle of the buckets that have several components; those of up to FEW rows have told all pairs, unless they are dealt into blocks, and are left out."""
    rows = met.join(comps, F.col("row") == F.col("node"), "left").select("row", "n", "pos", "shingle", "often", "block", "own", F.coalesce("component", "row").alias("comp"))
    counts = rows.where("own").groupBy("shingle", "comp").agg(F.count("*").alias("n"), F.max("often").alias("often"))
    sizes = counts.groupBy("shingle").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps"), F.max("often").alias("often"))
    return rows, sizes.where("comps > 1").where((F.col("size") > FEW) | (F.col("often") > BLOCK))


def left_over(met: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of buckets of several components, dealt so that every pair in two components meets."""
    rows, sizes = spanning(met, comps)
    rows = rows.where("own")
    # A bucket over BLOCK is dealt twice: the component that has most of it by blocks against all others, and the others in pairs of blocks.
    dealt = F.when(F.col("size") <= BLOCK, 0).otherwise(F.ceil(F.col("most.n") / BLOCK))
    others = F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil((F.col("size") - F.col("most.n")) / BLOCK))
    rows = rows.join(sizes.select("shingle", dealt.alias("dealt"), others.alias("others"), F.col("most.comp").alias("main")), "shingle")
    zero, main = F.lit(0).cast("long"), (F.col("comp") == F.col("main")) & (F.col("dealt") > 0)
    mine = F.pmod(F.xxhash64("row", F.lit(2)), F.when(main, F.col("dealt")).otherwise(F.col("others")))

    def place(kind: int, low, high, side):
        return F.struct(F.lit(kind).alias("kind"), low.cast("long").alias("low"), high.cast("long").alias("high"), side.cast("int").alias("side"))

    against = F.transform(F.when(F.col("dealt") > 0, F.sequence(zero, F.col("dealt") - 1)).otherwise(F.array().cast("array<long>")), lambda b: place(1, b, b, F.lit(1)))
    among = F.transform(F.sequence(zero, F.col("others") - 1), lambda b: place(0, F.least(b, mine), F.greatest(b, mine), F.when(b == mine, -1).otherwise((mine > b).cast("int"))))
    places = F.when(main, F.array(place(1, mine, mine, F.lit(0)))).otherwise(F.concat(against, among))
    rows = rows.select("row", "n", "pos", "comp", "shingle", F.explode(places).alias("at"))
    return rows.select("row", "n", "pos", "comp", F.xxhash64("shingle", "at.kind", "at.low", "at.high").alias("bucket"), F.col("at.side").alias("side")).join(nodes.select("row", "sketch"), "row")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 85, most_frequent: int = 1 << 19) -> DataFrame:
    """doc_id, n_shingles, component_id, s1, s2 of each document; (s1, s2) is the digest of its set. threshold is in hundredths."""
    tables, kept = Scratch(), Scratch()
    table = kept.written(sets(docs, id_col, text_col, words, threshold, most_frequent), "shingle-sets")
    # One node for each set: WindowGroupLimit leaves one row of a set in each task before the shuffle.
    first = F.row_number().over(Window.partitionBy("s1", "s2").orderBy("row"))
    nodes = table.where("n > 0").select("row", "n", "s1", "s2", "prefix", "often").withColumn("first", first).where("first = 1")
    order = Window.partitionBy("shingle", "block").orderBy("n", "row")
    less, more = F.lag("n").over(order), F.lead("n").over(order)
    near = (100 * less >= threshold * F.col("n")) | (100 * F.col("n") >= threshold * more) | (F.col("often") > BLOCK)
    met = tables.written(spread(nodes).withColumn("near", near).where("near").select("row", "n", "pos", "shingle", "often", "block", "own"), "met")
    nodes = tables.written(table.select("row", "doc_id", "s1", "s2", "sketch").join(met.select("row").distinct(), "row", "left_semi"), "met-nodes")
    sketches, links, comps, tried = nodes.select("row", "sketch"), None, None, None
    for turn in [*range(TURNS), None]:
        if turn is None:
            rows = left_over(met, comps, nodes)
        else:
            rows = met.withColumn("comp", F.col("row"))
            if turn:
                labelled, sizes = spanning(met, comps)
                rows = labelled.join(sizes.select("shingle"), "shingle", "left_semi")
            rows = rows.select("row", "comp", "n", "pos", F.lit(-1).alias("side"), F.xxhash64("shingle", "block").alias("bucket")).join(sketches, "row")
        pairs = paired(rows, threshold, turn)
        pairs = tables.written(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs")
        if comps is not None and pairs.isEmpty():
            continue
        tried = tried.union(pairs) if tried else pairs
        found = verified(docs, nodes, pairs, id_col, text_col, words, threshold, tables)
        links = links.union(found) if links else found
        if comps is None or not found.isEmpty():
            comps = components(links)
    # Equal sets of one task's rows become one row before the shuffle; empty sets need none.
    classes = table.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("own"))
    labels = nodes.select("row", "s1", "s2").join(comps, F.col("row") == F.col("node")).select("s1", "s2", "component")
    classes = kept.written(classes.join(labels, ["s1", "s2"], "left"), "classes")
    tables.clear()
    lowest = classes.where("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("lowest"))
    moved = classes.join(lowest, "component").where(~F.col("own").eqNullSafe(F.col("lowest"))).select("s1", "s2", "lowest")
    rows = table.select("doc_id", "n", "s1", "s2")
    some = rows.where("n > 0").join(classes.select("s1", "s2", "own").join(moved, ["s1", "s2"], "left"), ["s1", "s2"])
    out = some.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("lowest", "own").alias("component_id"), "s1", "s2")
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").cast("long"), F.col("doc_id").alias("component_id"), "s1", "s2"))
