"""Token-ID files: static range asymmetric numeral system (rANS) blocks.

Texts are tokenized map-side, once, and kept as compact id strings; the counts
of all ids of the corpus become one shared frequency table. The documents are
then dealt out by ranges of their id, in ascending order, and each range becomes
a file of blocks. A block holds ``BLOCK`` ids (the last of a file fewer) as
``LANES`` interleaved rANS streams that numpy codes side by side; it needs
nothing but the shared table, so blocks decode in parallel on any executor. A
block has a checkpoint (lane states and word position) every ``EVERY`` ids, from
which decoding can begin in its middle, and checksums of its bytes, of its ids
and of its table.

A block's bytes, all little-endian::

    "RANS" u16 version, u16 lanes, u32 ids, u32 every, u32 words,
    u32 crc of the table, u32 crc of the ids as u32, u32 crc of all that follows
    u64 x lanes     states at the first id
    per checkpoint  u32 word position, u64 x lanes states
    u32 x words     renormalization words in decoding order

Blocks are rows of a Parquet folder, written by Spark's committer, so that lost
executors and repeated tasks leave whole files only: ``part`` and ``block`` give
the order, ``doc_ids`` and ``doc_tokens`` the documents in it; a document that
goes on in the next block is listed in both, with its number in the part.

Defined cases: a null text is the empty one (just the end id); documents with
the same id stay apart, in the order of their id strings; null ids come first;
an empty table gives no files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.kernels import UnitCache, groups, kept, map_rows, per_row, sliced, texts_of
from thicket.storage import shared_dir, small, written

SCALE = 18
LOW = 1 << 31
BLOCK = 1 << 20
LANES = 2048
EVERY = 1 << 18
HEAD = struct.Struct("<4sHHIIIIII")
VERSION = 1


@dataclass
class Frequencies:
    """Frequencies of ids that sum to 2**SCALE; each id with a count has at least 1."""

    ids: np.ndarray
    freq: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        order = np.argsort(ids)
        ids, counts = np.asarray(ids, np.int64)[order], np.asarray(counts, np.float64)[order]
        if len(ids) > 1 << SCALE:
            raise ValueError(f"more than {1 << SCALE} different ids")
        freq = np.maximum(1, np.floor(counts * (1 << SCALE) / max(counts.sum(), 1))).astype(np.int64)
        rank, off = np.argsort(-freq, kind="stable"), (1 << SCALE) - int(freq.sum())
        if len(ids) and off > 0:
            freq[rank[0]] += off
        while off < 0:  # take from the largest what the rounding up of rare ids has used
            give = np.minimum(freq[rank] - 1, np.maximum(1, freq[rank] // 64))
            give = np.where(np.cumsum(give) <= -off, give, np.maximum(0, -off - (np.cumsum(give) - give)))
            freq[rank] -= give
            off += int(give.sum())
        return cls(ids, freq)

    @property
    def crc(self) -> int:
        return zlib.crc32(self.ids.tobytes() + self.freq.tobytes())

    def coder(self) -> Coder:
        return Coder(self)


class Coder:
    """Encodes and decodes blocks of ids with one table."""

    def __init__(self, table: Frequencies) -> None:
        self.crc, self.ids = table.crc, table.ids
        self.freq = table.freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.ids), dtype=np.int32), table.freq)
        self.number = np.full(int(self.ids.max(initial=0)) + 1, -1, np.int64)
        self.number[self.ids] = np.arange(len(self.ids))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        step = max(1, every // lanes)
        symbols = self.number[ids]
        if n and symbols.min() < 0:
            raise ValueError("an id without a frequency")
        freq, cum = self.freq[symbols], self.cum[symbols]
        most = freq << np.uint64(63 - SCALE)
        x, words, marks = np.full(lanes, LOW, np.uint64), [], []
        steps = -(-n // lanes)
        for t in range(steps - 1, -1, -1):
            at = slice(t * lanes, min(n, (t + 1) * lanes))
            f, s = freq[at], x[: at.stop - at.start]
            full = s >= most[at]
            if full.any():
                words.append((s[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                s[full] >>= np.uint64(32)
            else:
                words.append(None)
            whole, rest = np.divmod(s, f)
            s[:] = (whole << np.uint64(SCALE)) + rest + cum[at]
            if t and t % step == 0:
                marks.append((t, x.copy()))
        words.reverse()
        sizes = np.fromiter((0 if w is None else len(w) for w in words), np.int64, len(words))
        before = np.cumsum(sizes) - sizes
        stream = np.concatenate([w for w in words if w is not None] or [np.zeros(0, "<u4")])
        body = [x.astype("<u8").tobytes()]
        for t, states in reversed(marks):
            body += [struct.pack("<I", int(before[t])), states.astype("<u8").tobytes()]
        tail = b"".join([*body, stream.tobytes()])
        return HEAD.pack(b"RANS", VERSION, lanes, n, step * lanes, len(stream), self.crc, zlib.crc32(ids.astype("<u4")), zlib.crc32(tail)) + tail

    def decode(self, block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids[start:stop] of a block, from the last checkpoint before start; a whole block is held against the checksum of its ids."""
        magic, version, lanes, n, every, n_words, table, crc, body = HEAD.unpack_from(block)
        if magic != b"RANS" or version != VERSION or table != self.crc:
            raise ValueError("not a block of this table")
        if zlib.crc32(memoryview(block)[HEAD.size :]) != body:
            raise ValueError("a block's bytes don't match their checksum")
        stop = n if stop is None else min(stop, n)
        step, stride = every // lanes, 4 + 8 * lanes
        words = np.frombuffer(block, "<u4", n_words, len(block) - 4 * n_words)
        mark = min(start // every, max(0, (-(-n // lanes) - 1) // step))
        if mark:
            offset = HEAD.size + 8 * lanes + (mark - 1) * stride
            position, offset = struct.unpack_from("<I", block, offset)[0], offset + 4
        else:
            position, offset = 0, HEAD.size
        x = np.frombuffer(block, "<u8", lanes, offset).copy()
        first = mark * step
        out = np.empty(max(0, min(n, (-(-stop // lanes)) * lanes) - first * lanes), np.int64)
        low, mask, scale = np.uint64(LOW), np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for t in range(first, -(-stop // lanes)):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            s = x[: b - a]
            slot = s & mask
            symbol = self.symbol[slot]
            out[a - first * lanes : b - first * lanes] = symbol
            s[:] = self.freq[symbol] * (s >> scale) + slot - self.cum[symbol]
            need = np.flatnonzero(s < low)
            if len(need):
                s[need] = (s[need] << np.uint64(32)) | words[position : position + len(need)]
                position += len(need)
        ids = self.ids[out[start - first * lanes : stop - first * lanes]]
        if start == 0 and stop == n and zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("a block's ids don't match their checksum")
        return ids


# White space as bytes: ASCII (with the separators that some libraries count), and the longer characters by their bytes.
_ASCII_WHITE = np.zeros(256, dtype=bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER, _POINT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_WIDE_WHITE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPECIAL = "<|"
#: The pre-tokens of byte-level BPE, as the tokenizers library has them.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Tokenizer:
    """ids of whole texts by the tokenizers library, from a cache of text units.

    A pre-token never reaches over a single space or line feed between two
    characters that are no white space, nor from an ASCII letter to punctuation
    other than an apostrophe. So a text's ids are those of its units between
    such places, found by hash; the library's model merges the pre-tokens of
    units that are new. Texts with what may be a special token, and all texts of
    a tokenizer that isn't plain byte-level BPE, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer as Library

        self.library, self.pattern, self.letters = Library.from_file(path), regex.compile(PRETOKEN), letters()
        with open(path) as f:
            plan = json.load(f)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.plain = plan.get("normalizer") is None and byte_level.items() <= {"use_regex": True, **(plan.get("pre_tokenizer") or {})}.items()
        self.cache = UnitCache(self.new, most=600_000)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def ids_of(self, pretoken: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters))]

    def new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for unit in map(bytes.decode, units):
            before, word = len(ids), unit.removeprefix(" ")
            # One pre-token, as most are; past the common alphabets the pattern decides.
            if word.isalpha() and max(word) < "\u0530":
                ids += self.ids_of(unit)
            else:
                for pretoken in self.pattern.findall(unit):
                    ids += self.ids_of(pretoken)
            lengths.append(len(ids) - before)
        return np.array(ids, np.int32), np.array(lengths, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and their number for each."""
        whole = {i: t for i, t in enumerate(texts) if _SPECIAL in t or not self.plain}
        coded = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        ids, n = [], []
        for a, b in groups(map(len, coded)):
            found, counts = self._units(coded[a:b], any(_WIDE_WHITE.search(t) for t in texts[a:b]))
            ids.append(found)
            n.append(counts)
        ids, n = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(n) if n else np.zeros(0, np.int64)
        if not whole:
            return ids, n
        pieces = np.split(ids, np.cumsum(n)[:-1])
        for i, found in zip(whole, self.whole(list(whole.values()))):
            pieces[i], n[i] = found, len(found)
        return np.concatenate(pieces), n

    def _units(self, coded: list[bytes], wide: bool) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum([len(c) for c in coded])
        white = _ASCII_WHITE[joined]
        if wide:
            white |= wide_white(joined)
        new = np.zeros(len(joined) + 1, bool)
        single = ~white[:-2] & ~white[2:]
        new[1 : len(joined) - 1] = (joined[1:-1] == 0x20) & single
        line = (joined[1:-1] == 0x0A) & single
        new[1 : len(joined) - 1] |= line
        new[2 : len(joined)] |= line
        new[1 : len(joined)] |= _LETTER[joined[:-1]] & _POINT[joined[1:]]
        # What a neighbour in another text would allow is no such place; a text begins a unit of its own.
        first = ends - [len(c) for c in coded]
        own = first[ends > first]
        around = np.unique(np.concatenate([own, own + 1, own - 1]))
        around = around[(around >= 0) & (around < len(joined))]
        new[around] = False
        new[own] = True
        starts = np.flatnonzero(new[:-1])
        unit_ends = np.append(starts[1:], len(joined)) if len(starts) else starts
        ids, lengths = self.cache.tokens(joined, starts, unit_ends)
        upto = np.searchsorted(starts, ends)
        return ids, per_row(np.diff(upto, prepend=0), lengths)


def wide_white(joined: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 white space outside ASCII."""
    a, b, c = joined, np.append(joined[1:], 0), np.append(joined[2:], [0, 0])[: len(joined)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    out = two | three
    out[1:] |= two[:-1] | three[:-1]
    out[2:] |= three[:-2]
    return out


def packed(ids: np.ndarray) -> bytes:
    """ids as their bytes by significance, compressed: what is kept between the steps."""
    wide = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    planes = [p for p in range(4) if p < 2 or wide[:, p].any()]
    return bytes([len(planes)]) + zstandard.compress(np.ascontiguousarray(wide[:, planes].T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], np.uint32)
    for p, plane in enumerate(planes):
        out |= plane.astype(np.uint32) << np.uint32(8 * p)
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, ids of each document; and rows with n null, in which each task tells the counts of all its ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        names = ["doc_id", "n", "ids"]
        for batch in batches:
            arrow_type[:] = [batch.schema.field(id_col).type]
            for part in sliced(batch):
                tokenizer = kept(("tokenizer", tokenizer_path), lambda: Tokenizer(tokenizer_path))
                ids, n = tokenizer.encode(texts_of(part, text_col))
                seen = np.bincount(ids, minlength=max(len(counts), end_id + 1))
                seen[end_id] += len(n)
                seen[: len(counts)] += counts
                counts = seen
                own = [packed(np.append(x, end_id)) for x in np.split(ids, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(id_col)), pa.array(n + 1), pa.array(own, pa.binary())], names)
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.array([None], arrow_type[0]), pa.array([None], pa.int64()), pa.array([packed_counts(counts)], pa.binary())], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n long, ids binary")


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def frequencies(tokens: DataFrame) -> Frequencies:
    """The shared table, from the counts of all tasks; the driver gets a row for each different id."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for (data,) in zip(batch.column(0)):
            counts = np.frombuffer(zlib.decompress(data.as_py()), "<i8")
            ids = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], ["id", "n"])

    rows = map_rows(tokens.where("n IS NULL").select("ids"), work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Frequencies.of(rows["id"].to_numpy(), rows["n"].to_numpy())


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Writes ``path``/blocks and ``path``/table: the ids of all texts, in ascending order of their documents' ids."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    table = frequencies(tokens)
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(table.ids, table.freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(table)  # 16 bytes for each id of the vocabulary
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = held.value.coder(), TaskContext.get().partitionId()
        names = ["part", "block", "first", "n", "doc_ids", "doc_numbers", "doc_tokens", "data"]
        number, done, sequence = 0, 0, 0
        ids, owners, waiting = [], [], 0
        id_arrow = None

        def block_of(n: int) -> pa.RecordBatch:
            nonlocal number, done, waiting, ids, owners
            joined = np.concatenate(ids)
            mine, left, own = joined[:n], n, []
            while left:
                doc, seq, has = owners[0]
                own.append((doc, seq, min(has, left)))
                if has <= left:
                    owners.pop(0)
                else:
                    owners[0] = (doc, seq, has - left)
                left -= own[-1][2]
            out = [[part], [number], [done], [n], [[d for d, _, _ in own]], [[s for _, s, _ in own]], [[k for _, _, k in own]], [coder.encode(mine)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_arrow), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            ids, waiting = [joined[n:]], waiting - n
            number, done = number + 1, done + n
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = unpacked(data.as_py()).astype(np.int64)
                ids.append(own)
                owners.append((doc, sequence, len(own)))
                sequence, waiting = sequence + 1, waiting + len(own)
                while waiting >= block:
                    yield block_of(block)
        if waiting:
            yield block_of(waiting)

    ordered = tokens.where("n IS NOT NULL").select("doc_id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    schema = f"part int, block int, first long, n long, doc_ids array<{id_type}>, doc_numbers array<long>, doc_tokens array<long>, data binary"
    # The blocks are dense already.
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Frequencies:
    rows = spark.read.parquet(f"{path}/table").toPandas()
    return Frequencies(*(rows.sort_values("id")[c].to_numpy(np.int64) for c in ("id", "freq")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids, part, number of the documents of written files, a row for each block that a document has ids in."""
    table = read_table(spark, path)
    held = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{path}/blocks")
    return _pieces(blocks, held, blocks.schema["doc_ids"].dataType.elementType.simpleString(), with_ids=True)


def _pieces(blocks: DataFrame, held, id_type: str, with_ids: bool) -> DataFrame:
    coders: list[Coder] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not coders:
            coders.append(held.value.coder())
        for r in range(batch.num_rows):
            row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            ids = coders[0].decode(row["data"].as_py()).astype("<u4")
            n = np.array(row["doc_tokens"].as_py(), np.int64)
            ends = np.cumsum(n)
            own = [ids[a:b] for a, b in zip(ends - n, ends)]
            docs = row["doc_ids"].values
            columns = [pa.array(np.full(len(n), row["part"].as_py(), np.int32)), row["doc_numbers"].values, docs, pa.array(row["first"].as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            names = ["part", "number", "doc_id", "start", "n", "crc"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, number long, doc_id {id_type}, start long, n long, crc long" + ", ids array<long>" * with_ids
    return map_rows(blocks.select("part", "first", "doc_ids", "doc_numbers", "doc_tokens", "data"), work, schema)


def crc_joined(one: int, two: int, length: int) -> int:
    """The CRC-32 of two strings joined, from theirs and the length of the second: the first is carried over length zero bytes."""

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return out

    bit = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        bit = [times(bit, x) for x in bit]
    while length:
        if length & 1:
            one = times(bit, one)
        bit, length = [times(bit, x) for x in bit], length >> 1
    return one ^ two


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from decoded blocks alone."""
    held = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = _pieces(blocks, held, id_type, with_ids=False)
    docs = pieces.groupBy("part", "number", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        crcs = []
        for pieces in batch.column(2).to_pylist():
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = crc_joined(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        starts = pa.array([p[0]["start"] for p in batch.column(2).to_pylist()], pa.int64())
        n = pa.array([sum(x["n"] for x in p) for p in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), starts, n, pa.array(crcs, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = map_rows(docs.select("part", "doc_id", "pieces"), work, f"part int, doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    return docs.join(small(offsets, 100_000), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the files (by default to a new folder in the shared one) and gives index() of them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, id_col, text_col)
    return index(spark, path)
