"""Token counts by a map-side two-tier lookup.

A text's pre-tokens are its words with the white-space marker before them, cut
where no piece of the vocabulary reaches across (checked when the model is
read), so the count of a text is the sum over its pre-tokens. First tier: a
compact hash table of the lengths of the most common pre-tokens of the whole
corpus, broadcast; its size is fixed (12 bytes a slot, at most four slots for
each of ``frequent_rows``). Second tier: a worker's own cache, filled by encoding
what misses the first.

Which pre-tokens are common is counted over all texts: a task counts its
pre-tokens by hash and tells hash, count and length of those that come twice or
more, at most ``frequent_rows`` a flush. Pre-tokens themselves are never shuffled or
collected. The table decides speed alone, as misses are encoded.

Defined cases: a null text counts as the empty one, with 0 bytes and 0 tokens;
a marker that stands in a text counts as the space it is read as; repeated rows
stay; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.kernels import Table, UnitCache, commonest, kept, map_rows, per_row, sliced, span_hashes, texts_of
from thicket.storage import Scratch

#: What separates pre-tokens, as bytes: the space, and the line feed, which is no part of any piece.
SPACE, LINE = 0x20, 0x0A


def read(path: str):
    """The SentencePiece model, with the check that its pieces allow cutting before a marker and around a line feed."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(found.get_piece_size()):
        piece = found.id_to_piece(i)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError(f"pieces reach across pre-tokens: {piece!r}")
    return found


def cut(joined: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts that end at bounds: a new one starts at each text, at each space after another byte, and at and after each line feed."""
    if not len(joined):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, line = joined == SPACE, joined == LINE
    new = line.copy()
    new[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    new[0] = True
    new[bounds[bounds < len(joined)]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(joined))


def lengths_of(path: str, units: list[str]) -> np.ndarray:
    """Tokens of each pre-token inside a text: a leading marker stands for its space, and those without one follow a line feed.

    The library puts a marker before every text; a line feed in front takes it
    (as marker and byte piece) and leaves the pre-token as it is in its text.
    """
    return np.fromiter((len(x) - 2 for x in kept(("piece model", path), lambda: read(path)).encode(["\n" + u for u in units], num_threads=1)), np.int64, len(units))


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, starts, ends and number per text of the pre-tokens; markers are spaces, and a text that isn't empty gets the marker the library puts before it."""
    parts = [(" " + t.replace("▁", " ")).encode() if t else b"" for t in texts]
    joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
    bounds = np.cumsum([len(p) for p in parts])
    starts, ends = cut(joined, bounds)
    upto = np.searchsorted(starts, bounds)
    return joined, starts, ends, np.diff(upto, prepend=0)


def lengths_cache(model_path: str) -> UnitCache:
    """This worker's lengths of pre-tokens, over tasks."""

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int32), lengths_of(model_path, [u.decode() for u in units])

    return kept(("token counts", model_path), lambda: UnitCache(encode))


#: Distinct pre-tokens that a task counts before it tells the most common.
FLUSH = 1 << 20


def frequent(docs: DataFrame, model_path: str, text_col: str, rows: int) -> DataFrame:
    """h, n, tokens: hash, number and length of common pre-tokens, counted over all texts."""

    def summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, n, tokens = (np.concatenate(x) for x in zip(*held))
        own, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        return own, np.bincount(at, weights=n).astype(np.int64), tokens[first]

    def told(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, n, tokens = summed(held)
        top = np.flatnonzero(n > 1)
        top = top[np.argsort(-n[top], kind="stable")[:rows]]
        return pa.RecordBatch.from_arrays([pa.array(hashes[top].view(np.int64)), pa.array(n[top]), pa.array(tokens[top])], ["h", "n", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = lengths_cache(model_path), [], 0
        for batch in batches:
            for part in sliced(batch):
                joined, starts, ends, _ = pretokens(texts_of(part, text_col))
                if not len(starts):
                    continue
                hashes = span_hashes(joined, starts, ends)
                at = cache.find(joined, starts, ends, hashes)
                own, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((own, n, cache.lengths[at[first]]))
                size += len(own)
                if size > FLUSH:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield told(held)
                        held, size = [], 0
        if held:
            yield told(held)

    counts = docs.select(text_col).mapInArrow(run, "h long, n long, tokens long")
    return counts.groupBy("h").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))


def table(docs: DataFrame, model_path: str, text_col: str, rows: int) -> Table:
    tables = Scratch()
    counts = tables.written(frequent(docs, model_path, text_col, rows), "pre-token-counts")
    top = commonest(counts, rows).select("h", "tokens").toPandas()  # at most ``rows`` pairs of numbers
    tables.clear()
    return Table(top["h"].to_numpy(np.int64).view(np.uint64), top["tokens"].to_numpy(np.int64))


def count(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, frequent_rows: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_missed of each document; n_missed is how many pre-tokens the broadcast table did not have."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(table(docs, model_path, text_col, frequent_rows))
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cache, texts = lengths_cache(model_path), texts_of(batch, text_col)
        joined, starts, ends, per_text = pretokens(texts)
        hashes = span_hashes(joined, starts, ends)
        lengths = held.value.get(hashes)
        missed = np.flatnonzero(lengths < 0)
        if len(missed):
            at = cache.find(joined, starts[missed], ends[missed], hashes[missed])
            lengths[missed] = cache.lengths[at]
        tokens = per_row(per_text, lengths)
        misses = np.zeros(len(starts), np.int64)
        misses[missed] = 1
        n_bytes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit), pa.array(per_row(per_text, misses))], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_missed"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, n_missed long")
