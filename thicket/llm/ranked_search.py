"""Ranked lexical search: the k best documents for each item, exactly.

Terms are runs of letters and digits (all characters beyond ASCII count as letters),
A-Z lower-cased. A document's score sums over the item's terms, repeats included,
``weight * ((10^9 tf) div (1000 tf + 8 m))``: all in whole numbers but the
logarithm of a weight. The impact of a term on a document is that product.

1. The items' terms are numbered; one pass over all texts writes what a document holds
   of them (its size, term numbers, their counts). Document frequencies, the number
   of documents with terms and all their terms follow from that table.
2. Each term's k highest impacts are found over all documents, by tasks first. The
   k-th is stored with the highest one.
3. k documents have at least a term's k-th impact, so the greatest k-th impact (times
   the term's repeats) of an item's terms is a lower bound of its k-th score: the
   threshold it begins with. An item's terms are ordered by the most they can give;
   from where on the rest together stays below the threshold, terms make no
   candidates, as a document with none but these is not among the k.
4. Joined with the stored table, the other terms tell a partial score of each document
   and item; those that reach the threshold even with the greatest rest are
   candidates, which are rescored exactly from all terms. A task raises its thresholds
   by the k-th score of what it has kept, and tells at most k documents an item.
   Those of all tasks meet by item.

Items go through in blocks of ``BLOCK_BYTES`` of text, each with a broadcast no
larger, whatever their number. Documents are never shuffled, and nothing of them
gathers on the driver but k impacts a term.

Defined cases: documents and items without terms or text score nothing and have no
rows; a row of the table of items is an item, also if ids repeat (rows with equal id
and text are one); rows of documents with one id are documents each; equal scores are
ordered by ascending id, null ids last; empty tables give no rows; columns other than
id and text are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.kernels import GROUP_BYTES, sliced, texts_of
from thicket.storage import Scratch

K = 10
#: Items of so many bytes of text are searched at once.
BLOCK_BYTES = 4 << 20
#: Items and documents whose scores are held in one matrix.
ITEMS, DOCS = 128, 512
_TERM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Bytes of terms as they are but for A-Z; all others become spaces.
TABLE = _TERM.lower()


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, about a megabyte of it at a time."""
    data = text.encode().translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + GROUP_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Items:
    """Items with their terms as numbers; a term's number is its place in names."""

    def __init__(self, rows: list[tuple[object, str]]) -> None:
        counts = [(key, sum((Counter(part) for part in terms_of(text)), Counter())) for key, text in rows]
        counts = [(key, own) for key, own in counts if own]
        self.names = sorted({t for _, own in counts for t in own})
        number = {t: i for i, t in enumerate(self.names)}
        self.keys = [key for key, _ in counts]
        self.terms = [np.array(sorted(number[t] for t in own), np.int64) for _, own in counts]
        self.repeats = [np.array([own[self.names[t]] for t in at.tolist()], np.int64) for at, (_, own) in zip(self.terms, counts)]


def held_terms(docs: DataFrame, names: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, counts of each document that has terms: the number of them all, and which of names it holds how often."""
    held = docs.sparkSession.sparkContext.broadcast(names)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(held.value)}
        for batch in batches:
            for part in sliced(batch):
                rows, sizes, terms, counts = [], [], [], []
                for i, text in enumerate(texts_of(part, text_col)):
                    n, own = 0, Counter()
                    for found in terms_of(text):
                        n += len(found)
                        own.update(map(number.get, found))
                    if n:
                        own.pop(None, None)
                        rows.append(i)
                        sizes.append(n)
                        terms.append(list(own))
                        counts.append(list(own.values()))
                keys = part.column(part.schema.get_field_index(id_col)).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, counts array<long>")


class Scoring:
    """Weights of terms and sizes of the table, for impacts."""

    def __init__(self, frequencies: dict[int, int], terms: int, documents: int, words: int) -> None:
        self.documents, self.words = documents, words
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(terms)], np.int64)

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and impact of each entry of a batch of held_terms()."""
        lists, counts = batch.column(2), batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        m = 100 - 75 + (75 * n * self.documents) // self.words
        tf, term = counts.flatten().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return row, term, self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


def best_impacts(index: DataFrame, scoring: Scoring, k: int) -> DataFrame:
    """term, impact: the k highest impacts of each term that some document holds."""
    held = index.sparkSession.sparkContext.broadcast(scoring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, impacts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, term, impact = held.value.impacts(batch)
            terms, impacts = np.concatenate([terms, term]), np.concatenate([impacts, impact])
            order = np.lexsort((-impacts, terms))
            terms, impacts = terms[order], impacts[order]
            starts = np.flatnonzero(np.append(True, np.diff(terms) != 0)[: len(terms)])
            nth = np.arange(len(terms)) - np.repeat(starts, np.diff(np.append(starts, len(terms))))
            terms, impacts = terms[nth < k], impacts[nth < k]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(impacts)], ["term", "impact"])

    told = index.mapInArrow(run, "term long, impact long")
    order = Window.partitionBy("term").orderBy(F.desc("impact"))
    return told.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("term", "impact")


class Plan:
    """What a task needs of a block of items: which terms make candidates, what the rest can give, and the thresholds."""

    def __init__(self, items: Items, highest: np.ndarray, kth: np.ndarray) -> None:
        self.items, self.blocks = items, []
        self.threshold = np.zeros(len(items.keys), np.int64)
        essential, self.rest = [], np.zeros(len(items.keys), np.int64)
        for i, (terms, repeats) in enumerate(zip(items.terms, items.repeats)):
            most = repeats * highest[terms]
            # Only scores above 0 count.
            self.threshold[i] = max(1, int((repeats * kth[terms]).max()))
            order = np.argsort(-most, kind="stable")
            after = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what the terms from each place on can give together
            cut = int(np.argmax(after < self.threshold[i]))
            essential.append(order[:cut])
            self.rest[i] = after[cut]
        for at in range(0, len(items.keys), ITEMS):
            own = range(at, min(at + ITEMS, len(items.keys)))
            terms = np.unique(np.concatenate([items.terms[i] for i in own]))
            matrix = np.zeros((len(terms), len(own)))
            for c, i in enumerate(own):
                chosen = essential[i]
                matrix[np.searchsorted(terms, items.terms[i][chosen]), c] = items.repeats[i][chosen]
            self.blocks.append((at, terms, matrix))


class Best:
    """The k best documents of each item so far; thresholds rise with them."""

    def __init__(self, plan: Plan, k: int) -> None:
        self.plan, self.k, self.threshold = plan, k, plan.threshold.copy()
        self.found: list[list[tuple[int, bool, object]]] = [[] for _ in plan.items.keys]

    def look(self, keys: list, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Takes up to DOCS documents in: entries tell row, term and impact."""
        items = self.plan.items
        for first, terms, matrix in self.plan.blocks:
            at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            mine = terms[at] == term
            dense = np.zeros((len(keys), len(terms)))
            dense[row[mine], at[mine]] = impact[mine]
            partial = dense @ matrix
            own = slice(first, first + matrix.shape[1])
            # Sums are whole below 2^53; the allowance is for items so long that they are not.
            reach = (partial > 0) & (partial + self.plan.rest[own] >= self.threshold[own] * (1 - 1e-9))
            for c in np.flatnonzero(reach.any(axis=0)).tolist():
                docs, i = np.flatnonzero(reach[:, c]), first + c
                whole = dense[np.ix_(docs, np.searchsorted(terms, items.terms[i]))].astype(np.int64) @ items.repeats[i]
                good = whole >= self.threshold[i]
                if good.any():
                    self._keep(i, zip(whole[good].tolist(), docs[good].tolist()), keys)

    def _keep(self, i: int, more: Iterator[tuple[int, int]], keys: list) -> None:
        found = self.found[i] + [(-score, keys[d] is None, keys[d] if keys[d] is not None else 0) for score, d in more]
        self.found[i] = sorted(found)[: self.k]
        if len(self.found[i]) == self.k:
            self.threshold[i] = max(self.threshold[i], -self.found[i][-1][0])


def candidates(index: DataFrame, plan: Plan, scoring: Scoring, k: int) -> DataFrame:
    """item, doc_id, score: exact scores, of each task's k best documents an item."""
    held = index.sparkSession.sparkContext.broadcast((plan, scoring))
    id_type = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, scoring = held.value
        best, kind = Best(plan, k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                best.look(part.column(0).to_pylist(), *scoring.impacts(part))
        rows = [(i, None if none else key, -score) for i, own in enumerate(best.found) for score, none, key in own]
        if rows:
            item, key, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(key, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item long, doc_id {id_type}, score long")


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The rows of items, dealt into blocks of about BLOCK_BYTES of text, one at a time."""
    rows = items.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    blocks = -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]) // BLOCK_BYTES)
    for b in range(blocks):
        yield [(r.k, r.t) for r in rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()]


def search(items: DataFrame, docs: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents that score highest for each item, above 0."""
    spark, tables, kept = docs.sparkSession, Scratch(), Scratch()
    id_type, key_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    out = spark.createDataFrame([], f"item_id {key_type.simpleString()}, rank int, doc_id {id_type}, score long")
    for rows in blocks_of(items, item_col, item_text_col):
        wanted = Items(rows)
        if not wanted.names:
            continue
        index = tables.written(held_terms(docs, wanted.names, id_col, text_col), "held-terms")
        documents, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not words:
            continue
        # One row for each of the items' terms.
        frequencies = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        scoring = Scoring(frequencies, len(wanted.names), documents, words)
        highest, kth, seen = (np.zeros(len(wanted.names), np.int64) for _ in range(3))
        for term, impact in best_impacts(index, scoring, k).orderBy("term", F.desc("impact")).collect():
            highest[term] = max(highest[term], impact)
            seen[term] += 1
            kth[term] = impact if seen[term] == k else 0
        told = candidates(index, Plan(wanted, highest, kth), scoring, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = kept.written(told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best-documents")
        tables.clear(index)
        names = spark.createDataFrame([(i, key) for i, key in enumerate(wanted.keys)], f"item long, item_id {key_type.simpleString()}")
        out = out.union(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
