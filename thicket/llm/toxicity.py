"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document has a severity grade from 0 (clean) to K. The model says
``P(grade <= k) = sigmoid(threshold_k - score)`` with ordered thresholds and one
weight for each feature that all thresholds share (proportional odds); from it
follow the probabilities of all grades and the expected severity, the sum of
``P(grade > k)``.

Features are presences of lower-cased words and of their first 4, 5 and 6
bytes (words share stems and differ in endings), as 64-bit hashes. Grades come from a labelled table (doc_id, grade); from the
binary labels of toxic documents grades are made by ``graded``: a first fit of
toxic against clean finds the features that tell, and toxic documents with more
of them are graded higher.

Training takes at most ``most_rows`` labelled documents, one row of each id (its highest grade), those with the smallest
hash of their id (documented bound; labels do not grow with the corpus in
practice). Their sparse features, not their texts, come to the driver, cut to
the ``most_features`` columns that occur in most rows after those in fewer than
``least_rows`` are gone. Scoring covers every whole text, in its own row, with a
broadcast weight table of fixed size; nothing else is shuffled.

Defined cases: a null or empty text has no features and gets the score 0 of the
intercept, grade 0; labels that are null are left
out; without labels of both kinds the model rejects nothing; repeated rows stay; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.kernels import forget, groups, map_rows, span_hashes, spans, Table, texts_of
from thicket.storage import small, written

PREFIXES = (4, 5, 6)
# Bytes that are parts of words: ASCII letters, digits and all bytes of longer characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts (first, end) with the rows and hashes of their features; a feature may come more than once."""
    coded = [t.lower().encode() for t in texts]
    for a, b in groups(map(len, coded)):
        joined = np.frombuffer(b"\n".join(coded[a:b]), np.uint8)
        starts, ends = spans(_WORD[joined])
        owner = a + np.searchsorted(np.cumsum([len(c) + 1 for c in coded[a:b]]), starts, side="right")
        rows, from_, to, kind = [owner], [starts], [ends], [np.zeros(len(starts), np.uint64)]
        for size in PREFIXES:
            long = ends - starts > size
            rows.append(owner[long])
            from_.append(starts[long])
            to.append(starts[long] + size)
            kind.append(np.full(int(long.sum()), size, np.uint64))
        hashes = span_hashes(joined, np.concatenate(from_), np.concatenate(to)) ^ np.concatenate(kind)
        yield a, b, np.concatenate(rows), hashes


@dataclass
class Model:
    """Feature hashes, their shared weights, and the ordered thresholds of grades."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def scores(self, texts: list[str], table: Table) -> np.ndarray:
        out = np.zeros(len(texts))
        for _, _, rows, hashes in features(texts):
            at = table.get(hashes)
            hit = at >= 0
            pairs = np.unique(rows[hit] * len(self.hashes) + at[hit])
            out += np.bincount(pairs // max(len(self.hashes), 1), weights=self.weights[pairs % max(len(self.hashes), 1)], minlength=len(texts))
        return out

    def over(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a column each."""
        return 1 / (1 + np.exp(-(scores[:, None] - self.thresholds)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_columns: int, decay: float = 2e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional odds model on presences (row, column), by Adam on the mean log-likelihood.

    Thresholds are kept in order as the first one and logs of the gaps.
    """
    k = max(1, int(grades.max(initial=0)))
    n = len(grades)
    shares = np.clip([(grades > j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    first = np.log((1 - shares) / shares)
    theta = np.concatenate([np.zeros(n_columns), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    order = np.arange(n)
    for step in range(1, steps + 1):
        weights, base, gaps = theta[:n_columns], theta[n_columns], np.exp(theta[n_columns + 1 :])
        cuts = base + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=weights[columns], minlength=n)
        upto = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-(cuts - score[:, None]))), np.ones((n, 1))], axis=1)
        p = np.maximum(upto[order, grades + 1] - upto[order, grades], 1e-12)
        slope = upto * (1 - upto)  # d upto / d (cut - score)
        high, low = slope[order, grades + 1] / p, slope[order, grades] / p
        by_score = high - low
        by_cut = np.array([(low[grades == j + 1].sum() - high[grades == j].sum()) / n for j in range(k)])
        by_gap = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        grad = np.concatenate([np.bincount(columns, weights=by_score[rows], minlength=n_columns) / n + decay * weights, [by_cut.sum()], by_gap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_columns + 1 :]))])
    return theta[:n_columns], cuts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", most_rows: int = 20_000, most_features: int = 4096, least_rows: int = 3, least_z: float = 4.0, graded: bool = True) -> Model:
    """Model of labels (id, grade); with graded, a binary label's toxic documents get grades 1 and 2 by how many telling features they have."""
    chosen = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(grade_col).cast("int")).alias("grade"))
    chosen = written(chosen, "toxic-labels")
    many = chosen.count()
    if many > most_rows:  # a cut of the hashes leaves about nineteen in twenty of most_rows, whatever the number of labels
        chosen = chosen.where(F.xxhash64("id") < int((0.95 * most_rows / many - 0.5) * 2**64)).orderBy(F.xxhash64("id"), "id").limit(most_rows)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch, "text")
        for a, b, rows, hashes in features(texts):
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            first = np.append(True, (np.diff(rows) != 0) | (np.diff(hashes) != 0))[: len(rows)]
            rows, hashes = rows[first], hashes[first].view(np.int64)
            offsets = np.searchsorted(rows, np.arange(a, b + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))], ["id", "grade", "features"])

    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(chosen, most_rows), "id").select("id", "grade", "text")
    id_type = joined.schema["id"].dataType.simpleString()
    # One row of each labelled id, whichever number of rows it has.
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("features")))
    sample = map_rows(joined, work, f"id {id_type}, grade int, features array<long>").withColumn("first", first).where("first = 1").drop("first")
    sample = written(sample, "toxic-sample")
    totals = sample.agg(F.count_if(F.col("grade") > 0).alias("toxic"), F.count("*").alias("n")).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf]))
    if not totals.toxic or totals.toxic == totals.n:
        return nothing
    counts = sample.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("grade") > 0).alias("toxic"), F.count("*").alias("n")).where(f"n >= {least_rows}")
    share = F.col("n") / totals.n
    apart = (F.col("toxic") / totals.toxic - (F.col("n") - F.col("toxic")) / (totals.n - totals.toxic)) / F.sqrt(share * (1 - share) * (1 / totals.toxic + 1 / (totals.n - totals.toxic)))
    best = [r.f for r in counts.where((share < 1) & (apart >= least_z)).orderBy(F.desc(apart), "f").limit(most_features).select("f").collect()]
    hashes = np.sort(np.array(best, np.int64))
    held = docs.sparkSession.sparkContext.broadcast(hashes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(held.value, f, assume_unique=True)).astype(np.int16).tobytes() for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["grade", "columns"])

    rows = sample.select("grade", "features").mapInArrow(packed, "grade int, columns binary").collect()  # at most most_rows rows of two bytes a feature
    grades = np.array([r.grade for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r["columns"]) // 2 for r in rows])
    column = np.frombuffer(b"".join(bytes(r["columns"]) for r in rows), np.int16).astype(np.int64)
    if graded and grades.max() == 1:
        weights, _ = fit_ordinal(row, column, grades, len(hashes))
        telling = np.bincount(row, weights=(weights[column] > 0.5), minlength=len(rows))
        middle = np.median(telling[grades == 1])
        grades = grades + ((grades == 1) & (telling > middle))
    weights, cuts = fit_ordinal(row, column, np.minimum(grades, 9), len(hashes))
    return Model(hashes.view(np.uint64), weights, cuts, best_cut(Model(hashes.view(np.uint64), weights, cuts).over(np.bincount(row, weights=weights[column], minlength=len(rows)))[:, 0], grades > 0))


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The P(grade > 0) from which rejecting makes fewest errors on the sample, in the middle of the gap there, at most 0.5."""
    order = np.argsort(-p, kind="stable")
    errors = toxic.sum() - np.cumsum(np.where(toxic[order], 1, -1))
    at = int(errors.argmin())
    below = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float(min(0.5, (p[order[at]] + below) / 2))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grade, severity, p_toxic, rejected of each document: its most likely grade, expected severity, P(grade > 0), and whether that is at least the model's cut."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = held.value
        over = own.over(own.scores(texts_of(batch, text_col), Table(own.hashes, np.arange(len(own.hashes)))))
        each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1), axis=1)
        columns = [batch.column(batch.schema.get_field_index(id_col)), pa.array(each.argmax(axis=1)), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(over[:, 0] >= own.cut)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "severity", "p_toxic", "rejected"])

    return map_rows(docs.select(id_col, text_col), work, f"doc_id {id_type}, grade long, severity double, p_toxic double, rejected boolean")


def rejecter(docs: DataFrame, model: Model):
    """A function of a text column: whether a document is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        own = held.value
        table = Table(own.hashes, np.arange(len(own.hashes)))
        for texts in parts:
            out = [own.over(own.scores(["" if t is None else t for t in texts.iloc[a:b]], table))[:, 0] >= own.cut for a, b in groups(0 if t is None else len(t) for t in texts)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, bool))
        forget()

    return rejected
