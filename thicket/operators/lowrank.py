"""Text vectors of low rank and aspects of texts: truncated SVD and non-negative factorization.

Texts become packed rows (key, terms, weights): numbers and TF-IDF weights of the
terms of a vocabulary of bounded size. Passes over packed rows take blocks of
``terms x k`` numbers to the tasks and bring sums of that size back, so neither
documents nor their products are ever gathered; rows themselves stay where they are.
Rows of one text have the same weights: a group's texts are weighed once each, with the
number of rows that have them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import LABEL_STOP, NAME_STOP, PHRASE_STOP
from thicket.operators import tfidf
from thicket.storage import Scratch, written

#: Stop words of vectors by default; any list can be given.
STOP = sorted({*NAME_STOP, *LABEL_STOP, *PHRASE_STOP})
#: Rows that are dense at once in a task.
DENSE = 256
#: A group of up to so many different texts, or of three times its square in cells (texts times terms), is one task's work; larger ones go through passes over all tasks.
LOCAL_ROWS = 1000
#: Up to so many terms X'X comes to the driver, from one pass.
GRAM_TERMS = 1024
#: Rows whose products of terms are made at once in a task.
GRAM_ROWS = 2048
#: Most aspects that are tried.
MOST_ASPECTS = 15


# --- vocabularies and packed rows


@dataclass
class Vocabulary:
    """Terms in alphabetical order with their inverse document frequencies; low to high words a term."""

    terms: list[str]
    idf: np.ndarray
    documents: int
    low: int = 1
    high: int = 2
    stop: list[str] = field(default_factory=lambda: STOP)

    def tokens(self, text: Column) -> Column:
        return tfidf.grams(text, self.low, self.high, stop=self.stop)


#: What a word is, as in tfidf.grams().
WORD = r"(?U)\b\w\w+\b"
#: Terms of which a task holds counts before it gives them on.
HELD_TERMS = 200_000


def word_lists(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """key, words: the words of each text, stop words as well, joined by spaces; null for a null text."""
    return rows.select(F.col(id_col).alias("key"), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " ").alias("words"))


def grams_of(words: str | None, low: int, high: int, stop: set[str], kept: set[str] | None = None) -> list[str]:
    """N-grams of words that are joined by spaces, as tfidf.grams() makes them of a text; with kept only those of these words."""
    own = [w for w in words.split(" ") if w not in stop] if words else []
    out = own if low == 1 and kept is None else [w for w in own if w in kept] if low == 1 else []
    if kept is not None:
        own = [w if w in kept else None for w in own]
    for n in range(max(low, 2), high + 1):
        spans = zip(*[own[i:] for i in range(n)])
        out = out + [" ".join(t) for t in (spans if kept is None else (t for t in spans if None not in t))]
    return out


def gram_counts(lists: DataFrame, low: int, high: int, stop: list[str], kept: set[str] | None = None) -> DataFrame:
    """term, tf, df of the n-grams of word lists, counted within tasks first."""
    held = lists.sparkSession.sparkContext.broadcast((frozenset(stop), kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (barred, known), tf, df = held.value, Counter(), Counter()

        def told() -> pa.RecordBatch:
            terms = list(tf)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([tf[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["term", "tf", "df"])

        for batch in batches:
            for words in batch.column(0).to_pylist():
                own = grams_of(words, low, high, barred, known)
                tf.update(own)
                df.update(set(own))
                if len(tf) > HELD_TERMS:
                    yield told()
                    tf, df = Counter(), Counter()
        yield told()

    return lists.select("words").mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def commonest(lists: DataFrame, most: int, low: int, high: int, stop: list[str]) -> list[tuple[str, int]]:
    """The terms of highest count (ties: the smaller term) of word lists in alphabetical order, with the number of lists that have them.

    An n-gram is no more frequent than each of its words. Where there are ``most`` words, only these, others as
    frequent as the last of them and the n-grams of all those are counted, which are few.
    """
    kept = None
    if low == 1:
        tables = Scratch()
        words = lists.select(F.explode(F.split("words", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
        words = tables.written(words.where((F.col("term") != "") & ~F.col("term").isin(stop)), "word-counts")
        least = words.orderBy(F.desc("tf"), "term").limit(most).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
        if most and least["n"] == most:
            frequent = words.where(F.col("tf") >= least["tf"]).select("term").limit(4 * most + 1).collect()
            kept = {r["term"] for r in frequent} if len(frequent) <= 4 * most else None
        tables.clear()
    found = gram_counts(lists, low, high, stop, kept).orderBy(F.desc("tf"), "term").limit(most).select("term", "df")
    return sorted((r["term"], r["df"]) for r in found.collect())


def vocabulary(rows: DataFrame, text: Column, max_features: int, low: int = 1, high: int = 2, stop: list[str] | None = None) -> Vocabulary:
    """The max_features terms of highest count (ties: the smaller term) over all rows, idf = ln((1 + N) / (1 + df)) + 1."""
    tables = Scratch()
    lists = tables.written(word_lists(rows.select(text.alias("\u0000t")), "\u0000t", F.col("\u0000t")).drop("key"), "word-lists")
    words = vocabulary_of(lists, max_features, low, high, STOP if stop is None else stop)
    tables.clear()
    return words


def vocabulary_of(lists: DataFrame, max_features: int, low: int, high: int, stop: list[str]) -> Vocabulary:
    """The same of word lists."""
    found, n = commonest(lists, max_features, low, high, stop), lists.count()
    return Vocabulary([t for t, _ in found], np.array([math.log((1 + n) / (1 + d)) + 1 for _, d in found]), n, low, high, stop)


def weighed(tokens: list[str], number: dict[str, int], idf: np.ndarray) -> tuple[list[int], list[float]]:
    """Term numbers and unit weights of one text."""
    counts = Counter(number[t] for t in tokens if t in number)
    terms = sorted(counts)
    w = np.array([counts[t] for t in terms]) * idf[terms] if terms else np.zeros(0)
    return terms, (w / max(np.linalg.norm(w), 1e-300)).tolist()


def packed(rows: DataFrame, id_col: str, text: Column, words: Vocabulary) -> DataFrame:
    """key, terms, weights of each row; a text without a known term has none."""
    return packed_lists(word_lists(rows, id_col, text), words)


def packed_lists(lists: DataFrame, words: Vocabulary) -> DataFrame:
    """The same of word lists."""
    held = lists.sparkSession.sparkContext.broadcast((words.terms, words.idf, words.low, words.high, frozenset(words.stop)))
    schema = f"key {lists.schema['key'].dataType.simpleString()}, terms array<int>, weights array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, low, high, stop = held.value
        number, known = {t: i for i, t in enumerate(terms)}, {w for t in terms for w in t.split(" ")}
        for batch in batches:
            found = [weighed(grams_of(t, low, high, stop, known), number, idf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float64()))], ["key", "terms", "weights"])

    return lists.select("key", "words").mapInArrow(run, schema)


def dense_parts(batch: pa.RecordBatch, terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """Packed rows (columns 1 and 2) as dense matrices of DENSE rows, with the place of the first."""
    for at in range(0, batch.num_rows, DENSE):
        part = batch.slice(at, DENSE)
        lists = part.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        x = np.zeros((part.num_rows, terms))
        x[np.repeat(np.arange(part.num_rows), sizes), lists.flatten().to_numpy()] = part.column(2).flatten().to_numpy()
        yield at, x


def summed(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of matrices that tasks give by rows (i, z); rows x columns numbers come to the driver."""
    out = np.zeros((rows, columns))
    found = parts.groupBy("i").agg(*[F.sum(F.col("z")[c]).alias(f"z{c}") for c in range(columns)]).toPandas()
    out[found["i"].to_numpy(int)] = found[[f"z{c}" for c in range(columns)]].to_numpy(float)
    return out


def matrix_rows(z: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(z).ravel())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32)[: len(z) + 1]), flat)], ["i", "z"])


# --- truncated SVD


def added_products(z: np.ndarray, part: pa.RecordBatch) -> None:
    """Adds X'X of packed rows to z: by pairs of a row's terms, or densely where rows are long."""
    lists, terms = part.column(1), len(z)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if int((sizes * sizes).sum()) > part.num_rows * terms * terms // 64:
        for _, x in dense_parts(part, terms):
            z += x.T @ x
        return
    t, w = lists.flatten().to_numpy().astype(np.int64), part.column(2).flatten().to_numpy()
    reach = np.repeat(sizes, sizes)
    left = np.repeat(np.arange(len(t)), reach)
    right = np.arange(len(left)) + np.repeat(np.repeat(np.cumsum(sizes) - sizes, sizes) - (np.cumsum(reach) - reach), reach)
    z += np.bincount(t[left] * terms + t[right], w[left] * w[right], terms * terms).reshape(terms, terms)


def products(rows: DataFrame, terms: int) -> np.ndarray:
    """X'X of the packed rows X, summed on the tasks; terms x terms numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, any_row = np.zeros((terms, terms)), False
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                any_row = True
                added_products(z, batch.slice(at, GRAM_ROWS))
        if any_row:
            yield matrix_rows(z)

    def together(given: pa.Table) -> pa.Table:
        at = given.column("i").to_numpy()
        kinds, number = np.unique(at, return_inverse=True)
        z = np.zeros((len(kinds), terms))
        np.add.at(z, number, given.column("z").combine_chunks().flatten().to_numpy().reshape(len(at), terms))
        return pa.table({"i": kinds, "z": matrix_rows(z).column(1)})

    found = rows.select("key", "terms", "weights").mapInArrow(run, "i long, z array<double>").groupBy(F.col("i") % 64).applyInArrow(together, "i long, z array<double>").collect()
    out = np.zeros((terms, terms))
    for r in found:
        out[r["i"]] = r["z"]
    return (out + out.T) / 2


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'X block, of the packed rows X."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros_like(held.value)
        for batch in batches:
            for _, x in dense_parts(batch, len(z)):
                z += x.T @ (x @ held.value)
        yield matrix_rows(z)

    return summed(rows.mapInArrow(run, "i long, z array<double>"), *block.shape)


def truncated_svd(rows: DataFrame, terms: int, k: int, tolerance: float = 1e-7, most_turns: int = 60, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of packed rows, descending, and their right vectors (terms x k).

    Up to GRAM_TERMS terms they come from X'X, which is one pass. Else by
    block power iteration that keeps its blocks: each turn is one pass, and the best
    vectors within all blocks so far are taken, until X'X maps them to themselves
    but for ``tolerance`` of the largest value. A vector's entry of largest size is positive.
    """
    if terms <= GRAM_TERMS:
        values, v = np.linalg.eigh(products(rows, terms))
        return _turned(values[::-1][:k], v[:, ::-1][:, :k])
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.normal(size=(terms, min(terms, k + 8))))[0]
    basis, images = np.zeros((terms, 0)), np.zeros((terms, 0))
    for _ in range(most_turns):
        image = gram_times(rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, y = np.linalg.eigh((inner + inner.T) / 2)
        values, y = values[::-1][:k], y[:, ::-1][:, :k]
        v = basis @ y
        apart = np.linalg.norm(images @ y - v * values, axis=0).max()
        if apart <= tolerance * max(values[0], 1e-300) or basis.shape[1] == terms:
            break
        for _ in range(2):  # once leaves rounding errors
            image = image - basis @ (basis.T @ image)
        q, r = np.linalg.qr(image)
        fresh = np.abs(np.diag(r)) > 1e-12 * max(values[0], 1e-300)
        block = q[:, fresh][:, : terms - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            break
    return _turned(values, v)


def _turned(values: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return np.sqrt(np.maximum(values, 0)), v * np.where(turn == 0, 1, turn)


def projected(rows: DataFrame, right: np.ndarray, unit: bool = True) -> DataFrame:
    """key, vector of packed rows: X right, of length 1 if unit (zeros stay)."""
    held = rows.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in dense_parts(batch, len(held.value)):
                y = x @ held.value
                if unit:
                    norm = np.linalg.norm(y, axis=1, keepdims=True)
                    y = y / np.where(norm == 0, 1, norm)
                told = matrix_rows(y)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), told.column(1)], ["key", "vector"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, vector array<double>")


@dataclass
class Encoder:
    """One space for all texts that it was fitted on together, and for those it encodes later."""

    words: Vocabulary
    values: np.ndarray
    right: np.ndarray

    def encode(self, rows: DataFrame, id_col: str, text: Column) -> DataFrame:
        """key, vector of length 1; texts without a known term have zeros."""
        return projected(packed(rows, id_col, text, self.words), self.right)


def fitted(lists: DataFrame, max_features: int, dims: int, low: int, high: int, stop: list[str]) -> tuple[Encoder, DataFrame]:
    """S15 of word lists (key, words, told), fitted on those that are told, and the packed rows of all."""
    words = vocabulary_of(lists.where("told"), max_features, low, high, stop)
    own = written(packed_lists(lists, words), "packed-texts")
    k = min(dims, len(words.terms) - 1, words.documents - 1)
    if k < 2:
        return Encoder(words, np.ones(len(words.terms)), np.eye(len(words.terms))), own
    # Rows that are not told are blank, so they add nothing.
    return Encoder(words, *truncated_svd(own, len(words.terms), k)), own


def told_lists(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """key, words, told: whether the text is not blank."""
    own = rows.select(F.col(id_col).alias("\u0000i"), text.alias("\u0000t"))
    lists = own.select("*", F.coalesce(F.trim("\u0000t") != "", F.lit(False)).alias("told"))
    return lists.select(F.col("\u0000i").alias("key"), F.array_join(F.regexp_extract_all(F.lower("\u0000t"), F.lit(WORD), F.lit(0)), " ").alias("words"), "told")


def encoder(rows: DataFrame, id_col: str, text: Column, max_features: int = 1000, dims: int = 64, low: int = 1, high: int = 2, stop: list[str] | None = None) -> Encoder:
    """Fitted on all rows whose text is not blank, with min(dims, terms - 1, rows - 1) dimensions; with fewer than two of these, vectors are the TF-IDF weights."""
    tables = Scratch()
    lists = tables.written(told_lists(rows, id_col, text).where("told"), "word-lists")
    found = fitted(lists, max_features, dims, low, high, STOP if stop is None else stop)[0]
    tables.clear()
    return found


def encoded(rows: DataFrame, id_col: str, text: Column, max_features: int = 1000, dims: int = 64, low: int = 1, high: int = 2, stop: list[str] | None = None) -> DataFrame:
    """Key, vector of the rows that the space is fitted on, blank ones as well: as encoder() and encode(), but texts are cut into words and weighed once."""
    tables = Scratch()
    lists = tables.written(told_lists(rows, id_col, text), "word-lists")
    found, own = fitted(lists, max_features, dims, low, high, STOP if stop is None else stop)
    tables.clear()
    return projected(own, found.right)


def eval_vectors(rows: DataFrame, id_col: str, text: Column, max_features: int = 2000) -> DataFrame:
    """Key, vector: unit TF-IDF weights of single words; a blank text counts as ``_`` and has zeros."""
    plain = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("_")).otherwise(text)
    words = vocabulary(rows, plain, max_features, 1, 1)
    return projected(packed(rows, id_col, plain, words), np.eye(len(words.terms)))


def semantic_map(rows: DataFrame, id_col: str, text: Column, max_features: int = 1000) -> DataFrame:
    """Key, x, y: uncentred coordinates of texts along the two largest singular vectors; zeros with fewer than two terms."""
    words = vocabulary(rows, F.coalesce(text, F.lit("")), max_features)
    if len(words.terms) < 2:
        return rows.select(F.col(id_col).alias("key"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    tables = Scratch()
    own = tables.written(packed(rows, id_col, F.coalesce(text, F.lit("")), words), "packed-texts")
    right = truncated_svd(own, len(words.terms), 2)[1]
    return projected(own, right, unit=False).select("key", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


# --- non-negative factorization


def elbow(errors: DataFrame) -> DataFrame:
    """Grp, k: of errors (grp, k, error) by ascending k, where the second difference is largest; the first k of one or two; by the square root of their number if second differences are level."""
    order = Window.partitionBy("grp").orderBy("k")
    second = F.lead("error", 2).over(order) - 2 * F.lead("error", 1).over(order) + F.col("error")
    at = errors.select("grp", "k", second.alias("bend"), F.lead("k", 1).over(order).alias("next"))
    told = at.groupBy("grp").agg(F.count("*").alias("n"), F.min("k").alias("first"), (F.max("bend") - F.min("bend")).alias("range"), F.max(F.struct("bend", (-F.col("next")).alias("next"))).alias("best"))
    level = F.greatest(F.lit(2), F.floor(F.sqrt("n"))).cast("int")
    return told.select("grp", F.when(F.col("n") <= 2, F.col("first")).when(F.col("range") < 1e-8, level).otherwise(-F.col("best.next")).cast("int").alias("k"))


def elbow_of(errors: list[float], first: int = 2) -> int:
    """The same of one list of errors."""
    if len(errors) <= 2:
        return first
    bend = np.diff(errors, 2)
    if np.ptp(bend) < 1e-8:
        return max(2, int(math.sqrt(len(errors))))
    return first + int(bend.argmax()) + 1


def descend(w: np.ndarray, cross: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """One turn of coordinate descent on the rows of w, in place: least squares with w >= 0, given X H' and H H'. Gives how far each row was from an optimum."""
    apart = np.zeros(len(w))
    for t in range(w.shape[1]):
        slope = w @ gram[:, t] - cross[:, t]
        apart += np.abs(np.where(w[:, t] == 0, np.minimum(slope, 0), slope))
        if gram[t, t] > 0:
            w[:, t] = np.maximum(w[:, t] - slope / gram[t, t], 0)
    return apart


def begun(values: np.ndarray, right: np.ndarray, plus: np.ndarray, minus: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First H from singular vectors, their gaps at the mean; and for W the sign and factor of each left vector. plus and minus are the squared lengths of the left vectors' two parts."""
    h, sign, factor = np.zeros(right.T.shape), np.ones(len(values)), np.zeros(len(values))
    for j, v in enumerate(right.T):
        up, vp = math.sqrt(plus[j]), np.maximum(v, 0)
        un, vn = math.sqrt(minus[j]), np.maximum(-v, 0)
        part, length = vp, up
        if up * np.linalg.norm(vp) < un * np.linalg.norm(vn):
            sign[j], part, length = -1, vn, un
        size = length * np.linalg.norm(part)
        if j == 0:  # the first pair has one sign throughout, but for rounding
            h[j], sign[j], factor[j] = math.sqrt(values[0]) * np.abs(v), 0, math.sqrt(values[0])
        elif size > 0:
            root = math.sqrt(values[j] * size)
            h[j], factor[j] = root * part / np.linalg.norm(part), root / length
    h[h < 1e-6] = mean
    return h, sign, factor


def first_rows(left: np.ndarray, sign: np.ndarray, factor: np.ndarray, mean: float) -> np.ndarray:
    """First W from left vectors."""
    w = np.where(sign == 0, np.abs(left), np.maximum(sign * left, 0)) * factor
    w[w < 1e-6] = mean
    return w


def factorized(x: np.ndarray, ks: list[int], turns: int = 400, tolerance: float = 1e-4, times: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """M7 for one dense table: W, H and error of each number of aspects; times tells how often each row stands in the table."""
    # A row that comes n times is one row of sqrt(n) times its length, as are its aspects: all sums and steps stay those of the whole table.
    root = np.sqrt(np.ones(len(x)) if times is None else times)[:, None]
    mean = float((root[:, 0] ** 2 @ x).sum() / (float((root**2).sum()) * x.shape[1]))
    x = x * root
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    u, s, vt = u[:, : max(ks)], s[: max(ks)], vt[: max(ks)]
    h0, sign, factor = begun(s, vt.T, (np.maximum(u, 0) ** 2).sum(axis=0), (np.maximum(-u, 0) ** 2).sum(axis=0), mean)
    w0, out = first_rows(u / root, sign, factor, mean), {}
    for k in ks:
        h, w, first = _wide(h0, k, mean), _wide(w0.T, k, mean).T * root, None
        for _ in range(turns):
            side = h.T.copy()
            apart = (descend(w, x @ h.T, h @ h.T) * root[:, 0]).sum() + descend(side, x.T @ w, w.T @ w).sum()
            h, first = side.T, apart if first is None else first
            if first == 0 or apart / first <= tolerance:
                break
        out[k] = (w / root, h, float(np.linalg.norm(x - w @ h)))
    return out


def _wide(a: np.ndarray, k: int, mean: float) -> np.ndarray:
    """The first k rows, more of them at the mean."""
    return np.vstack([a[:k], np.full((max(k - len(a), 0), a.shape[1]), mean)])


class Factors:
    """M7 of a table of packed rows, all numbers of aspects in the same passes; W stays by row in written tables, H is on the driver."""

    def __init__(self, rows: DataFrame, terms: int, ks: list[int], turns: int = 400, tolerance: float = 1e-4) -> None:
        self.terms, self.ks, self.tables = terms, ks, Scratch()
        self.key = rows.schema["key"].dataType.simpleString()
        self.spark = rows.sparkSession
        size = rows.agg(F.count("*").alias("n"), F.sum(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)).alias("sum"), F.sum(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)).alias("squares")).first()
        self.mean, self.squares = float(size["sum"]) / (size["n"] * terms), float(size["squares"])
        values, right = truncated_svd(rows, terms, min(max(ks), terms, size["n"]))
        keep = values > 1e-9 * values[0]
        values, right = values[keep], right[:, keep]
        signs = self._sum(rows, lambda x, w: np.stack([(np.maximum(side * (x @ right) / values, 0) ** 2).sum(axis=0) for side in (1, -1)]), 2, len(values))
        h0, sign, factor = begun(values, right, signs[0], signs[1], self.mean)
        self.h = {k: _wide(h0, k, self.mean) for k in ks}
        mean = self.mean

        def start(x: np.ndarray, w: np.ndarray | None) -> np.ndarray:
            left = first_rows(x @ right / values, sign, factor, mean)
            return np.hstack([*[_wide(left.T, k, mean).T for k in ks], np.zeros((len(x), len(ks)))])

        self.state = self.tables.written(self._rows(rows, start), "aspects-start")
        first, going = {}, list(ks)
        for _ in range(turns):
            apart = self._turn(going)
            for k in list(going):
                first.setdefault(k, apart[k])
                if first[k] == 0 or apart[k] / first[k] <= tolerance:
                    going.remove(k)
            if not going:
                break

    def _rows(self, rows: DataFrame, work: Callable[[np.ndarray, np.ndarray | None], np.ndarray]) -> DataFrame:
        """rows with w = work(x, w), for dense parts x; w holds the aspects of all numbers tried, then how far each was from an optimum."""
        terms, has = self.terms, "w" in rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in dense_parts(batch, terms):
                    part = batch.slice(at, len(x))
                    new = work(x, _matrix(part) if has else None)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), matrix_rows(new).column(1)], ["key", "terms", "weights", "w"])

        return rows.mapInArrow(run, f"key {self.key}, terms array<int>, weights array<double>, w array<double>")

    def _sum(self, rows: DataFrame, work: Callable[[np.ndarray, np.ndarray | None], np.ndarray], height: int, width: int) -> np.ndarray:
        """The sum of work(x, w), height x width, over all dense parts."""
        terms, has = self.terms, "w" in rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for batch in batches:
                for at, x in dense_parts(batch, terms):
                    total += work(x, _matrix(batch.slice(at, len(x))) if has else None)
            yield matrix_rows(total)

        return summed(rows.mapInArrow(run, "i long, z array<double>"), height, width)

    def _places(self) -> dict[int, slice]:
        ends = np.cumsum(self.ks)
        return {k: slice(int(e) - k, int(e)) for k, e in zip(self.ks, ends)}

    def _turn(self, going: list[int]) -> dict[int, float]:
        """One turn for the numbers of aspects that still go on: W by row, then H from the sums W'X and W'W."""
        places, ks, width, terms, most = self._places(), self.ks, sum(self.ks), self.terms, max(self.ks)
        h = {k: self.h[k] for k in going}

        def rows_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            w = w.copy()
            for k in going:
                own = w[:, places[k]].copy()
                w[:, width + ks.index(k)] = descend(own, x @ h[k].T, h[k] @ h[k].T)
                w[:, places[k]] = own
            return w

        def sums_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            # Rows: the terms, as many as the most aspects, and one for how far W was from an optimum.
            out = np.zeros((terms + most + 1, width))
            out[:terms], out[-1, : len(ks)] = x.T @ w[:, :width], w[:, width:].sum(axis=0)
            for k in ks:
                out[terms : terms + k, places[k]] = w[:, places[k]].T @ w[:, places[k]]
            return out

        new = self.tables.written(self._rows(self.state, rows_of), "aspects-turn")
        self.tables.clear(self.state)
        self.state, self.total, out = new, self._sum(new, sums_of, terms + most + 1, width), {}
        for k in going:
            side = self.h[k].T.copy()
            out[k] = float(self.total[-1, ks.index(k)] + descend(side, *self._products(k)).sum())
            self.h[k] = side.T
        return out

    def _products(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """X'W and W'W of one number of aspects."""
        place = self._places()[k]
        return self.total[: self.terms, place], self.total[self.terms : self.terms + k, place]

    def errors(self) -> dict[int, float]:
        """Of each number of aspects, from sums alone: |X|^2 - 2 <X'W, H'> + <W'W, H H'>."""
        out = {}
        for k in self.ks:
            cross, gram = self._products(k)
            out[k] = math.sqrt(max(self.squares - 2 * float((cross * self.h[k].T).sum()) + float((gram * (self.h[k] @ self.h[k].T)).sum()), 0))
        return out

    def weights(self, k: int) -> DataFrame:
        """key, w of one number of aspects."""
        place = self._places()[k]
        return self.state.select("key", F.slice("w", place.start + 1, k).alias("w"))


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column(3).flatten().to_numpy().reshape(part.num_rows, -1)


def tried(n: int, most: int) -> list[int]:
    """Numbers of aspects that n texts try."""
    ks = list(range(2, min(most + 1, n // 2 + 1, MOST_ASPECTS + 1)))
    return ks if len(ks) >= 2 else [2]


def aspect_label(h: np.ndarray, terms: list[str], most: int = 4) -> str:
    """The terms of largest weight, ties by term."""
    return " / ".join(terms[i] for i in np.lexsort((np.arange(len(h)), -h))[:most])


def local_vocabulary(texts: list[list[str]], max_features: int, times: list[int] | None = None) -> tuple[list[str], np.ndarray]:
    """As vocabulary(), of token lists at hand, each of which stands for so many rows."""
    counts, df = Counter(), Counter()
    times = [1] * len(texts) if times is None else times
    for own, n in zip(texts, times):
        for term, c in Counter(own).items():
            counts[term] += c * n
            df[term] += n
    terms = sorted(sorted(counts, key=lambda t: (-counts[t], t))[:max_features])
    return terms, np.array([math.log((1 + sum(times)) / (1 + df[t])) + 1 for t in terms])


def kinds_of_texts(rows: DataFrame, grp: str, row: str, text: str, stop: list[str]) -> DataFrame:
    """grp, text, row, n, t: each group's different texts with their first row, number of rows and tokens."""
    kinds = rows.groupBy(grp, text).agg(F.min(row).alias(row), F.count("*").alias("n"))
    return kinds.withColumn("t", tfidf.grams(F.col(text), 1, 2, stop=stop))


def large_groups(kinds: DataFrame, grp: str, tokens: str, max_features: int, local_rows: int) -> list:
    """Groups of different texts with too many of them, and too many cells, for one task; kinds has a row for each text."""
    sizes = kinds.groupBy(grp).agg(F.count("*").alias("k")).where(F.col("k") > local_rows)
    many = [r[grp] for r in sizes.collect()]
    if not many:
        return []
    own = kinds.where(F.col(grp).isin([m for m in many if m is not None]) | (F.col(grp).isNull() if None in many else F.lit(False)))
    terms = own.select(grp, F.explode(tokens).alias("term")).distinct().groupBy(grp).agg(F.count("*").alias("terms"))
    cells = own.groupBy(grp).agg(F.count("*").alias("k")).alias("a").join(terms.alias("b"), F.col(f"a.{grp}").eqNullSafe(F.col(f"b.{grp}")), "left")
    wide = F.col("k") * F.least(F.coalesce("terms", F.lit(0)), F.lit(max_features)) > 3 * local_rows**2
    return sorted((r[grp] for r in cells.where(wide).select(F.col(f"a.{grp}").alias(grp)).collect()), key=lambda g: (g is not None, g))


def dense_texts(texts: list[list[str]], terms: list[str], idf: np.ndarray) -> np.ndarray:
    x, number = np.zeros((len(texts), len(terms))), {t: i for i, t in enumerate(terms)}
    for i, own in enumerate(texts):
        at, w = weighed(own, number, idf)
        x[i, at] = w
    return x


ASPECTS = "grp string, k int, aspect int, label string, terms array<string>, h array<double>"


def aspects(rows: DataFrame, grp: str, row: str, text: Column, most: int = 10, max_features: int = 3000, stop: list[str] | None = None, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """M7 of each group of rows (row unique in it): the aspects (grp, k, aspect, label, terms, h) and (grp, row, w), k by the elbow of errors.

    Groups of up to local_rows different texts, or three times local_rows squared cells, are one task's work each, many of them at once;
    larger ones go through passes over all tasks, one group after another. A group
    without terms has no aspects and no rows in either table.
    """
    stop = STOP if stop is None else stop
    tables = Scratch()
    own = rows.select(F.col(grp).cast("string").alias("grp"), F.col(row).cast("long").alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    texts = tables.written(kinds_of_texts(own, "grp", "row", "text", stop), "aspect-texts")
    large = large_groups(texts, "grp", "t", max_features, local_rows)
    inside = F.exists(F.array(*[F.lit(g).cast("string") for g in large]), lambda g: g.eqNullSafe(F.col("grp"))) if large else F.lit(False)
    few = texts.where(~inside)
    lists = pa.list_(pa.float64())
    kinds = pa.schema([("grp", pa.string()), ("text", pa.string()), ("w", lists), ("k", pa.int32()), ("aspect", pa.int32()), ("label", pa.string()), ("terms", pa.list_(pa.string())), ("h", lists)])

    def one(given: pa.Table) -> pa.Table:
        given = given.sort_by("row")
        texts, name, times = given.column("t").to_pylist(), given.column("grp")[0].as_py(), given.column("n").to_pylist()
        terms, idf = local_vocabulary(texts, max_features, times)
        if not terms:
            return kinds.empty_table()
        ks = tried(sum(times), most)
        made = factorized(dense_texts(texts, terms, idf), ks, times=np.array(times, float))
        k = elbow_of([made[c][2] for c in ks], ks[0])
        k = k if k in made else ks[0]
        w, h, _ = made[k]
        out = [{"grp": name, "text": t, "w": w[i]} for i, t in enumerate(given.column("text").to_pylist())]
        out += [{"grp": name, "k": k, "aspect": a, "label": aspect_label(h[a], terms), "terms": terms, "h": h[a]} for a in range(k)]
        return pa.Table.from_pylist(out, kinds)

    schema = "grp string, text string, w array<double>, k int, aspect int, label string, terms array<string>, h array<double>"
    told = tables.written(few.groupBy("grp").applyInArrow(one, schema), "aspects")
    found = told.where("aspect IS NOT NULL").select("grp", "k", "aspect", "label", "terms", "h")
    each = told.where("aspect IS NULL").select(F.col("grp").alias("\u0000g"), F.col("text").alias("\u0000t"), "w")
    weights = own.join(each, F.col("grp").eqNullSafe(F.col("\u0000g")) & (F.col("text") == F.col("\u0000t"))).select("grp", "row", "w")
    spark = rows.sparkSession
    for name in large:
        mine = own.where(F.col("grp").eqNullSafe(F.lit(name)))
        words = vocabulary(mine, F.col("text"), max_features, stop=stop)
        if not words.terms:
            continue
        ks = tried(words.documents, most)
        made = Factors(tables.written(packed(mine, "row", F.col("text"), words), "packed-group"), len(words.terms), ks)
        errors = made.errors()
        k = elbow_of([errors[c] for c in ks], ks[0])
        k = k if k in errors else ks[0]
        lines = [(name, k, a, aspect_label(made.h[k][a], words.terms), words.terms, made.h[k][a].tolist()) for a in range(k)]
        found = found.union(spark.createDataFrame(lines, ASPECTS))
        weights = weights.union(made.weights(k).select(F.lit(name).alias("grp"), F.col("key").alias("row"), "w"))
    return found, weights


def aspect_vectors(rows: DataFrame, grp: str, row: str, text: Column, found: DataFrame, stop: list[str] | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """M9: grp, row, aspect, terms, weights: each text's TF-IDF weights times an aspect's, of length 1 (a text without its terms has none); found comes from aspects() on the same rows.

    A group's aspects (at most MOST_ASPECTS of them over its vocabulary) meet its texts in one row each.
    """
    stop = STOP if stop is None else stop
    own = rows.select(F.col(grp).cast("string").alias("grp"), F.col(row).cast("long").alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    kinds = written(kinds_of_texts(own, "grp", "row", "text", stop), "vector-texts")
    pairs = kinds.select("grp", "text", F.col("n").alias("rows"), F.explode("t").alias("term")).groupBy("grp", "text", "rows", "term").agg(F.count("*").alias("tf"))
    n = kinds.groupBy("grp").agg(F.sum("n").alias("n"))
    df = pairs.groupBy("grp", "term").agg(F.sum("rows").alias("df")).join(n, "grp")
    idf = df.select("grp", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    loads = found.select("grp", "aspect", F.explode(F.arrays_zip("terms", "h")).alias("x")).select("grp", "aspect", F.col("x.terms").alias("term"), F.col("x.h").alias("h")).where("h > 0")
    known = idf.join(loads, ["grp", "term"]).select("grp", "term", "aspect", (F.col("idf") * F.col("h")).alias("load"))
    told = pairs.join(known, ["grp", "term"]).select("grp", "text", "aspect", "term", (F.col("tf") * F.col("load")).alias("w"))
    lists = told.groupBy("grp", "text", "aspect").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    each = lists.select("grp", "text", "aspect", F.col("x.term").alias("terms"), F.transform("x.w", lambda w: w / F.col("norm")).alias("weights"))
    return own.join(each, ["grp", "text"]).select("grp", "row", "aspect", "terms", "weights")
