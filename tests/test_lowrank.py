"""Truncated SVD, encoders and aspects against NumPy on dense tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import lowrank, tfidf

TEXTS = ["total errors of boxes", "mean errors of boxes", "median latency of responses", "mean latency of responses", "total latency", "boxes visited twice", None, "", "!!", "the of and"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [("g", i, t) for i, t in enumerate(TEXTS * 3)] + [("h", 100, "only one row here"), ("e", 101, None), (None, 102, "total errors"), (None, 103, "mean errors")]
    return spark.createDataFrame(rows, "grp string, row long, text string").repartition(3).cache()


def dense(packed, terms):
    rows = sorted(packed.collect(), key=lambda r: r.key)
    x = np.zeros((len(rows), terms))
    for i, r in enumerate(rows):
        x[i, r.terms] = r.weights
    return x


def test_vocabulary_and_weights(table):
    words = lowrank.vocabulary(table, F.col("text"), 5)
    assert words.terms == sorted(words.terms) and len(words.terms) == 5 and "latency" in words.terms and words.documents == table.count()
    n = sum("latency" in (t or "") for t in TEXTS) * 3
    assert abs(words.idf[words.terms.index("latency")] - (math.log((1 + words.documents) / (1 + n)) + 1)) < 1e-12
    x = dense(lowrank.packed(table, "row", F.col("text"), words), 5)
    norm = np.linalg.norm(x, axis=1)
    assert len(x) == table.count() and set(np.round(norm, 9)) <= {0.0, 1.0}
    assert lowrank.vocabulary(table.limit(0), F.col("text"), 5).terms == []


@pytest.mark.parametrize("k", [2, 6, 40])
def test_singular_values_are_numpys(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0")
    words = lowrank.vocabulary(docs, F.col("text"), 200)
    rows = lowrank.packed(docs, "doc_id", F.col("text"), words).cache()
    x = dense(rows, 200)
    values, right = lowrank.truncated_svd(rows, 200, k)
    assert np.abs(values - np.linalg.svd(x, compute_uv=False)[:k]).max() < 1e-6
    assert np.abs(right.T @ right - np.eye(k)).max() < 1e-8 and np.abs(x.T @ (x @ right) - right * values**2).max() < 1e-6


def test_encoder(table):
    found = lowrank.encoder(table, "row", F.col("text"), dims=4)
    vectors = {r.key: np.array(r.vector) for r in found.encode(table, "row", F.col("text")).collect()}
    assert len(vectors) == table.count() and len(vectors[0]) == 4
    assert np.allclose(vectors[0], vectors[len(TEXTS)]) and abs(np.linalg.norm(vectors[0]) - 1) < 1e-9 and not vectors[6].any() and not vectors[9].any()
    few = lowrank.encoder(table.where("row = 100"), "row", F.col("text"))
    assert len(few.values) == len(few.words.terms)


def test_eval_vectors_and_map(table):
    found = {r.key: np.array(r.vector) for r in lowrank.eval_vectors(table, "row", F.col("text")).collect()}
    assert not found[6].any() and not found[8].any() and abs(found[0] @ found[10] - 1) < 1e-9 and 0 < found[0] @ found[1] < 1
    words = lowrank.vocabulary(table, F.coalesce(F.col("text"), F.lit("")), 1000)
    x = dense(lowrank.packed(table, "row", F.coalesce(F.col("text"), F.lit("")), words), len(words.terms))
    points = np.array([(r.x, r.y) for r in sorted(lowrank.semantic_map(table, "row", F.col("text")).collect(), key=lambda r: r.key)])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * s[:2]
    assert np.allclose(np.abs(points), np.abs(want), atol=1e-6)
    assert [(r.x, r.y) for r in lowrank.semantic_map(table.where("row = 101"), "row", F.col("text")).collect()] == [(0.0, 0.0)]


def test_elbow(spark):
    lists = {"a": [9.0, 5.0, 4.5, 4.2, 4.1], "b": [9.0, 8.0, 7.0, 6.0], "c": [3.0], "d": [3.0, 2.0], "e": [9.0, 8.0, 2.0, 1.9, 1.8], "f": [4.0, 3.0, 1.0]}
    rows = [(g, k, e) for g, own in lists.items() for k, e in enumerate(own, 2)]
    found = {r.grp: r.k for r in lowrank.elbow(spark.createDataFrame(rows, "grp string, k int, error double")).collect()}
    assert found == {g: lowrank.elbow_of(own) for g, own in lists.items()}
    assert found["a"] == 3 and found["c"] == 2 and found["e"] == 4


def test_factors_lower_the_error():
    rng = np.random.default_rng(3)
    x = np.maximum(rng.random((30, 3)) - 0.4, 0) @ np.maximum(rng.random((3, 12)) - 0.4, 0)
    made = lowrank.factorized(x, [1, 2, 3, 4])
    errors = [made[k][2] for k in (1, 2, 3, 4)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.02 * np.linalg.norm(x)
    assert all((w >= 0).all() and (h >= 0).all() for w, h, _ in made.values())


def test_aspects_in_passes_equal_those_of_one_task(table):
    found, weights = lowrank.aspects(table, "grp", "row", F.col("text"), most=4)
    spread, own = lowrank.aspects(table, "grp", "row", F.col("text"), most=4, local_rows=9)
    one, other = ({(r.grp, r.aspect): r for r in t.collect()} for t in (found, spread))
    assert one.keys() == other.keys() and {g for g, _ in one} == {"g", "h", None}
    for key, r in one.items():
        assert r.label == other[key].label and r.terms == other[key].terms and np.allclose(r.h, other[key].h, atol=1e-8)
    a, b = ({(r.grp, r.row): r.w for r in t.collect()} for t in (weights, own))
    assert a.keys() == b.keys() and len(a) == 33 and all(np.allclose(a[k], b[k], atol=1e-8) for k in a)
    assert lowrank.aspects(table.limit(0), "grp", "row", F.col("text"))[0].count() == 0


def test_aspect_vectors(table):
    own = table.where("grp = 'g'")
    found, _ = lowrank.aspects(own, "grp", "row", F.col("text"), most=4)
    h = {r.aspect: dict(zip(r.terms, r.h)) for r in found.collect()}
    words = lowrank.vocabulary(own, F.coalesce(F.col("text"), F.lit("")), 3000)
    x = dense(lowrank.packed(own, "row", F.coalesce(F.col("text"), F.lit("")), words), len(words.terms))
    got = {(r.row, r.aspect): dict(zip(r.terms, r.weights)) for r in lowrank.aspect_vectors(own, "grp", "row", F.col("text"), found).collect()}
    for row in range(len(TEXTS)):
        for a, loads in h.items():
            v = x[row] * np.array([loads[t] for t in words.terms])
            norm = np.linalg.norm(v)
            want = {t: c / norm for t, c in zip(words.terms, v) if c > 0} if norm else {}
            mine = got.get((row, a), {})
            assert mine.keys() == want.keys() and all(abs(mine[t] - want[t]) < 1e-9 for t in want)


def test_a_row_that_comes_often_is_one_row_with_its_number():
    rng = np.random.default_rng(5)
    x, times = np.maximum(rng.random((12, 9)) - 0.5, 0), rng.integers(1, 6, 12)
    made, want = lowrank.factorized(x, [2, 3], times=times.astype(float)), lowrank.factorized(np.repeat(x, times, axis=0), [2, 3])
    for k in (2, 3):
        assert np.allclose(made[k][1], want[k][1], atol=1e-8) and abs(made[k][2] - want[k][2]) < 1e-8
        assert np.allclose(np.repeat(made[k][0], times, axis=0), want[k][0], atol=1e-8)


def test_copies_of_texts_are_one_tasks_work_and_equal_the_passes(table):
    copies = table.where("grp = 'g'").select("grp", F.explode(F.array(*[F.col("row") + 1000 * i for i in range(4)])).alias("row"), "text")
    kinds = lowrank.kinds_of_texts(copies.withColumn("text", F.coalesce("text", F.lit(""))), "grp", "row", "text", lowrank.STOP)
    assert kinds.count() == 9 and lowrank.large_groups(kinds, "grp", "t", 3000, 9) == [] and lowrank.large_groups(kinds, "grp", "t", 3000, 3) == ["g"]
    one, weights = lowrank.aspects(copies, "grp", "row", F.col("text"), most=4)
    other, spread = lowrank.aspects(copies, "grp", "row", F.col("text"), most=4, local_rows=3)
    one, other = sorted(one.collect(), key=lambda r: r.aspect), sorted(other.collect(), key=lambda r: r.aspect)
    assert [r.label for r in one] == [r.label for r in other] and all(np.allclose(a.h, b.h, atol=1e-8) for a, b in zip(one, other))
    a, b = ({r.row: r.w for r in t.collect()} for t in (weights, spread))
    assert len(a) == 120 and a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-8) for k in a)


def test_products_take_one_pass(table, monkeypatch):
    words = lowrank.vocabulary(table, F.coalesce(F.col("text"), F.lit("")), 1000)
    rows = lowrank.packed(table, "row", F.coalesce(F.col("text"), F.lit("")), words)
    x = dense(rows, len(words.terms))
    monkeypatch.setattr(lowrank, "gram_times", None)  # the turns of power iteration
    assert np.abs(lowrank.products(rows, len(words.terms)) - x.T @ x).max() < 1e-12
    values, right = lowrank.truncated_svd(rows, len(words.terms), 3)
    assert np.abs(values - np.linalg.svd(x, compute_uv=False)[:3]).max() < 1e-9


def test_texts_are_cut_once_and_common_terms_are_those_of_all_terms(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)] + ["the", "ä_1", "x²y", "Über"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=np.arange(44, 0, -1) / 990)) + rng.choice(["", ". A b", " the the"]) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "  ", "unseen"])], "id long, t string")
    made = rows.select(tfidf.grams(F.col("t"), 1, 2, stop=["the"]).alias("g")).collect()
    tf, df = Counter(t for r in made for t in r.g or []), Counter(t for r in made for t in set(r.g or []))
    seen, before = [], lowrank.gram_counts
    monkeypatch.setattr(lowrank, "gram_counts", lambda *a: seen.append(a[4]) or before(*a))
    for most in (5, 25, 1000):
        found = lowrank.vocabulary(rows, F.col("t"), most, stop=["the"])
        want = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:most])
        assert found.terms == want and found.documents == 63 and np.allclose(found.idf, [np.log(64 / (1 + df[t])) + 1 for t in want])
    assert 5 <= len(seen[0]) < 25 and seen[2] is None  # n-grams of rare words are not counted where they can't be among the commonest
    first = lowrank.encoder(rows, "id", F.col("t"), 25, 8).encode(rows, "id", F.col("t")).collect()
    second = {r.key: r.vector for r in lowrank.encoded(rows, "id", F.col("t"), 25, 8).collect()}
    assert len(first) == len(second) == 63 and all(np.allclose(r.vector, second[r.key], atol=1e-9) for r in first) and not any(second[60])
