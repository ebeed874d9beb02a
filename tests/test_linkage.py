"""Average linkage against SciPy-free brute force: small groups in one task, large ones in rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import linkage


def plain_average(x, families, factor, k):
    """Clusters of rows by merging the nearest pair of mean distance, from all pairs each time."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
    d = 1 - u @ u.T
    for i in range(len(x)):
        for j in range(len(x)):
            if families[i] and families[i] == families[j]:
                d[i, j] *= factor
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        _, a, b = min((round(float(d[np.ix_(p, q)].mean()), 12), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
        parts[a] += parts.pop(b)
    return sorted(sorted(p) for p in parts)


def groups_of(found):
    out = {}
    for r in found:
        out.setdefault((r.grp, r.cluster), []).append(r.id)
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for grp, n in (("a", 40), ("b", 7), ("c", 1), (None, 5), ("d", 2)):
        x = rng.normal(size=(n, 5)) + 2 * rng.integers(0, 2, size=(n, 5))
        if n > 6:
            x[3] = 0
        rows += [(grp, i, v.tolist(), random.Random(i * n).choice(["", "f", "g", None])) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "grp string, row long, vector array<double>, family string")


@pytest.mark.parametrize("local", [1000, 3])
@pytest.mark.parametrize("factor", [1.0, 0.8])
def test_family_clusters(vectors, local, factor, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 9)
    rows, table = vectors
    found = linkage.family_clusters(table.where("grp IS NOT NULL"), "grp", "row", "vector", F.col("family"), most=8, factor=factor, local=local).collect()
    got = groups_of(found)
    for grp in "abcd":
        own = [r for r in rows if r[0] == grp]
        k = min(8, max(2, len(own) // 3), len(own))
        want = plain_average(np.array([r[2] for r in own]), [r[3] for r in own], factor, k)
        assert sorted(sorted(ids) for (g, _), ids in got.items() if g == grp) == want
        assert sorted({c for g, c in got if g == grp}) == list(range(len(want)))


def plain_silhouette(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    out = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if labels[j] == labels[i] and j != i]
        others = [np.mean([d[i, j] for j in range(len(x)) if labels[j] == c]) for c in set(labels) - {labels[i]}]
        a, b = (np.mean(d[i, own]), min(others)) if own else (0, 0)
        out.append((b - a) / max(a, b, 1e-12) if own else 0)
    return float(np.mean(out))


@pytest.mark.parametrize("local", [1000, 4])
def test_best_clusters(spark, local):
    rng = np.random.default_rng(8)
    centres = np.eye(4)[:3] * 4
    x = np.concatenate([c + rng.normal(scale=0.6, size=(9, 4)) for c in centres])
    table = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)] + [("two", 0, [1.0, 0.0]), ("two", 1, [0.0, 1.0])], "grp string, row long, vector array<double>")
    found = linkage.best_clusters(table, "grp", "row", "vector", local=local).collect()
    assert {r.grp for r in found} == {"g"}
    labels = [r.cluster for r in sorted(found, key=lambda r: r.id)]
    scores = {}
    for k in range(2, 7):
        parts = plain_average(x, [""] * len(x), 1.0, k)
        scores[k] = plain_silhouette(x, [next(c for c, p in enumerate(parts) if i in p) for i in range(len(x))])
    best = max(scores, key=lambda k: (round(scores[k], 12), -k))
    assert found[0].k == best and abs(found[0].score - scores[best]) < 1e-9 and len(set(labels)) == best


def test_text_clusters(spark):
    rows = [("g", i, f"memory span task {i % 2}" if i < 6 else "reaction speed trial") for i in range(12)] + [("h", 20, "alone here"), ("e", 30, ""), ("e", 31, None)]
    table = spark.createDataFrame(rows, "grp string, row long, text string")
    found = {r.id: (r.cluster, r.label) for r in linkage.text_clusters(table, "grp", "row", F.col("text"), most=2).collect()}
    assert len(found) == len(rows) and found[20][1] == "" and found[0][1] in ("Memory", "Memory Span") and found[7][1].startswith("Reaction") and found[0][0] != found[7][0]
    assert {found[i][1] for i in (30, 31)} == {"Group 1", "Group 2"}


def test_phrase_roles(spark):
    kinds = {"total errors": [1, 0.1, 0], "mean errors": [1, 0, 0.1], "four boxes": [0, 1, 0.1], "six boxes": [0.1, 1, 0], "odd": [0, 0, 1]}
    rows = [("g", i) for i in range(8)] + [("few", i) for i in range(3)]
    phrases = [("g", i, ["total errors", "mean errors"][i % 2]) for i in range(6)] + [("g", i, ["four boxes", "six boxes"][i // 3]) for i in range(6)] + [("g", 0, "mean errors"), ("g", 7, "odd")] + [("few", 0, "total errors")]
    roles, assigned = linkage.phrase_roles(spark.createDataFrame(rows, "grp string, row long"), spark.createDataFrame(phrases, "grp string, row long, phrase string"), spark.createDataFrame([(p, [float(c) for c in v]) for p, v in kinds.items()], "phrase string, vector array<double>"))
    found = {r.role: r.phrases for r in roles.collect()}
    assert sorted(found.values()) == [["four boxes", "six boxes"], ["mean errors", "total errors"]]
    got = {(r.row, r.role): r.phrase for r in assigned.collect()}
    errors = next(r for r, p in found.items() if "mean errors" in p)
    assert got[(0, errors)] == "total errors" and len(got) == 12 and {r.grp for r in assigned.collect()} == {"g"}


def test_rows_of_one_vector_begin_as_one_cluster(spark):
    from thicket.operators import linkage as own

    texts = {"a": [1.0, 0.0], "b": [0.9, 0.2], "c": [0.0, 1.0], "d": [0.1, 1.0], "z": [0.0, 0.0]}
    groups = {"g": "abcdabcdab", "h": "aaaaaac", "i": "z", "j": "zzzaab", "k": "aaaaaaaaa"}
    rows = [(g, 100 * n + i, s) for n, (g, own_rows) in enumerate(groups.items()) for i, s in enumerate(own_rows)]
    table = spark.createDataFrame(rows, "grp string, id long, same string")
    vectors = spark.createDataFrame(list(texts.items()), "same string, vector array<double>")
    for local in (1000, 2):
        found = {(r.grp, r.id): r.cluster for r in own.equal_clusters(table, vectors, most=3, local=local).collect()}
        plain = {(r.grp, r.id): r.cluster for r in own.family_clusters(table.join(vectors, "same"), "grp", "id", "vector", most=3, local=local).collect()}
        assert len(found) == len(rows)
        assert {k: c for k, c in found.items() if k[0] in "gi"} == {k: c for k, c in plain.items() if k[0] in "gi"}
        assert [found["h", 100 + i] for i in range(7)] == [0, 0, 0, 0, 0, 0, 1]
        # Fewer vectors than clusters: the last rows stand alone.
        assert [found["k", 400 + i] for i in range(9)] == [0] * 7 + [1, 2]
    spread = own.equal_clusters(table, vectors, most=3).where("grp = 'j'")
    assert spread.count() == 6 and spread.select("cluster").distinct().count() == 2


def test_clusters_are_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage.Scratch, "written", lambda self, df, name, write=linkage.Scratch.written: seen.setdefault(name, write(self, df, name)) if name == "linkage-large" else write(self, df, name))
    seen, sent = {}, []
    monkeypatch.setattr(linkage, "nearest", lambda state, blocks, factor: sent.extend(r.blocks for r in blocks.collect()) or 1 / 0)
    state = linkage.clusters_of(spark.range(6000).select(F.lit("g").alias("grp"), F.col("id").alias("row"), F.array(F.lit(1.0), F.rand(1)).alias("v")), "grp", "row", "v")
    with pytest.raises(ZeroDivisionError):
        linkage.merges(state)
    assert sent == [4]
