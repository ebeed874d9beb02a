"""Width expansion against moving leaves one by one with frozen centroids."""

import numpy as np
import pytest

from thicket.operators import expand
from thicket.operators.tree import Tree, ordered


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def below(kids, kinds, node):
    out = []
    for c in kids.get(node, []):
        out += [c] if kinds[c] == "attribute" else below(kids, kinds, c)
    return list(dict.fromkeys(out))


def plain(kinds, links, vectors, margin, passes):
    """Parents of leaves after each pass, from the definition: centroids anew each time."""
    parent = {c: p for p, c in links if kinds[c] == "attribute"}
    inner = [(p, c) for p, c in links if kinds[c] != "attribute"]
    groups = sorted({p for p in parent.values() if kinds[p] == "aggregation"})
    moves = []
    for _ in range(passes):
        kids = {}
        for p, c in inner + [(p, c) for c, p in parent.items()]:
            kids.setdefault(p, []).append(c)
        own = {g: [vectors[i] for i in below(kids, kinds, g) if i in vectors] for g in groups}
        centre = {g: unit(np.mean(v, axis=0)) for g, v in own.items() if v}
        if len(centre) < 2:
            moves.append(0)
            break
        order, new = sorted(centre), dict(parent)
        for i, v in vectors.items():
            if parent[i] not in centre:
                continue
            sims = [round(float(centre[g] @ v), 9) for g in order]
            best = int(np.argmax(sims))
            if order[best] != parent[i] and sims[best] > round(float(centre[parent[i]] @ v), 9) + margin:
                new[i] = order[best]
        moves.append(sum(new[i] != parent[i] for i in parent))
        parent = new
        if not moves[-1]:
            break
    return parent, moves


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 100)])
def test_passes_equal_the_definition(spark, monkeypatch, seed, block):
    monkeypatch.setattr(expand, "BLOCK_BYTES", block)
    rng = np.random.default_rng(seed)
    kinds = {0: "root", **{i: "aggregation" for i in range(1, 8)}}
    links = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (2, 7)]
    centres, vectors = rng.normal(size=(4, 6)), {}
    for i in range(100, 180):
        kinds[i] = "attribute"
        node = int(rng.choice([1, 3, 4, 5, 6]))  # 2 has no leaves of its own, 7 none at all
        links.append((node, i))
        if i % 9:
            vectors[i] = unit(centres[rng.integers(4)] + rng.normal(scale=0.4, size=6))
    vectors[100 + 8] = np.zeros(6)
    rows = [(i, (v * 3).tolist()) for i, v in vectors.items()] + [(3, [1.0] * 6), (109 if 109 not in vectors else 999, None)]
    tree = Tree(spark.createDataFrame([(i, f"n{i}", k) for i, k in kinds.items()], "id long, name string, type string"), ordered(spark.createDataFrame(links, "parent long, child long")))
    for passes in (1, 3):
        found = expand.expanded(tree, spark.createDataFrame(rows, "id long, vector array<double>"), passes=passes)
        parent, moves = plain(kinds, links, vectors, 0.02, passes)
        got = {e.child: e.parent for e in found.tree.edges.collect()}
        assert found.moves == moves and moves[0] > 5
        assert {c: p for c, p in got.items() if kinds[c] == "attribute"} == parent
        assert {(p, c) for c, p in got.items() if kinds[c] != "attribute"} == {(p, c) for p, c in links if kinds[c] != "attribute"}
    report = {r.node: r for r in found.coherence.collect()}
    own = {}
    for i, p in parent.items():
        if i in vectors:
            own.setdefault(p, []).append(vectors[i])
    for node, r in report.items():
        v = np.array(own.get(node, []))
        assert (r.after is None) == (len(v) < 2) and (r.after is None or r.n_after == len(v))
        if r.after is not None:
            sims = (v @ v.T)[np.triu_indices(len(v), 1)]
            assert abs(r.after - sims.mean()) < 6e-4 and r.incoherent == (sims.mean() < 0.25)


def test_one_group_stays(spark):
    tree = Tree(spark.createDataFrame([(0, "r", "root"), (1, "a", "aggregation"), (2, "x", "attribute")], "id long, name string, type string"), ordered(spark.createDataFrame([(0, 1), (1, 2)], "parent long, child long")))
    found = expand.expanded(tree, spark.createDataFrame([(2, [1.0])], "id long, vector array<double>"))
    assert found.moves == [0] and sorted((e.parent, e.child) for e in found.tree.edges.collect()) == [(0, 1), (1, 2)]
