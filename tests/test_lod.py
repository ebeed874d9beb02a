"""The level-of-detail builder and prefix factoring, held against plain recursive versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import cluster, linkage, lod, lowrank, slots, tree
from thicket.operators.tree import Tree, ordered


def dictionary():
    """108 rows of six groups: a slotted one, a loose one, small ones, one without a path, and one of a single row."""
    rng, rows = random.Random(3), []
    for measure in ("total errors", "mean latency", "span length"):
        for boxes in ("4 boxes", "6 boxes", "8 boxes"):
            rows += [("DMS > Standard", f"{measure} u{len(rows)}{i} {boxes} x{len(rows)}{i}") for i in range(3)]
    themes = (["memory", "recall", "digits"], ["reaction", "speed", "button"], ["pattern", "paired", "shapes"])
    rows += [("PAL", " ".join(rng.sample(t, 2)) + f" t{i % 4}") for t in themes for i in range(16)]
    rows += [("MOT > Clinical", t) for t in ("alpha beta", "alpha beta words", "gamma delta", "gamma delta thing", "gamma delta")]
    rows += [(None, "no group at all"), ("", "empty group"), ("Solo", "just one"), ("DMS", "above the others"), ("RVP", None), ("RVP", "")]
    rows += [("SWM", f"trial {w}") for w in ("a", "b")] + [("PRM > Long Name", f"item number {i}") for i in range(19)]
    rows += [("dup", "same text here")] * 2
    return [(i, f"v{i}", g, t) for i, (g, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(dictionary(), "row long, label string, grp string, text string").withColumn("id", F.lit("x")).repartition(3)


def leaf_paths(t: Tree) -> dict[int, list[int]]:
    """Row and ids of the nodes above each leaf, from the root."""
    parent = {}
    for e in t.edges.collect():
        assert e.child not in parent
        parent[e.child] = e.parent
    out = {}
    for n in t.nodes.where("type = 'attribute'").collect():
        assert n.row not in out
        out[n.row], at = [], n.id
        while at in parent:
            at = parent[at]
            out[n.row].insert(0, at)
    return out


@pytest.fixture(scope="module")
def built(rows):
    return lod.build(rows, "all")


def test_every_row_is_one_leaf_below_its_group(built):
    nodes = {n.id: n for n in built.nodes.collect()}
    paths = leaf_paths(built)
    assert sorted(paths) == [i for i, *_ in dictionary()] and len(nodes) == len({n.id for n in nodes.values()})
    assert all(p[0] == tree.ROOT for p in paths.values())
    for i, _, group, _ in dictionary():
        names = [nodes[n].name for n in paths[i][1:]]
        want = (group or "Ungrouped").split(" > ")
        assert [n.split(" — ")[0] for n in names[: len(want)]] == want, (i, names)
    inner = [n for n in nodes.values() if n.type == "aggregation"]
    assert all(n.route for n in inner) and {"group_anchor", "slot_mining", "aspect_clustering"} <= {n.route for n in inner}
    assert all(n.silhouette >= 0.04 and n.aspect and n.source for n in inner if n.route == "aspect_clustering")
    slotted = {n.name for p in (paths[i] for i in range(27)) for n in (nodes[x] for x in p) if n.route == "slot_mining"}
    assert slotted


def recursive(x, loads, own, depth, limits):
    """H13 as a recursion: nested lists of rows."""
    if depth >= limits.max_depth or len(own) < limits.least or len(own) <= 3:
        return sorted(own)
    tried = []
    for load in loads:
        v = lod.unit(x[np.ix_(own, np.flatnonzero(load > 0))] * load[load > 0])
        tried.append(cluster.aspect_clusters(v, min(limits.most, len(own) // 2)))
    labels, score = max(tried, key=lambda t: round(t[1], 9))
    sizes = np.bincount(labels)
    if score < limits.threshold or len(sizes) < 2 or sizes.max() > 0.85 * len(own) or (sizes == 1).sum() > len(sizes) / 2:
        return sorted(own)
    parts = [[own[i] for i in np.flatnonzero(labels == c)] for c in range(len(sizes))]
    return sorted(p[0] for p in parts if len(p) == 1) + [recursive(x, loads, p, depth + 1, limits) for p in parts if len(p) > 1]


def sets_of(nested, out):
    """The rows below each nested list."""
    own = frozenset(i for n in nested for i in (sets_of(n, out) if isinstance(n, list) else [n]))
    out.append(own)
    return own


def test_splits_equal_a_recursion(spark, rows):
    mine = rows.where("grp = 'PAL'").select(F.lit("s").alias("set"), "row", F.lit(0).alias("depth"), lod.tfidf.grams(F.col("text"), 1, 2, stop=[]).alias("tokens"))
    limits = lod.Limits(max_depth=3)
    found = lod.aspect_paths(mine, limits).collect()
    texts = {r.row: r.tokens for r in mine.collect()}
    ids = sorted(texts)
    terms, idf = lowrank.local_vocabulary([texts[i] for i in ids], 3000)
    x = lowrank.dense_texts([texts[i] for i in ids], terms, idf)
    ks = lowrank.tried(len(ids), 10)
    made = lowrank.factorized(x, ks)
    k = lowrank.elbow_of([made[c][2] for c in ks], 2)
    want = []
    sets_of(recursive(x, made[k][1], list(range(len(ids))), 0, limits), want)
    got = {}
    for r in found:
        if r.row is not None:
            for n in range(len(r.path) + 1):
                got.setdefault(tuple(r.path[:n]), set()).add(ids.index(r.row))
    assert len(got) > 3 and sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert {tuple(r.path) for r in found if r.row is None} == set(got) - {()}


def test_large_sets_go_through_passes(spark):
    rng = random.Random(2)
    themes = (["memory", "recall", "digits"], ["reaction", "speed", "button"], ["pattern", "paired", "shapes"])
    texts = {i: [*rng.sample(themes[i % 3], 2), rng.choice("uvw")] for i in range(90)}
    sets = spark.createDataFrame([("s", i, 0, t) for i, t in texts.items()], "set string, row long, depth int, tokens array<string>")
    found = lod.aspect_paths(sets, lod.Limits(max_depth=3), most_aspects=3, local=40).collect()
    paths = {r.row: r.path for r in found if r.row is not None}
    assert sorted(paths) == sorted(texts) and {tuple(r.path) for r in found if r.row is None} == {tuple(p[:n]) for p in paths.values() for n in range(1, len(p) + 1)}
    tops = {}
    for i, p in paths.items():
        if p:
            tops.setdefault(p[0], []).append(i % 3)
    pure = sum(max(map(own.count, set(own))) for own in tops.values()) / sum(map(len, tops.values()))
    assert len(tops) >= 2 and pure > 0.6 and any(len(p) > 1 for p in paths.values())


def test_labels_of_aspects(spark):
    texts = {0: "description: Total Errors: how many", 1: "description: Total Errors: all of them", 2: "speed of hands", 3: "speed of feet", 4: "speed of eyes", 5: "odd"}
    rows = spark.createDataFrame([("s", i, "DMS", t) for i, t in texts.items()], "set string, row long, top string, text string").withColumn("tokens", lod.tfidf.grams(F.col("text"), 1, 2, stop=["of"]))
    members = [("s", i, [0 if i < 2 else 1], []) for i in range(5)]
    found = {tuple(r.node): (r.label, r.source) for r in lod.aspect_labels(spark.createDataFrame(members, "set string, row long, node array<int>, up array<int>"), rows).collect()}
    assert found[(0,)] == ("DMS — Total Errors", "description_prefix")
    assert found[(1,)][1] in ("tfidf_bigram", "group_anchor") and found[(1,)][0].startswith("DMS")


def test_roles_come_before_slots(spark, rows):
    def vectors(phrases):
        kinds = F.when(F.col("phrase").rlike("errors|latency|length|span"), F.array(F.lit(1.0), F.lit(0.0), F.rand(1) / 50)).when(F.col("phrase").contains("box"), F.array(F.lit(0.0), F.lit(1.0), F.rand(1) / 50)).otherwise(F.array(F.lit(0.1), F.lit(0.1), F.lit(1.0)))
        return phrases.withColumn("vector", kinds)

    found = lod.build(rows.where("row < 27"), "all", phrase_vectors=vectors)
    assert sorted(leaf_paths(found)) == list(range(27)) and found.nodes.where("route = 'phrase_roles'").count() >= 2


def test_without_groups_the_root_is_split(spark, rows):
    found = lod.build(rows.where("grp = 'PAL'").withColumn("grp", F.lit(None).cast("string")), "all")
    assert found.nodes.where("route = 'group_anchor'").count() == 0 and found.nodes.where("route = 'aspect_clustering'").count() > 1
    empty = lod.build(rows.limit(0), "all")
    assert [r.type for r in empty.nodes.collect()] == ["root"]


def names_below(t, at=0):
    kids, names = {}, {n.id: n.name for n in t.nodes.collect()}
    for e in t.edges.collect():
        kids.setdefault(e.parent, []).append(e.child)
    build = lambda i: (names[i], sorted(build(c) for c in kids.get(i, [])))
    return build(at)


@pytest.mark.parametrize(("given", "want"), [
    (["Total Errors X", "Total Errors Y", "Total Errors Z"], [("Total Errors", [("X", []), ("Y", []), ("Z", [])])]),
    (["Total Errors A One X", "Total Errors A One Y", "Total Errors A One Z", "Total Errors B", "Total Errors C"], [("Total Errors", [("A One X", []), ("A One Y", []), ("A One Z", []), ("B", []), ("C", [])])]),
    (["Total Errors Box Set X", "Total Errors Box Set Y", "Total Errors Box Set Z", "Total Errors B", "Total Errors C"], [("Total Errors", [("B", []), ("Box Set", [("X", []), ("Y", []), ("Z", [])]), ("C", [])])]),
    (["the number of a", "the number of b", "the number of c"], [("the number of a", []), ("the number of b", []), ("the number of c", [])]),
    (["Mean Time one", "mean time two", "MEAN TIME three", "Span Length a", "Span Length b", "Span Length c", "x"], [("MEAN TIME", [("one", []), ("three", []), ("two", [])]), ("Span Length", [("a", []), ("b", []), ("c", [])]), ("x", [])]),
    (["Total Errors", "Total Errors A", "Total Errors B"], [("Total Errors", []), ("Total Errors A", []), ("Total Errors B", [])]),
])
def test_shared_prefixes_are_factored_until_none_is_left(spark, given, want):
    nodes = spark.createDataFrame([(0, "T", "root", None)] + [(i, n, "aggregation", i) for i, n in enumerate(given, 1)], "id long, name string, type string, more long")
    edges = ordered(spark.createDataFrame([(0, i) for i in range(1, len(given) + 1)], "parent long, child long"))
    assert names_below(tree.factored_prefixes(Tree(nodes, edges)))[1] == sorted(want)


def test_gate_of_splits(spark):
    sizes = {"good": [5, 5], "large": [19, 1, 1], "single": [3, 1, 1], "one": [4]}
    table = spark.createDataFrame([(g, 10 * c + i, c) for g, own in sizes.items() for c, n in enumerate(own) for i in range(n)], "grp string, id long, cluster int")
    assert {r.grp: r.fine for r in lod.split_gate(table).collect()} == {g: cluster.good_split(np.repeat(np.arange(len(own)), own)) for g, own in sizes.items()}


def test_equal_texts_go_through_splits_once(spark, monkeypatch):
    rng = random.Random(5)
    themes = (["memory", "recall", "digits"], ["reaction", "speed", "button"], ["pattern", "paired", "shapes"])
    kinds = [[*rng.sample(themes[i % 3], 2), rng.choice("uvw")] for i in range(30)]
    texts = {i: kinds[rng.randrange(30)] for i in range(120)}
    sets = spark.createDataFrame([("s", i, 0, t) for i, t in texts.items()], "set string, row long, depth int, tokens array<string>")
    monkeypatch.setattr(lod, "large_set", None)  # 120 rows of 30 texts are no large set
    limits = lod.Limits(max_depth=3)
    found = lod.aspect_paths(sets, limits, local=30).collect()
    ids = sorted(texts)
    terms, idf = lowrank.local_vocabulary([texts[i] for i in ids], 3000)
    x, ks = lowrank.dense_texts([texts[i] for i in ids], terms, idf), lowrank.tried(len(ids), 10)
    made = lowrank.factorized(x, ks)
    paths, _ = lod.split(x, made[lowrank.elbow_of([made[c][2] for c in ks], 2)][1], 0, limits)
    assert {r.row: tuple(r.path) for r in found if r.row is not None} == dict(zip(ids, paths)) and len(set(paths)) > 3


def test_slots_of_many_phrases_equal_a_plain_search():
    rng = random.Random(6)
    names = [f"p{i}" for i in range(60)]
    counts = {p: rng.randint(2, 9) for p in names}
    met = {(p, q): rng.choice([0.2, 0.65, 0.7, 0.9]) for p in names for q in names if p < q and rng.random() < 0.3}
    order, seen, want = sorted(counts, key=lambda p: (-counts[p], p)), set(), []
    apart = lambda p, q: met.get((min(p, q), max(p, q)), 1.0)
    for seed in order:
        slot, work = [seed], [seed]
        while work and seed not in seen:
            at = work.pop()
            for p in order:
                if p not in slot and apart(at, p) >= 0.75 and all(apart(p, q) >= 0.6 for q in slot):
                    slot.append(p)
                    work.append(p)
        if len(slot) > 1:
            seen.update(slot)
            want.append(slot)
    assert slots.slots_of(counts, met) == want and len(want) > 1


def test_more_phrases_than_two_thousand_are_slots_of_one_group(spark):
    table = spark.createDataFrame([("g", 2 * i + j, f"phrase number {i}", 2) for i in range(2100) for j in range(2)], "grp string, row long, phrase string, n long")
    assert slots.slots(table).groupBy("grp", "slot").count().collect()[0]["count"] == 2100


def test_rows_of_one_point_are_never_told_apart():
    rng = np.random.default_rng(4)
    kinds = np.eye(6, 9)[[0, 1, 2, 2, 3, 0, 4, 5]]
    x = kinds + 1e-13 * rng.normal(size=kinds.shape)  # as rounding errors leave them
    one = rng.random((1, 7))
    same_rows = np.repeat(one / np.linalg.norm(one), 3, axis=0) + 1e-13 * rng.normal(size=(3, 7))
    for times in (3, 30):  # a mixture, and k-means
        order = np.repeat(np.arange(len(x)), times)
        labels, score = cluster.aspect_clusters(x, 8, order=order)
        assert labels[2] == labels[3] and labels[0] == labels[5] and len(set(labels)) > 1 and score > 0
        plain, same = cluster.aspect_clusters(x[order], 8)
        assert plain.tolist() == labels[order].tolist() and same == pytest.approx(score)
        assert cluster.aspect_clusters(same_rows, 8, order=np.repeat([0, 1, 2], 60))[1] == 0.0


def test_phrases_and_slots_of_texts_that_stand_for_several_rows_are_those_of_all_rows(spark):
    rng = random.Random(8)
    texts = [f"{a} {b} {c}" for a in ("mean", "median", "total") for b in ("latency", "errors") for c in ("four boxes", "six boxes", "")]
    rows = spark.createDataFrame([(g, i, texts[rng.randrange(len(texts))]) for g in "gh" for i in range(40)], "grp string, row long, t string")
    kinds = rows.groupBy("grp", "t").agg(F.min("row").alias("row"), F.count("*").alias("times"))
    first = {(r.grp, r.row): r.first for r in rows.join(kinds.select("grp", "t", F.col("row").alias("first")), ["grp", "t"]).collect()}
    total = rows.groupBy("grp").agg(F.count("*").alias("total"))
    every, once = (slots.phrases(table, "grp", "row", F.col("t")) for table in (rows, kinds))
    assert {(r.grp, first[r.grp, r.row], r.phrase, r.n) for r in every.collect()} == {(r.grp, r.row, r.phrase, r.n) for r in once.collect()}
    a, b = (slots.gated(table, slots.assigned(table, slots.slots(table)), total).collect() for table in (every, once))
    assert a and {(r.grp, first[r.grp, r.row], r.slot, r.phrase) for r in a} == {(r.grp, r.row, r.slot, r.phrase) for r in b}


def test_passes_over_inner_nodes_give_the_tree_of_passes_over_all(spark, monkeypatch):
    names = ["Total Errors X", "Total Errors Y", "Total Errors Z", "and", "Total Errors X more", "Leaf and", "v1", "v2", "v3", "v4"]
    up = {1: 0, 2: 0, 3: 0, 4: 3, 5: 4, 6: 1, 7: 1, 8: 4, 9: 5, 10: 6}
    kind = lambda i: "attribute" if i > 6 else "aggregation"
    nodes = spark.createDataFrame([(0, "T", "root", None, None)] + [(i, n, kind(i), i, "aspect_clustering" if i < 7 else None) for i, n in enumerate(names, 1)], "id long, name string, type string, row long, route string")
    edges = ordered(spark.createDataFrame([(p, c) for c, p in up.items()], "parent long, child long"))
    plain = tree.factored_prefixes(Tree(nodes, edges))
    plain = Tree(plain.nodes.withColumn("route", F.when((F.col("type") == "aggregation") & F.col("route").isNull(), "sibling_factoring").otherwise(F.col("route"))), plain.edges)
    plain = tree.without_noise(plain, (F.col("type") == "aggregation") & (F.col("route") == "aspect_clustering") & lod.is_noise(F.col("name")))
    want = tree.single_parent(tree.stripped_prefixes(plain))
    seen, before = [], lod.stripped_prefixes
    monkeypatch.setattr(lod, "stripped_prefixes", lambda t: seen.append(t.nodes.where("type = 'attribute'").count()) or before(t))
    got = lod.passes(Tree(nodes, edges))
    rows = lambda table, *columns: sorted(map(str, table.select(*columns).collect()))
    assert seen == [0] and rows(got.nodes, "id", "name", "type", "row", "route") == rows(want.nodes, "id", "name", "type", "row", "route")
    assert rows(got.edges, "parent", "child", "ord") == rows(want.edges, "parent", "child", "ord")
