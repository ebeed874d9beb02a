"""Tree builders against recursive versions on small tables."""

from collections import Counter, defaultdict

import __spark_entry__
import numpy as np
from pyspark.sql import functions as F

from thicket.operators import build, slots, tfidf
from thicket.storage import numbered


def brute_nested(own, order, depth=4):
    """Paths of one group, as a recursion."""
    paths, made = {r: [] for r in own}, []

    def split(some, i, path):
        if len(path) >= depth or i >= len(order) or len(some) <= 1:
            return
        by = defaultdict(list)
        for r in some:
            if own[r].get(order[i]):
                by[own[r][order[i]]].append(r)
        if len(by) <= 1:
            return split(some, i + 1, path)
        for v, group in by.items():
            if len(group) > 1:
                made.append((*path, v))
                for r in group:
                    paths[r] = [*path, v]
                split(group, i + 1, [*path, v])

    split(list(own), 0, [])
    return paths if len(made) >= 2 else {r: [] for r in own}


def test_nested_equals_recursion(spark):
    rng = np.random.default_rng(4)
    order = ["measure", "outcome", "statistic", "condition", "subtype", "zeta"]
    own = {g: {r: {o: str(rng.choice(list("abc") + ["", None])) for o in order if rng.random() < 0.8} for r in range(int(n))} for g, n in enumerate([*rng.integers(1, 40, 10), 6000])}
    own = {g: {r: {o: v for o, v in x.items() if v not in ("", "None")} for r, x in rows.items()} for g, rows in own.items()}
    own[99] = {r: {"measure": "a"} for r in range(5)}
    rows = spark.createDataFrame([(g, r) for g, x in own.items() for r in x], "grp long, row long")
    roles = spark.createDataFrame([(g, r, o, v) for g, x in own.items() for r, y in x.items() for o, v in y.items()] + [(99, 0, "outcome", "")], "grp long, row long, role string, value string")
    got = {(r.grp, r.row): r.path for r in build.role_hierarchy(rows, roles).collect()}
    expected = {(g, r): p for g, x in own.items() for r, p in brute_nested(x, order).items()}
    assert got == expected and any(len(p) == 4 for p in expected.values())
    empty = build.role_hierarchy(rows, roles.limit(0)).collect()
    assert len(empty) == len(expected) and not any(r.path for r in empty)


def brute_label(inside, outside, used):
    f, g = Counter(w for ws in inside for w in set(ws)), Counter(w for ws in outside for w in set(ws))
    first = {w: next(i for i, ws in enumerate(inside) if w in ws) for w in f}
    free = [w for w in f if w not in used and len(w) > 2]
    score = {w: round(f[w] / len(inside) - g[w] / max(len(outside), 1), 9) for w in free if f[w] >= 2 or f[w] / len(inside) >= 0.5}
    picks = [w for w in sorted(score, key=lambda w: (-score[w], first[w], w)) if score[w] > 0][:2]
    picks = picks or sorted(free, key=lambda w: (-f[w], first[w], w))[:1]
    return " / ".join(w.title() for w in picks) or "Group"


def test_cluster_labels_equal_recursion(spark):
    rng = np.random.default_rng(8)
    bag = "alpha beta gamma delta mean xy errors trial".split()
    rows = [(i, [0, *[int(c) for c in rng.integers(0, 3, int(rng.integers(0, 4)))]], [str(w) for w in rng.choice(bag, int(rng.integers(0, 4)))]) for i in range(150)]
    rows += [(200, [0, 7], []), (201, [0, 7], [])]
    got = {tuple(r.node): (r.label, r.n) for r in build.cluster_labels(spark.createDataFrame(rows, "row long, path array<int>, words array<string>")).collect()}
    expected = {}

    def walk(node, used):
        under = [(p, w) for _, p, w in rows if tuple(p[: len(node)]) == node]
        for c in sorted({p[len(node)] for p, _ in under if len(p) > len(node)}):
            kid = (*node, c)
            inside, outside = [w for p, w in under if tuple(p[: len(kid)]) == kid], [w for p, w in under if tuple(p[: len(kid)]) != kid]
            label = brute_label(inside, outside, used)
            expected[kid] = (label, len(inside))
            walk(kid, used | {label.lower()})

    walk((0,), set())
    assert got == expected and got[(0, 7)] == ("Group", 2) and len(got) > 20


def test_cluster_tree_is_a_tree_of_all_rows(spark, sf):
    found = __spark_entry__.queries()["cluster_tree_part"](spark, sf).collect()
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    kinds = Counter(r.type for r in found)
    up, kind = {r.id: r.parent for r in found}, {r.id: r.type for r in found}
    assert kinds["attribute"] == parts and kinds["root"] == 1 and len(up) == len(found) and sorted(up) == list(range(len(found)))
    assert up[0] is None and all(kind[p] != "attribute" for i, p in up.items() if i) and kinds["aggregation"] > 2
    fan = Counter(up.values())
    assert all(fan[i] >= 1 for i in kind if kind[i] == "aggregation")
    again = {tuple(r) for r in __spark_entry__.queries()["cluster_tree_part"](spark, sf).collect()}
    assert again == {tuple(r) for r in found}


def test_slot_gate_and_order(spark, sf):
    table = spark.createDataFrame([("g", r, p, 2) for r, p in [(0, "mean x"), (1, "mean x"), (2, "median"), (3, "median"), (0, "latency"), (2, "latency"), (1, "errors"), (3, "errors")]], "grp string, row long, phrase string, n long")
    own = table.withColumn("slot", F.when(F.col("phrase").isin("mean x", "median"), 0).otherwise(1)).drop("n")
    total = lambda n: spark.createDataFrame([("g", n)], "grp string, total long")
    assert slots.gated(table, own, total(4)).count() == 8 and slots.gated(table, own, total(7)).count() == 8 and slots.gated(table, own, total(8)).count() == 0
    assert slots.gated(table, own.where("slot = 0"), total(4)).count() == 0
    flags = spark.createDataFrame([("12 seconds",), ("all trials",), ("12",), ("seconds",), ("a12 boxes",)], "p string").select(slots.is_condition(F.col("p"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False, False]
    found = __spark_entry__.queries()["slot_hierarchy_part"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/part.parquet").count()


def test_terms_and_numbers(spark):
    rows = [(0, "b a b A c"), (1, ""), (2, None), (3, "x " * 3000 + "yy")]
    got = {(r.doc, r.term): r.tf for r in tfidf.terms(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), 1, 2, "[a-z]+").collect()}
    assert got[0, "b"] == 2 and got[0, "a"] == 2 and got[0, "b a"] == 2 and got[0, "a b"] == 1 and got[3, "x"] == 3000 and got[3, "x x"] == 2999 and got[3, "x yy"] == 1 and len(got) == 10
    some = spark.range(0, 5000, 1, 7).select((F.hash("id")).alias("a"), "id")
    found = numbered(some, "n", "a", "id").orderBy("n").collect()
    assert [r.n for r in found] == list(range(5000)) and [(r.a, r.id) for r in found] == sorted((r.a, r.id) for r in found)
    assert numbered(some.limit(0), "n", "id").count() == 0


def test_rows_of_one_vector_are_moved_once(spark, monkeypatch):
    from thicket.operators import ward

    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(9, 3))
    rows = spark.createDataFrame([(i, "g", kinds[i % 9].tolist()) for i in range(180)], "id long, grp string, v array<double>")
    sizes, write = {}, ward.written
    monkeypatch.setattr(ward, "written", lambda df, name: sizes.setdefault(name, df.count()) and write(df, name) if name == "ward-kinds" else write(df, name))
    found = {r.id: tuple(r.path) for r in ward.paths(rows, "id", "grp", "v", bound=40).collect()}
    assert sizes["ward-kinds"] <= 9 and len(found) == 180 and len({p[:2] for p in found.values()}) > 1
    assert all(found[i][:2] == found[i % 9][:2] for i in range(180))
