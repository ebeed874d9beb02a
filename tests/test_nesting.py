"""Greedy covers of siblings against taking one group after another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from thicket.functions.text import LABEL_STOP
from thicket.operators import nesting
from thicket.operators.tree import Tree, ordered


def tree_of(spark, links, names, leaves=()):
    kind = lambda i: "root" if i == 0 else "attribute" if i in leaves else "aggregation"
    nodes = spark.createDataFrame([(i, n, kind(i), i) for i, n in names.items()], "id long, name string, type string, more long")
    return Tree(nodes, ordered(spark.createDataFrame(links, "parent long, child long")))


def nested(tree):
    names, kids = {n.id: n.name for n in tree.nodes.collect()}, {}
    for e in tree.edges.collect():
        kids.setdefault(e.parent, []).append(e.child)
    build = lambda i: (names[i], sorted(build(c) for c in kids.get(i, [])))
    return build(0)[1]


def test_measures_of_siblings(spark):
    names = {0: "r", 1: "DMS", 2: "Mean Correct Latency", 3: "Median Correct Latency", 4: "Correct Latency Standard Deviation", 5: "Other", 6: "SWM", 7: "Total Errors", 8: "Total Errors Within", 9: "Span", 20: "leaf", 21: "leaf2", 22: "leaf3"}
    links = [(0, 1), (0, 6), (1, 2), (1, 3), (1, 4), (1, 5), (6, 7), (6, 8), (6, 9), (7, 20), (8, 21), (2, 22)]
    found = nesting.nested_by_measure(tree_of(spark, links, names, {20, 21, 22}))
    assert nested(found) == [
        ("DMS", [("Correct Latency", [("Mean Latency", [("leaf3", [])]), ("Median Latency", []), ("Standard Deviation", [])]), ("Other", [])]),
        ("SWM", [("Span", []), ("Total Errors", [("Within Errors", [("leaf2", [])]), ("leaf", [])])]),
    ]
    assert nested(nesting.nested_by_measure(found)) == nested(found)


def plain_split(titles, above, common=0.7):
    """Descriptor and leaves of each group, one after another."""
    own = {i: [w for w in re.findall(r"[a-z][a-z\-]+", (t or "").lower()) if w not in LABEL_STOP and w not in above] for i, t in titles.items()}
    count = {}
    for w in own.values():
        for x in set(w):
            count[x] = count.get(x, 0) + 1
    own = {i: [x for x in w if count[x] <= common * len(own)] for i, w in own.items()}
    by = {}
    for i, w in own.items():
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                by.setdefault(" ".join(w[k : k + n]), set()).add(i)
    taken, groups = set(), {}
    for phrase, ids in sorted(((p, s) for p, s in by.items() if len(s) >= 2), key=lambda x: (-len(x[0].split()), -len(x[1]), x[0])):
        free = ids - taken
        if len(free) >= 2:
            groups[phrase] = free
            taken |= free
    return groups if len(groups) >= 2 else {}


@pytest.mark.parametrize("seed", [1, 2])
def test_titles_split_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    names, links, titles, parents = {0: "r", 1: "Error Task"}, [(0, 1)], {}, {}
    for node in range(2, 12):
        names[node] = rng.choice(["Colour Errors", "Pattern", "Latency Of Box"])
        links.append((1, node))
        for k in range(rng.randrange(2, 16)):
            i = 100 * node + k
            titles[i] = rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice("incorrect colour pattern distractor box delay second the of task mean".split()) for _ in range(rng.randrange(1, 6)))
            names[i], parents[i] = f"v{i}", node
            links.append((node, i))
    given = tree_of(spark, links, names, set(titles))
    found = nesting.split_by_title(given, spark.createDataFrame(list(titles.items()), "id long, title string"))
    up = {e.child: e.parent for e in found.edges.collect()}
    labels = {n.id: n.name for n in found.nodes.collect()}
    assert set(labels) >= set(names) and len(up) == len(labels) - 1
    made = 0
    for node in range(2, 12):
        own = {i: t for i, t in titles.items() if parents[i] == node}
        above = set(re.findall("[a-z]{3,}", (names[node] + " error task").lower()))
        want = plain_split(own, above) if len(own) >= 4 else {}
        got = {}
        for i in own:
            if up[i] != node:
                assert up[up[i]] == node
                got.setdefault(labels[up[i]].lower(), set()).add(i)
        assert got == want
        made += len(want)
    assert made > 4


def test_nothing_to_split(spark):
    given = tree_of(spark, [(0, 1), (1, 2)], {0: "r", 1: "a b", 2: "leaf"}, {2})
    found = nesting.split_by_title(given, given.nodes.select("id", F.lit("x y").alias("title")))
    assert nested(found) == nested(given) == nested(nesting.nested_by_measure(given))
