import pytest
from pyspark.sql import functions as F

from thicket.operators import roles
from thicket.operators.tree import Tree, nested_by_head, path_rows


def make(spark, nodes, edges):
    kinds = {"r": "root", "g": "aggregation", "l": "attribute"}
    return Tree(spark.createDataFrame([(i, n, kinds[k]) for i, n, k in nodes], "id long, name string, type string"), spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "parent long, child long, ord int"))


def test_nested_by_head(spark):
    t = make(spark, [(0, "All", "r"), (1, "DMS", "g"), (2, "Total Errors", "g"), (3, "Probability Error", "g"), (4, "Errors", "g"), (5, "Correct Latency", "g"), (6, "PAL", "g"), (7, "Total Errors", "g"), (8, "Errors", "g"), (9, "a", "l"), (10, "b", "l"), (11, "c", "l"), (12, "d", "l")],
             [(0, 1), (0, 6), (1, 2), (1, 3), (1, 4), (1, 5), (6, 7), (6, 8), (2, 9), (3, 10), (4, 11), (5, 12), (7, 9), (8, 10)])
    got = nested_by_head(t)
    assert {r.name for r in got.nodes.where("id = 13").collect()} == {"Errors"} and got.nodes.where("id = 4").count() == 0
    links = {(r.parent, r.child) for r in got.edges.collect()}
    # PAL has two children only and stays; what said nothing but the word is dissolved.
    assert links == {(0, 1), (0, 6), (1, 13), (13, 2), (13, 3), (13, 11), (1, 5), (6, 7), (6, 8), (2, 9), (3, 10), (5, 12), (7, 9), (8, 10)}
    assert {r.id: r.name for r in got.nodes.where("id IN (2, 3, 5, 7)").collect()} == {2: "Total", 3: "Probability", 5: "Correct Latency", 7: "Total Errors"}
    assert path_rows(got).where("id = 11").first().path == "DMS > Errors > c"
    same = nested_by_head(make(spark, [(0, "All", "r"), (1, "a", "l")], [(0, 1)]))
    assert same.nodes.count() == 2 and same.edges.count() == 1


def test_role_table(spark):
    t = make(spark, [(0, "All", "r"), (1, "DMS", "g"), (2, "Latency", "g"), (3, "Mean", "g"), (4, "a", "l"), (5, "b", "l")], [(0, 1), (1, 2), (2, 3), (3, 4), (0, 5)])
    rows = spark.createDataFrame([(4, "DMS", "a"), (5, "DMS", "b")], "id long, grp string, label string")
    kinds = spark.createDataFrame([(1, "statistic"), (3, "statistic"), (2, "measure"), (1, "task")], "id long, role string")
    audit = spark.createDataFrame([(4, "measure", "Errors"), (4, "outcome", None), (5, "unit", "ms"), (5, "area", "x")], "id long, role string, value string")
    got = {r.id: r for r in roles.role_table(t, rows, kinds, audit).collect()}
    assert (got[4].measure, got[4].statistic, got[4].outcome, got[4].other) == ("Errors", "Mean", "", "task: DMS")
    assert (got[5].measure, got[5].other) == ("", "area: x; unit: ms")


def test_metrics_and_vectors(spark):
    none = spark.createDataFrame([], "s double, f string, source string")
    got = roles.build_metrics(none, "s", "f", none).first()
    assert got.variables == 0 and got.coverage_pct == 0 and got.avg_confidence is None and got.concepts == 0
    rows = spark.createDataFrame([(1, "Mean mean latency"), (2, "unknown"), (3, None), (4, "")], "id long, t string")
    known = spark.createDataFrame([("mean", [1.0, 0.0]), ("latency", [0.0, 2.0])], "word string, vec array<double>")
    found = {(r.row, r.pos): r.c for r in roles.averaged_vectors(rows, "id", F.col("t"), known).collect()}
    assert found[1, 0] == pytest.approx(0.5**0.5) and found[1, 1] == pytest.approx(0.5**0.5)
    assert [found[i, p] for i in (2, 3, 4) for p in (0, 1)] == [0.0] * 6 and len(found) == 8
