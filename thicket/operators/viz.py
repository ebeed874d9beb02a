"""Tables for drawing trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.tree import ROOT, Tree, closure, depths, first_parents, leaf_counts
from thicket.storage import numbered

COLLAPSED = 10**9


def viz_table(tree: Tree) -> DataFrame:
    """G1: id, label (40 characters), parent (null for the root), value: leaves below, at least 1."""
    return tree.nodes.join(first_parents(tree).withColumnRenamed("child", "id"), "id", "left").join(leaf_counts(tree), "id", "left").select("id", F.substring("name", 1, 40).alias("label"), "parent", F.greatest(F.coalesce("leaves", F.lit(1)), F.lit(1)).alias("value"))


def collapsed_graph(tree: Tree, most_depth: int) -> Tree:
    """Nodes down to a depth; what hides below a node is one placeholder with its number of nodes."""
    deep = depths(tree).union(tree.nodes.where(f"id = {ROOT}").select("id", F.lit(0)))
    shown = deep.where(F.col("depth") <= most_depth).select("id")
    hidden = closure(tree.edges).join(deep.where(F.col("depth") == most_depth).select(F.col("id").alias("anc")), "anc").groupBy("anc").agg(F.count_distinct("desc").alias("n"))
    extra = hidden.select((F.col("anc") + COLLAPSED).alias("id"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" nodes")).alias("name"), F.lit("collapsed").alias("type"))
    nodes = tree.nodes.select("id", "name", "type").join(shown, "id", "left_semi").union(extra)
    edges = tree.edges.join(shown.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child", "ord").union(hidden.select("anc", F.col("anc") + COLLAPSED, F.lit(0)))
    return Tree(nodes, edges)


def layout(tree: Tree) -> DataFrame:
    """Id, x = 3 * depth, y = 1.8 * mean slot of the leaves below, leaves in the order of their paths of ord."""
    orders = tree.edges.select(F.col("child").alias("desc"), F.col("ord"))
    up = closure(tree.edges).union(tree.nodes.select(F.col("id"), F.col("id"), F.lit(0)))
    leaf = tree.nodes.where("type = 'attribute'").select(F.col("id").alias("leaf"))
    steps = up.join(leaf, F.col("desc") == F.col("leaf")).where(f"anc <> {ROOT}").select("leaf", "anc", "dist").join(orders.withColumnRenamed("desc", "anc"), "anc")
    keys = steps.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ord"))), lambda x: x["ord"]).alias("key"))
    slots = numbered(keys, "slot", "key", "leaf").select("leaf", "slot")
    y = up.join(slots, F.col("desc") == F.col("leaf")).groupBy(F.col("anc").alias("id")).agg(F.round(1.8 * F.avg("slot"), 6).alias("y"))
    deep = depths(tree).union(tree.nodes.where(f"id = {ROOT}").select("id", F.lit(0)))
    return deep.join(y, "id", "left").select("id", (3 * F.col("depth")).alias("x"), "y")


def safe_depth(n_nodes: int) -> int | None:
    """G6."""
    return 3 if n_nodes > 400 else 4 if n_nodes > 150 else None
