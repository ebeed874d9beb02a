"""Width expansion of a tree to a fixed point: leaves move to the group whose centroid is nearest.

A group is an inner node with leaves of its own; its centroid is that of all leaves below it. Sums of
unit vectors and their numbers are kept by node, and a pass changes them by the leaves that moved alone. Within a pass centroids
stay as they are, so the order of leaves does not matter. Leaves meet centroids in blocks of ``BLOCK_BYTES``, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.tree import Tree, closure, first_parents, ordered
from thicket.storage import Scratch, numbered, written

BLOCK_BYTES = 32 << 20
#: Mean pairwise cosine of a node's leaves below which it is incoherent.
INCOHERENT = 0.25


@dataclass
class Expansion:
    """The tree after all passes, what each pass moved, and the coherence of groups before and after."""

    tree: Tree
    moves: list[int]
    coherence: DataFrame


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id, v at length 1; zeros stay. vectors has (id, vector)."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.where("vector IS NOT NULL").select("id", F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("v"))


def sums_of(rows: DataFrame, by: str) -> DataFrame:
    """by, n, s: number and sum of vectors v, each times its weight w."""
    spread = rows.select(by, "w", F.posexplode("v").alias("i", "x"))
    sums = spread.groupBy(by, "i").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s"))


def rolled_up(own: DataFrame, up: DataFrame) -> DataFrame:
    """node, n, s of all leaves below each node: own has (node, n, s) of direct leaves, up (node, anc) with each node above itself."""
    spread = own.join(up, "node").select(F.col("anc").alias("node"), "n", F.posexplode("s").alias("i", "x"))
    sums = spread.groupBy("node", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy("node").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))


def nearest(leaves: DataFrame, centroids: DataFrame, tables: Scratch) -> DataFrame:
    """id, best, sim: of leaves (id, v) the nearest of centroids (node, c), ties to the smaller node."""
    numbers = tables.written(numbered(centroids, "k", "node"), "centroids")
    size = numbers.agg(F.count("*").alias("n"), F.max(F.size("c")).alias("d")).first()
    each = max(1, BLOCK_BYTES // (8 * max(size["d"] or 1, 1)))
    out = None
    for at in range(0, size["n"], each):
        block = numbers.where((F.col("k") >= at) & (F.col("k") < at + each)).orderBy("node").select("node", "c").toPandas()
        held = leaves.sparkSession.sparkContext.broadcast((block["node"].to_numpy(np.int64), np.stack(block["c"].to_list())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            nodes, c = held.value
            for batch in batches:
                if batch.num_rows:
                    sims = np.round(np.stack(batch.column(1).to_pylist()) @ c.T, 9)
                    best = sims.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes[best]), pa.array(sims[np.arange(len(best)), best])], ["id", "best", "sim"])

        told = leaves.select("id", "v").mapInArrow(run, "id long, best long, sim double")
        out = told if out is None else out.union(told)
    if out is None:
        return leaves.select("id", F.lit(None).cast("long").alias("best"), F.lit(None).cast("double").alias("sim")).limit(0)
    if size["n"] <= each:
        return out
    return out.groupBy("id").agg(F.max(F.struct("sim", (-F.col("best")).alias("low"))).alias("b")).select("id", (-F.col("b.low")).alias("best"), "b.sim")


def incoherent(table: DataFrame) -> DataFrame:
    """Node, n, coherence, incoherent of nodes with two leaves or more; table has (node, v), unit vectors or zeros, which have cosine 0 with all."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    own = table.groupBy("node").agg(F.sum(square(F.col("v"))).alias("own"))
    sums = sums_of(table.withColumn("w", F.lit(1.0)), "node").where("n >= 2").join(own, "node")
    mean = (square(F.col("s")) - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return sums.select("node", F.col("n").cast("long").alias("n"), F.round(mean, 3).alias("coherence"), (mean < INCOHERENT).alias("incoherent"))


def expanded(tree: Tree, vectors: DataFrame, margin: float = 0.02, passes: int = 3) -> Expansion:
    """Leaves with a vector (id, vector) move to the group of nearest centroid, if that beats the current one's by ``margin``; pass after pass until none moves.

    By default that is one pass and two more at most. Leaves without a vector stay; a leaf of several nodes counts
    for its first group and leaves all its parents when it moves. With fewer than two groups nothing moves. Groups stay, also when their last leaf leaves: they keep
    taking part as long as leaves lie below them.
    """
    tables, kept = Scratch(), Scratch()
    kinds = tree.nodes.select("id", "type")
    leaves = kept.written(unit_vectors(vectors).join(kinds.where("type = 'attribute'").select("id"), "id", "left_semi"), "leaf-vectors")
    inner = kinds.where("type = 'aggregation'").select(F.col("id").alias("node"))
    known = leaves.select("id")
    links = tree.edges.select("parent", F.col("child").alias("id")).join(kinds.where("type = 'attribute'").select("id"), "id", "left_semi")
    members = tables.written(links.join(inner, F.col("parent") == F.col("node"), "left_semi").select("id", F.col("parent").alias("node")), "group-leaves")
    groups = kept.written(members.select("node").distinct(), "groups")
    up = closure(tree.edges.join(inner.withColumnRenamed("node", "child"), "child", "left_semi").select("parent", "child")).select(F.col("desc").alias("node"), "anc")
    up = kept.written(up.union(inner.select("node", "node")).join(groups.withColumnRenamed("node", "anc"), "anc", "left_semi").select("node", "anc"), "groups-above")
    parents = first_parents(Tree(tree.nodes, tree.edges.join(groups.withColumnRenamed("node", "parent"), "parent", "left_semi")))
    place = kept.written(parents.select(F.col("child").alias("id"), F.col("parent").alias("node")).join(known, "id", "left_semi"), "leaf-places")
    # Sums count a leaf of several groups in each, as its vector lies below all of them.
    direct = tables.written(sums_of(members.join(leaves, "id").withColumn("w", F.lit(1.0)), "node"), "group-sums")
    before = kept.written(incoherent(place.join(leaves, "id").select("node", "v")), "coherence-before")
    moves, first = [], place
    for _ in range(passes):
        every = rolled_up(direct, up).where("n > 0.5")
        length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
        centroids = tables.written(every.select("node", F.transform("s", lambda x: F.when(length > 0, x / length).otherwise(0.0)).alias("c")), "centroids")
        if centroids.limit(2).count() < 2:
            moves.append(0)
            break
        best = nearest(leaves.join(place.select("id"), "id", "left_semi"), centroids, tables)
        now = leaves.join(place, "id").join(centroids, "node").select("id", "node", "v", F.round(F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), 9).alias("now"))
        moved = tables.written(now.join(best, "id").where((F.col("best") != F.col("node")) & (F.col("sim") > F.col("now") + margin)).select("id", "node", "best", "v"), "moved-leaves")
        moves.append(moved.count())
        if not moves[-1]:
            break
        # A mover leaves all its groups: its own vector goes out of each, and into the new one.
        gone = members.join(moved.select("id", "v"), "id").select("node", "v", F.lit(-1.0).alias("w"))
        change = sums_of(gone.union(moved.select("best", "v", F.lit(1.0))), "node")
        added = direct.withColumnRenamed("n", "n0").withColumnRenamed("s", "s0").join(change, "node", "full_outer")
        sums = F.when(F.col("s").isNull(), F.col("s0")).when(F.col("s0").isNull(), F.col("s")).otherwise(F.zip_with("s0", "s", lambda a, b: a + b))
        direct = tables.written(added.select("node", (F.coalesce("n0", F.lit(0.0)) + F.coalesce("n", F.lit(0.0))).alias("n"), sums.alias("s")), "group-sums")
        to = moved.select("id", "best")
        place = kept.written(place.join(to, "id", "left").select("id", F.coalesce("best", "node").alias("node")), "leaf-places")
        members = tables.written(members.join(to, "id", "left_anti").union(to), "group-leaves")
    changed = first.withColumnRenamed("node", "was").join(place, "id").where("was <> node").select("id", "node")
    ever = kept.written(changed, "moved")
    stay = tree.edges.select("parent", "child").join(ever.withColumnRenamed("id", "child"), "child", "left_anti").select("parent", "child")
    edges = written(ordered(stay.union(ever.select("node", "id"))), "expanded-edges")
    after = incoherent(place.join(leaves, "id").select("node", "v"))
    report = written(before.select("node", F.col("n").alias("n_before"), F.col("coherence").alias("before")).join(after.select("node", F.col("n").alias("n_after"), F.col("coherence").alias("after"), "incoherent"), "node", "full_outer"), "coherence")
    tables.clear()
    return Expansion(Tree(tree.nodes, edges), moves, report)
