"""Ward trees of the vectors of a group, level by level (H1: M1 and M4, without labels of the clusters).

A node of at most ``bound`` vectors gets its whole subtree from the exact kernel
in one group. A larger one is split into coarse clusters first: exact Ward on
``bound`` of its vectors (those of least hash) gives their number and first
centroids, Lloyd's rounds fit the centroids on all of its vectors, and each
vector goes to the nearest. So above the bound a level is k-means in the shape of
Ward's clusters, not Ward's linkage of all pairs; near vectors stay together.

Defined cases: clusters are numbered by their smallest id; a cluster of one keeps
its parent's path; null groups are one group; a zero vector stays as it is; nodes
still too large at the last depth are leaves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators import cluster
from thicket.storage import small, written

ROUNDS = 10
#: Centroid tables of up to so many nodes are broadcast.
MOST_NODES = 5_000


def unit(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c))
    return F.when(norm > 0, F.transform(v, lambda c: c / norm)).otherwise(v)


def exact(rows: DataFrame, depth: int, max_depth: int, min_size: int, branch: int) -> DataFrame:
    """The rest of the paths of nodes under the bound."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = cluster.ward_paths(np.stack(pdf.u.to_numpy()), max_depth, min_size, branch, depth)
        return pd.DataFrame({"id": pdf.id, "grp": pdf.grp, "path": [[*map(int, p), *q] for p, q in zip(pdf.path, found)]})

    kept = rows.select("id", "grp", "path")
    return rows.groupBy("node").applyInPandas(one, kept.schema)


def first_centroids(depth: int, max_depth: int, min_size: int, branch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf.u.to_numpy())
        floor, cap = cluster.split_limits(int(pdf.n.iloc[0]), depth, max_depth, min_size, branch)
        labels = cluster.best_ward(x, floor, min(cap, len(x) - 1))
        if labels.max() < 1:
            labels = cluster.cut_at(cluster.agglomerate(cluster.distances(x), "ward"), len(x), min(floor, cap))
        return pd.DataFrame({"node": [pdf.node.iloc[0]], "middles": [[x[labels == c].mean(axis=0).tolist() for c in range(int(labels.max()) + 1)]]})

    return one


def nearest(rows: DataFrame, middles: DataFrame) -> DataFrame:
    """rows with c, the first of the nearest centroids of their node."""

    def far(m: Column) -> Column:
        return F.round(F.aggregate(F.zip_with(m, "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d), 12)

    all_ = rows.join(small(middles, MOST_NODES), "node").withColumn("far", F.transform("middles", far))
    return all_.withColumn("c", F.array_position("far", F.array_min("far"))).drop("middles", "far")


def coarse(rows: DataFrame, large: DataFrame, bound: int, depth: int, max_depth: int, min_size: int, branch: int) -> DataFrame:
    """rows of large nodes with c, their coarse cluster from 0 on, and size, its members."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("id"), "id")
    some = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= bound).join(large, "node")
    middles = written(some.groupBy("node").applyInPandas(first_centroids(depth, max_depth, min_size, branch), "node string, middles array<array<double>>"), "ward-middles")
    # Rows of one vector go the same way: each different vector is moved once, with its number of rows.
    kinds = written(rows.groupBy("node", "u").agg(F.count("*").alias("times")), "ward-kinds")
    for _ in range(ROUNDS):
        spread = nearest(kinds, middles).select("node", "c", "times", F.posexplode("u").alias("pos", "x"))
        sums = spread.groupBy("node", "c", "pos").agg(F.round(F.sum(F.col("x") * F.col("times")) / F.sum("times"), 12).alias("x"))
        lines = sums.groupBy("node", "c").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m"))
        middles = written(lines.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "m"))), lambda s: s["m"]["x"]).alias("middles")), "ward-middles")
    out = written(nearest(rows, middles), "ward-coarse")
    sizes = out.groupBy("node", "c").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    sizes = sizes.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("low")) - 1).drop("low")
    return out.join(small(sizes, MOST_NODES), ["node", "c"]).withColumn("c", F.col("k")).drop("k")


def paths(vectors: DataFrame, id_col: str, group: str, vector: str, bound: int = 1000, max_depth: int = 3, min_size: int = 6, branch: int = 8) -> DataFrame:
    """id, grp, path of each vector: cluster numbers from the root, which is 0."""
    node = F.to_json(F.struct("grp", "path"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), unit(F.col(vector)).alias("u"), F.array(F.lit(0)).alias("path")).withColumn("node", node)
    done = []
    for depth in range(max_depth):
        large = written(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > bound), "ward-large")
        if large.isEmpty():
            done.append(exact(rows, depth, max_depth, min_size, branch))
            break
        names = small(large, MOST_NODES)
        done.append(exact(rows.join(names, "node", "left_anti"), depth, max_depth, min_size, branch))
        split = coarse(rows.join(names, "node", "left_semi"), large, bound, depth, max_depth, min_size, branch)
        done.append(split.where("size = 1").select("id", "grp", "path"))
        down = split.where("size > 1").withColumn("path", F.concat("path", F.array("c")))
        rows = written(down.select("id", "grp", "u", "path").withColumn("node", node), "ward-level")
    else:
        done.append(rows.select("id", "grp", "path"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
