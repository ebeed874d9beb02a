"""Groups of canonical rows and of tree nodes (A-1, A-2, A-11, A-16, F4, F6, H5, H23, J13, U3, W7, W9, W10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import PATH_SEP, eval_tokens
from thicket.operators.evaluate import centroids, coherence
from thicket.operators.profile import top_group
from thicket.storage import numbered, written


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, from 1, in an order whose columns are unique together; given range by range."""
    return numbered(rows, "place", *order).withColumn("place", F.col("place") + 1)


def top_groups(rows: DataFrame, path: str, row: str) -> DataFrame:
    """A-1: top, n, first, place: top groups in the order in which they first appear."""
    sums = rows.groupBy(top_group(F.col(path)).alias("top")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    return placed(sums, "first", "top")


def terminal_groups(rows: DataFrame, path: str) -> DataFrame:
    """A-2: path, depth, n of the groups that rows are in."""
    return rows.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("n")).select("path", F.size(F.split("path", PATH_SEP)).alias("depth"), "n")


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """A-16: column, value, n of each column's values, by one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The keys, each once, with the place of its first appearance in ``order``; hot keys are pre-aggregated."""
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("first"))
    return placed(firsts, "first", *keys).drop("first")


def unary_groups(rows: DataFrame, path: str) -> DataFrame:
    """H5: top, n_paths, skip: groups with at most one path below, whose second level says nothing."""
    parts = F.split(path, PATH_SEP)
    below = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), PATH_SEP)
    return rows.groupBy(top_group(F.col(path)).alias("top")).agg(F.count_distinct(F.when(F.size(parts) > 1, below)).alias("n_paths")).withColumn("skip", F.col("n_paths") <= 1)


def family_pairs(families: DataFrame, row: str, family: str) -> DataFrame:
    """Family, members, pairs: how many pairs of rows are of one family; pairs are counted and never made."""
    sizes = families.where(F.col(family).isNotNull() & (F.col(family) != "")).groupBy(F.col(family).alias("family")).agg(F.count_distinct(row).alias("members"))
    return sizes.withColumn("pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("long"))


def children_by_size(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Parent, child, ord: children with more leaves first, then by id; sizes has (id, leaves), nodes without are leaves."""
    rows = edges.select("parent", "child").join(sizes.select(F.col("id").alias("child"), "leaves"), "child", "left")
    order = Window.partitionBy("parent").orderBy(F.desc(F.coalesce("leaves", F.lit(1))), "child")
    return rows.select("parent", "child", (F.row_number().over(order) - 1).alias("ord"))


def corpus_centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """A-11: centroids of all groups, and that of the whole table as group null."""
    every = vectors.select(F.lit(None).cast(vectors.schema[group].dataType).alias(group), vector)
    return centroids(vectors.select(group, vector), group, vector).union(centroids(every, group, vector))


def incoherent(vectors: DataFrame, group: str, vector: str, least: float = 0.25) -> DataFrame:
    """Place, grp, n, coherence, incoherent: the least coherent groups first."""
    found = coherence(vectors, group, vector)
    return placed(found.withColumn("incoherent", F.col("coherence") < least), "coherence", "grp").select("place", "grp", "n", "coherence", "incoherent")


def confidence(rows: DataFrame, score: str) -> DataFrame:
    """n, low, low_or_bound, aligned, fallback of concept scores: the conflict table's and the metrics' two bounds."""
    s = F.col(score)
    return rows.agg(F.count("*").alias("n"), F.count_if((s > 0) & (s < 0.25)).alias("low"), F.count_if((s > 0) & (s <= 0.25)).alias("low_or_bound"), F.count_if(s > 0.08).alias("aligned"), F.count_if(s == 0).alias("fallback"))


def balanced(clusters: DataFrame, parent: str, cluster: str, largest: float = 0.7, least: int = 2) -> DataFrame:
    """parent, clusters, balanced: whether no cluster of a parent has over ``largest`` of its members and none has under ``least``."""
    sizes = clusters.groupBy(F.col(parent).alias("parent"), cluster).agg(F.count("*").alias("n"))
    return sizes.groupBy("parent").agg(F.count("*").alias("clusters"), ((F.max("n") <= largest * F.sum("n")) & (F.min("n") >= least)).alias("balanced"))


def conflicts(rows: DataFrame, row: str, text: Column, group: str, family: str) -> DataFrame:
    """Row, current, current_sim, alt_1, sim_1, alt_2, sim_2, decision: how much of a row's words its group has, and the two best other groups of its family.

    Rows and groups meet by their words, so no row meets a group that shares
    none; groups without a shared word count as 0 and come last, by name. A row
    moves if the best other group is over 0.10 better, and is for review if it is better.
    Rows of one family with the same words meet groups as one.
    """
    own = rows.select(F.col(row).alias("row"), F.col(group).alias("grp"), F.col(family).alias("family"), eval_tokens(text).alias("words"))
    kinds = own.select("family", "words").distinct()
    has = own.select("family", F.col("grp").alias("other"), F.explode("words").alias("word")).distinct()
    shared = kinds.select("family", "words", F.explode("words").alias("word")).join(has, ["family", "word"]).groupBy("family", "words", "other").agg(F.count("*").alias("n"))
    groups = own.select("family", F.col("grp").alias("other")).distinct()
    first = groups.groupBy("family").agg(F.slice(F.sort_array(F.collect_set("other")), 1, 3).alias("names"))  # three names stand in for groups that share nothing
    sims = shared.select("family", "words", "other", F.round(F.col("n") / F.size("words"), 3).alias("sim"))
    met = sims.groupBy("family", "words").agg(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other")).alias("met"))
    found = written(kinds.join(met, ["family", "words"], "left").join(first, "family", "left"), "conflict-kinds").withColumnsRenamed({"family": "\u0000f", "words": "\u0000w"})
    out = own.join(found, F.col("family").eqNullSafe(F.col("\u0000f")) & F.col("words").eqNullSafe(F.col("\u0000w"))).drop("\u0000f", "\u0000w")
    known = F.coalesce("met", F.array().cast(met.schema["met"].dataType.simpleString()))
    silent = F.transform(F.array_except("names", F.transform(known, lambda x: x["other"])), lambda n: F.struct(F.lit(-0.0).alias("far"), n.alias("other")))
    ranked = F.array_sort(F.filter(F.concat(known, silent), lambda x: x["other"] != F.col("grp")))
    now = F.coalesce(-F.get(F.filter(known, lambda x: x["other"] == F.col("grp")), F.lit(0))["far"], F.lit(0.0))
    out = out.select("row", F.col("grp").alias("current"), F.abs(now).alias("current_sim"), F.get(ranked, F.lit(0)).alias("a"), F.get(ranked, F.lit(1)).alias("b"))
    sim = {c: F.abs(F.coalesce(F.col(f"{c}.far"), F.lit(0.0))) for c in "ab"}
    out = out.select("row", "current", "current_sim", F.col("a.other").alias("alt_1"), sim["a"].alias("sim_1"), F.col("b.other").alias("alt_2"), sim["b"].alias("sim_2"))
    better = F.round(F.col("sim_1") - F.col("current_sim"), 6)
    return out.withColumn("decision", F.when(better > 0.10, "move").when(better > 0, "review").otherwise("keep"))
