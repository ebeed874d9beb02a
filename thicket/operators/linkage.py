"""Average linkage by cosine distance for groups of any size, and what is built on it.

The mean distance of two clusters of unit vectors follows from their sums of vectors,
``1 - S_a S_b / (n_a n_b)``; where pairs of one family are nearer by a factor, from
their sums by family besides. So a cluster is one row, and no matrix of distances is
kept. Clusters that are each other's nearest are merged all at once, in rounds (the
mean never falls below its parts', so the tree is that of merging one pair at a time);
a group with up to ``LOCAL`` clusters left is finished by one task, many groups at once.
Of equal distances the pair of lower ids goes first. Rows that are told to have the
same vector begin as one cluster, as their distance is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators import lowrank
from thicket.storage import Scratch, dealt, written

#: Groups of up to so many clusters are finished by one task.
LOCAL = 1000
#: Clusters of larger groups meet in pairs of blocks of up to so many, so each is sent as often as its group has blocks.
BLOCK = 16384
#: A group of fewer clusters has so many blocks, if they hold LOCAL clusters each, for enough tasks.
BLOCKS = 4
#: Rows of distances that a task holds at once.
STRIP = 512
STATE = "grp string, id long, n long, total array<double>, families array<struct<family: string, n: long, total: array<double>>>"
MERGES = "grp string, a long, b long, height double, turn int"


class Table:
    """Clusters of a table as arrays: numbers, sums of vectors, and of each family the places, numbers and sums."""

    def __init__(self, rows: pd.DataFrame, factor: float) -> None:
        self.n, self.total, self.families = rows["n"].to_numpy(float), np.stack(rows["total"].to_list()), {}
        for i, own in enumerate(rows["families"]) if factor != 1 else ():
            for f in own:
                self.families.setdefault(f["family"], ([], [], []))
                for held, value in zip(self.families[f["family"]], (i, f["n"], f["total"])):
                    held.append(value)
        self.families = {name: (np.array(i), np.array(n, float), np.stack(t)) for name, (i, n, t) in self.families.items()}

    def strips(self, height: int) -> Iterator[tuple[int, Table]]:
        """Its rows, height at a time, with the place of the first."""
        for at in range(0, len(self.n), height):
            part = Table.__new__(Table)
            part.n, part.total, part.families = self.n[at : at + height], self.total[at : at + height], {}
            for name, (i, n, t) in self.families.items():
                low, high = np.searchsorted(i, [at, at + height])
                if high > low:
                    part.families[name] = (i[low:high] - at, n[low:high], t[low:high])
            yield at, part


def apart(left: Table, right: Table, factor: float) -> np.ndarray:
    """Mean distances of the clusters of two tables."""
    d = np.outer(left.n, right.n) - left.total @ right.total.T
    if factor != 1:
        for name in left.families.keys() & right.families.keys():
            (i, a, x), (j, b, y) = left.families[name], right.families[name]
            d[np.ix_(i, j)] -= (1 - factor) * (np.outer(a, b) - x @ y.T)
    return d / np.outer(left.n, right.n)


def merged(d: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """(kept, gone, height) of all merges by mean distance, in order."""
    d, size, out = d.astype(float).copy(), sizes.astype(float).copy(), []
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1) if len(d) > 1 else np.zeros(len(d), int)
    best = d[np.arange(len(d)), near]
    for _ in range(len(d) - 1):
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        out.append((i, j, float(d[i, j])))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        new[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        stale = np.flatnonzero((near == i) | (near == j))
        near[stale] = d[stale].argmin(axis=1)
        near[i] = d[i].argmin()
        best = d[np.arange(len(d)), near]
        lower = (d[:, i] < best) | ((d[:, i] == best) & (i < near))
        near[lower] = i
        best = d[np.arange(len(d)), near]
    return out


def clusters_of(rows: DataFrame, grp: str, row: str, vector: str, family: Column | None = None, times: Column | None = None) -> DataFrame:
    """One cluster a row, with its vector at length 1 (zeros stay), as often as ``times`` tells."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x * x))
    own = rows.select(F.col(grp).cast("string").alias("grp"), F.col(row).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), norm.alias("norm"), (F.lit("") if family is None else F.coalesce(family, F.lit(""))).alias("family"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    one = F.col("times")
    own = own.withColumn("total", F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm") * one).otherwise(0.0)))
    families = F.when(F.col("family") == "", F.array().cast("array<struct<family: string, n: long, total: array<double>>>")).otherwise(F.array(F.struct("family", one.alias("n"), "total")))
    return own.select("grp", "id", one.alias("n"), "total", families.alias("families"))


def nearest(state: DataFrame, blocks: DataFrame, factor: float) -> DataFrame:
    """grp, a, b, height of the clusters that are each other's nearest; blocks has (grp, blocks)."""
    placed = state.join(F.broadcast(blocks), F.col("grp").eqNullSafe(F.col("\u0000g"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select(*state.columns, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def work(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("id").reset_index(drop=True)
        low, high = int(found["low"].iloc[0]), int(found["high"].iloc[0])
        left, right = found[found["own"] == low], found[found["own"] == high]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["grp", "id", "d", "near"])
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        one = Table(left, factor)
        two = one if low == high else Table(right, factor)
        # Of equal distances the pair of lower ids is that of the lower other id; ids ascend, and the first of equals is kept.
        least, near = np.full(len(y), np.inf), np.zeros(len(y), np.int64)
        out = []
        for at, strip in one.strips(STRIP):
            d = apart(strip, two, factor)
            rows = np.arange(len(d))
            if low == high:
                d[rows, at + rows] = np.inf
            else:
                first = d.argmin(axis=0)
                lower = d[first, np.arange(len(y))]
                better = lower < least
                least[better], near[better] = lower[better], x[at + first[better]]
            first = d.argmin(axis=1)
            out.append(pd.DataFrame({"id": x[at : at + len(d)], "d": d[rows, first], "near": y[first]}))
        if low != high:
            out.append(pd.DataFrame({"id": y, "d": least, "near": near}))
        out = pd.concat(out)
        out = out[np.isfinite(out["d"])]
        return out.assign(grp=found["grp"].iloc[0])[["grp", "id", "d", "near"]]

    told = dealt(spread, "grp", "low", "high").groupBy("grp", "low", "high").applyInPandas(work, "grp string, id long, d double, near long")
    pair = F.struct("d", F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"))
    best = told.groupBy("grp", "id").agg(F.min(pair).alias("p")).select("grp", "p.a", "p.b", "p.d")
    # A pair that both of its clusters name is one of nearest to each other.
    return best.groupBy("grp", "a", "b").agg(F.count("*").alias("both"), F.min("d").alias("height")).where("both = 2").select("grp", "a", "b", "height")


def joined(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """state with the clusters of each pair (a, b) as one, named a."""
    into = pairs.select(F.col("grp").alias("\u0000g"), F.col("b").alias("\u0000b"), "a")
    moved = state.join(into, F.col("grp").eqNullSafe(F.col("\u0000g")) & (F.col("id") == F.col("\u0000b")), "left").select("grp", F.coalesce("a", "id").alias("id"), "n", "total", "families")

    def added(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: a + b)

    summed = F.aggregate(F.slice("totals", 2, F.size("totals")), F.get("totals", F.lit(0)), added)
    parts = moved.groupBy("grp", "id").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"), F.flatten(F.collect_list("families")).alias("f"))  # two rows at most
    names = F.array_distinct(F.transform("f", lambda f: f["family"]))

    def family(name: Column) -> Column:
        own = F.filter("f", lambda f: f["family"] == name)
        lists = F.transform(own, lambda f: f["total"])
        return F.struct(name.alias("family"), F.aggregate(own, F.lit(0).cast("long"), lambda a, f: a + f["n"]).alias("n"), F.when(F.size(own) > 1, added(lists[0], F.get(lists, F.lit(1)))).otherwise(lists[0]).alias("total"))

    return parts.select("grp", "id", "n", summed.alias("total"), F.transform(names, family).alias("families"))


def merges(state: DataFrame, factor: float = 1.0, local: int = LOCAL) -> DataFrame:
    """grp, a, b, height, turn of all merges of each group; state comes from clusters_of()."""
    tables, done, turn = Scratch(), None, 0
    state = tables.written(state, "linkage-state")
    while True:
        sizes = state.groupBy("grp").agg(F.count("*").alias("c"))
        large = sizes.where(F.col("c") > local).select(F.col("grp").alias("\u0000g"), F.greatest(F.ceil(F.col("c") / BLOCK), F.least(F.ceil(F.col("c") / LOCAL), F.lit(BLOCKS))).cast("long").alias("blocks"))
        large = tables.written(large, "linkage-large")  # a row for each large group
        if large.isEmpty():
            break
        big = state.join(F.broadcast(large.select("\u0000g")), F.col("grp").eqNullSafe(F.col("\u0000g")), "left_semi")
        pairs = tables.written(nearest(big, large, factor).withColumn("turn", F.lit(turn)), "linkage-pairs")
        done = pairs if done is None else done.union(pairs)
        after = tables.written(joined(state, pairs), "linkage-state")
        tables.clear(state, large)
        state, turn = after, turn + 1

    def finish(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("id").reset_index(drop=True)
        ids = found["id"].tolist()
        own = Table(found, factor)
        told = merged(apart(own, own, factor), own.n) if len(ids) > 1 else []
        return pd.DataFrame([(found["grp"].iloc[0], ids[i], ids[j], h, turn + at) for at, (i, j, h) in enumerate(told)], columns=["grp", "a", "b", "height", "turn"])

    rest = tables.written(dealt(state, "grp").groupBy("grp").applyInPandas(finish, MERGES), "linkage-rest")
    tables.clear(state)
    return rest if done is None else done.select("grp", "a", "b", "height", "turn").union(rest)


def cut(rows: DataFrame, told: DataFrame, wanted: DataFrame) -> DataFrame:
    """grp, id, cluster: the clusters (named by their smallest id) once a group has the wanted number of them; rows has (grp, id), wanted (grp, k)."""
    tables = Scratch()
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).join(wanted, "grp")
    order = Window.partitionBy("grp").orderBy("height", "turn", "a")
    kept = told.withColumn("nth", F.row_number().over(order)).join(sizes, "grp").where(F.col("nth") <= F.col("n") - F.col("k")).select("grp", F.col("b").alias("id"), F.col("a").alias("up"))
    up = tables.written(rows.select("grp", "id").join(kept, ["grp", "id"], "left").select("grp", "id", F.coalesce("up", "id").alias("up")), "linkage-up")
    while True:  # each pointer is taken to where it points, twice as far each time
        far = up.select("grp", F.col("id").alias("up"), F.col("up").alias("far"))
        after = tables.written(up.join(far, ["grp", "up"]).select("grp", "id", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "linkage-up")
        moved = not after.where("moved").isEmpty()
        tables.clear(up)
        up = after.select("grp", "id", "up") if not moved else tables.written(after.select("grp", "id", "up"), "linkage-up")
        if not moved:
            return up.withColumnRenamed("up", "cluster")


def numbered_clusters(found: DataFrame) -> DataFrame:
    """grp, id, cluster with clusters numbered from 0 in each group by their smallest row."""
    names = found.select("grp", "cluster").distinct()
    number = (F.row_number().over(Window.partitionBy("grp").orderBy("cluster")) - 1).cast("int")
    return found.join(names.withColumn("number", number), ["grp", "cluster"]).select("grp", "id", F.col("number").alias("cluster"))


def family_clusters(rows: DataFrame, grp: str, row: str, vector: str, family: Column | None = None, most: int = 8, factor: float = 0.8, local: int = LOCAL) -> DataFrame:
    """M5: grp, id, cluster: min(most, max(2, n // 3), n) clusters of each group, pairs of one family nearer by factor."""
    tables = Scratch()
    state = tables.written(clusters_of(rows, grp, row, vector, family), "linkage-rows")
    k = F.least(F.lit(most).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.col("n") / 3)), F.col("n"))
    wanted = state.groupBy("grp").agg(F.count("*").alias("n")).select("grp", k.alias("k"))
    return numbered_clusters(cut(state.select("grp", "id"), merges(state, 1.0 if family is None else factor, local), wanted))


def equal_clusters(rows: DataFrame, vectors: DataFrame, most: int = 8, local: int = LOCAL) -> DataFrame:
    """As family_clusters() without families, of rows (grp, id, same) and vectors (same, vector), both without nulls in same: rows of one vector begin as one cluster.

    Rows without direction (zeros) are as far from each other as from any, so each begins alone.
    """
    tables = Scratch()
    flat = vectors.select("same", F.forall("vector", lambda x: x == 0).alias("flat"))
    alone = F.when(F.col("flat"), F.col("id"))
    rows = written(rows.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("long").alias("id"), "same").join(flat, "same").select("grp", "id", "same", F.coalesce(alone, F.lit(-1).cast("long")).alias("own")), "linkage-equal")
    kinds = tables.written(rows.groupBy("grp", "same", "own").agg(F.min("id").alias("id"), F.count("*").alias("times")), "linkage-kinds")
    state = tables.written(clusters_of(kinds.join(vectors, "same"), "grp", "id", "vector", times=F.col("times")), "linkage-rows")
    sizes = kinds.groupBy("grp").agg(F.sum("times").alias("n"), F.count("*").alias("kinds"))
    k = F.least(F.lit(most).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.col("n") / 3)), F.col("n"))
    wanted = tables.written(sizes.select("grp", k.alias("wanted"), "kinds"), "linkage-wanted")
    told = cut(state.select("grp", "id"), merges(state, 1.0, local), wanted.select("grp", F.least("wanted", "kinds").alias("k")))
    placed = kinds.join(told, ["grp", "id"]).select("grp", "same", "own", F.col("id").alias("first"), "cluster")
    found = rows.join(placed, ["grp", "same", "own"])
    # With fewer vectors than clusters the last merges of equal rows, which come in order of ids, are not made.
    few = wanted.where(F.col("wanted") > F.col("kinds")).select("grp", (F.col("wanted") - F.col("kinds")).alias("more"))
    last = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("first"), F.desc("id")))
    alone = found.join(F.broadcast(few), "grp").where(F.col("id") != F.col("first")).withColumn("r", last).where(F.col("r") <= most).where(F.col("r") <= F.col("more")).select("grp", "id", F.lit(True).alias("alone"))
    out = found.join(alone, ["grp", "id"], "left").select("grp", "id", F.when(F.col("alone"), F.col("id")).otherwise(F.col("cluster")).alias("cluster"))
    return numbered_clusters(written(out, "linkage-equal"))


def silhouettes(state: DataFrame, labels: DataFrame) -> DataFrame:
    """grp, k, score: mean cosine silhouettes of labels (grp, k, id, cluster), exact, from sums of clusters; members of clusters of one score 0."""
    unit = state.select("grp", "id", "total")
    own = labels.join(unit, ["grp", "id"])
    spread = own.select("grp", "k", "cluster", F.posexplode("total").alias("i", "x"))
    totals = spread.groupBy("grp", "k", "cluster", "i").agg(F.sum("x").alias("s"))
    sums = totals.groupBy("grp", "k", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("sum"))
    sizes = labels.groupBy("grp", "k", "cluster").agg(F.count("*").alias("m"))
    centres = sums.join(sizes, ["grp", "k", "cluster"]).select("grp", "k", F.col("cluster").alias("c"), "sum", "m")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    # A row meets the few clusters of its group.
    met = own.join(centres, ["grp", "k"])
    far = F.when(F.col("c") == F.col("cluster"), (F.col("m") - dot(F.col("total"), F.col("sum")) - (1 - dot(F.col("total"), F.col("total")))) / (F.col("m") - 1)).otherwise(1 - dot(F.col("total"), F.col("sum")) / F.col("m"))
    each = met.select("grp", "k", "id", (F.col("c") == F.col("cluster")).alias("mine"), "m", F.when((F.col("c") != F.col("cluster")) | (F.col("m") > 1), far).alias("far"))
    a, b = F.max(F.when(F.col("mine"), F.col("far"))), F.min(F.when(~F.col("mine"), F.col("far")))
    told = each.groupBy("grp", "k", "id").agg(a.alias("a"), b.alias("b"), F.max(F.when(F.col("mine"), F.col("m"))).alias("m"))
    score = F.when((F.col("m") > 1) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))).otherwise(0.0)
    return told.groupBy("grp", "k").agg(F.avg(score).alias("score"))


def best_clusters(rows: DataFrame, grp: str, row: str, vector: str, least: int = 2, most: int = 6, local: int = LOCAL) -> DataFrame:
    """Grp, id, cluster, k, score: average linkage cut at least to most clusters, whichever has the best cosine silhouette (the fewest of equals). Groups of up to `least` rows have none."""
    tables, kept = Scratch(), Scratch()
    state = tables.written(clusters_of(rows, grp, row, vector), "linkage-rows")
    told = tables.written(merges(state, 1.0, local), "linkage-merges")
    sizes = state.groupBy("grp").agg(F.count("*").alias("n"))
    labels = None
    for k in range(least, most + 1):
        wanted = sizes.where(F.col("n") > k).select("grp", F.lit(k).cast("long").alias("k"))
        own = cut(state.join(wanted.select("grp"), "grp", "left_semi").select("grp", "id"), told, wanted).withColumn("k", F.lit(k))
        labels = own if labels is None else labels.unionByName(own)
    labels = kept.written(labels.select("grp", "k", "id", "cluster"), "linkage-labels")
    scores = silhouettes(state, labels)
    best = kept.written(scores.groupBy("grp").agg(F.max(F.struct(F.round("score", 12).alias("score"), (-F.col("k")).alias("k"))).alias("b")).select("grp", (-F.col("b.k")).alias("k"), "b.score"), "linkage-best")
    tables.clear()
    chosen = labels.join(best, ["grp", "k"])
    number = numbered_clusters(chosen.select("grp", "id", "cluster"))
    return number.join(best, "grp").select("grp", "id", "cluster", "k", "score")


def text_clusters(rows: DataFrame, grp: str, row: str, text: Column, most: int = 8, max_features: int = 500, stop: list[str] | None = None, local: int = LOCAL) -> DataFrame:
    """M6: grp, id, cluster, label: average linkage of TF-IDF weights, labelled by the term of over three letters whose mean weight inside is most above that outside (ties: the smaller term), else ``Group n``.

    Weights are over the max_features commonest terms of the whole table. A group of one row has an empty label.
    """
    tables = Scratch()
    words = lowrank.vocabulary(rows, text, max_features, stop=stop)
    own = rows.select(F.col(grp).cast("string").alias("grp"), F.col(row).cast("long").alias("id"), text.alias("text"))
    # Each different text is weighed once.
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    weights = tables.written(lowrank.packed(own.select("text").distinct(), "text", F.col("text"), words), "text-weights")
    dense = lowrank.projected(weights, np.eye(len(words.terms))).withColumnRenamed("key", "text")
    found = tables.written(equal_clusters(own.select("grp", "id", F.col("text").alias("same")), dense.withColumnRenamed("text", "same"), most, local), "text-clusters")
    held = own.join(found, ["grp", "id"]).groupBy("grp", "cluster", "text").agg(F.count("*").alias("times"))
    pairs = held.join(weights.withColumnRenamed("key", "text"), "text").select("grp", "cluster", "times", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    inside = pairs.groupBy("grp", "cluster", F.col("x.terms").alias("t")).agg(F.sum(F.col("x.weights") * F.col("times")).alias("s"))
    every = inside.groupBy("grp", "t").agg(F.sum("s").alias("all"))
    sizes = found.groupBy("grp", "cluster").agg(F.count("*").alias("n"))
    total = sizes.groupBy("grp").agg(F.sum("n").alias("of"))
    names = rows.sparkSession.createDataFrame(list(enumerate(words.terms)), "t int, term string")  # the vocabulary
    outside = F.when(F.col("of") > F.col("n"), (F.col("all") - F.col("s")) / (F.col("of") - F.col("n"))).otherwise(0.0)
    scored = inside.join(every, ["grp", "t"]).join(sizes, ["grp", "cluster"]).join(total, "grp").join(F.broadcast(names), "t").where(F.length("term") > 3).select("grp", "cluster", "term", F.round(F.col("s") / F.col("n") - outside, 9).alias("score"))
    first = F.row_number().over(Window.partitionBy("grp", "cluster").orderBy(F.desc("score"), "term"))
    best = scored.withColumn("r", first).where("r = 1").select("grp", "cluster", F.initcap("term").alias("term"))
    label = F.when(F.col("of") <= 1, F.lit("")).otherwise(F.coalesce("term", F.concat(F.lit("Group "), (F.col("cluster") + 1).cast("string"))))
    return found.join(total, "grp").join(best, ["grp", "cluster"], "left").select("grp", "id", "cluster", label.alias("label"))


def phrase_roles(rows: DataFrame, phrases: DataFrame, vectors: DataFrame, least_rows: int = 4, least_phrases: int = 4, coverage: float = 0.5, regularity: float = 0.4, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Roles of phrases from their vectors: (grp, role, phrases) and (grp, row, role, phrase), of groups that are regular and covered enough.

    rows has (grp, row), phrases (grp, row, phrase) once each, vectors (phrase, vector). A
    group needs least_rows rows, a share ``regularity`` of them with two phrases or more,
    and least_phrases phrases. Clusters of two phrases or more are roles, named ``cluster_n``;
    two of them are needed, and a share ``coverage`` of rows with one. A row's phrase in a role is its longest (ties: the smaller).
    """
    tables, phrases = Scratch(), phrases.select("grp", "row", "phrase")
    each = phrases.groupBy("grp", "row").agg(F.count("*").alias("p"))
    regular = rows.join(each, ["grp", "row"], "left").groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.coalesce("p", F.lit(0)) >= 2).cast("int")).alias("share"))
    kinds = phrases.select("grp", "phrase").distinct()
    fine = regular.join(kinds.groupBy("grp").agg(F.count("*").alias("kinds")), "grp").where((F.col("n") >= least_rows) & (F.col("share") >= regularity) & (F.col("kinds") >= least_phrases)).select("grp", "n")
    number = F.row_number().over(Window.partitionBy("grp").orderBy("phrase"))
    known = tables.written(kinds.join(fine, "grp").join(vectors, "phrase").withColumn("id", number).select("grp", "id", "phrase", "vector", "n"), "role-phrases")
    found = best_clusters(known, "grp", "id", "vector", local=local)
    own = known.select("grp", "id", "phrase", "n").join(found, ["grp", "id"])
    sizes = own.groupBy("grp", "cluster").agg(F.count("*").alias("size")).where("size >= 2")
    enough = sizes.groupBy("grp").agg(F.count("*").alias("roles")).where("roles >= 2").select("grp")
    named = tables.written(own.join(sizes, ["grp", "cluster"]).join(enough, "grp").select("grp", "n", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("role"), "phrase"), "phrase-roles")
    met = phrases.join(named, ["grp", "phrase"])
    longest = F.max(F.struct(F.length("phrase").alias("l"), F.col("phrase")))
    assigned = met.groupBy("grp", "row", "role", "n").agg(longest.alias("top"), F.min("phrase").alias("first"))
    # Of equal lengths the smaller phrase.
    ties = met.withColumn("l", F.length("phrase")).join(assigned.select("grp", "row", "role", F.col("top.l").alias("l")), ["grp", "row", "role", "l"])
    chosen = ties.groupBy("grp", "row", "role", "n").agg(F.min("phrase").alias("phrase"))
    covered = chosen.groupBy("grp", "n").agg(F.count_distinct("row").alias("c")).where(F.col("c") / F.col("n") >= coverage).select("grp")
    roles = named.join(covered, "grp", "left_semi").groupBy("grp", "role").agg(F.sort_array(F.collect_list("phrase")).alias("phrases"))
    return roles, chosen.join(covered, "grp", "left_semi").select("grp", "row", "role", "phrase")
