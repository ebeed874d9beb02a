"""Tree and partition metrics (A-12, A-13, M13, V1-V9, J6-J10, U1, U2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import PATH_SEP, eval_tokens
from thicket.operators.tree import ROOT, Tree, closure, first_parents, structural_stats
from thicket.storage import written

#: Numbers that are told at once where a range of them is.
STRIDE = 10_000


def contingency(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """a, b, n: how many rows have each pair of cluster and label."""
    return rows.groupBy(F.col(cluster).cast("string").alias("a"), F.col(label).cast("string").alias("b")).agg(F.count("*").alias("n"))


def purity(table: DataFrame) -> DataFrame:
    """A-12."""
    best = table.groupBy("a").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.agg(F.round(F.sum("m") / F.sum("n"), 4).alias("purity"))


def ari(table: DataFrame) -> DataFrame:
    """A-13: adjusted Rand index; 1 where it is undefined."""

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    cells = table.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    a = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    b = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    one = cells.join(a, F.lit(True)).join(b, F.lit(True))
    expected = F.col("i") * F.col("j") / pairs(F.col("n"))
    top = (F.col("i") + F.col("j")) / 2
    return one.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected)), 4).alias("ari"))


def _entropies(table: DataFrame) -> DataFrame:
    total = table.agg(F.sum("n").alias("t"))

    def entropy(side: str, name: str) -> DataFrame:
        sums = table.groupBy(side).agg(F.sum("n").alias("s")).join(total, F.lit(True))
        return sums.agg((-F.sum(F.col("s") / F.col("t") * F.log(F.col("s") / F.col("t")))).alias(name))

    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    cells = table.withColumn("sa", F.sum("n").over(wa)).withColumn("sb", F.sum("n").over(wb)).join(total, F.lit(True))
    mutual = cells.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("sa") * F.col("sb")))).alias("mi"))
    return mutual.join(entropy("a", "ha"), F.lit(True)).join(entropy("b", "hb"), F.lit(True))


def nmi(table: DataFrame) -> DataFrame:
    """A-13: mutual information over the mean of entropies; 1 if both are 0."""
    mean = (F.col("ha") + F.col("hb")) / 2
    return _entropies(table).select(F.round(F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean), 4).alias("nmi"))


def ami(table: DataFrame) -> DataFrame:
    """A-13: adjusted for chance. The expected information sums over cell sizes of each pair of margins, from log-factorials.

    Pairs of margins with the same sizes are one row, so the sum runs over
    distinct sizes, not over clusters.
    """
    a = table.groupBy("a").agg(F.sum("n").alias("x")).groupBy("x").agg(F.count("*").alias("ca"))
    b = table.groupBy("b").agg(F.sum("n").alias("y")).groupBy("y").agg(F.count("*").alias("cb"))
    total = table.agg(F.sum("n").alias("t"))
    pairs = a.join(b, F.lit(True)).join(total, F.lit(True))
    # Overlaps of a pair of sizes are told in two steps, so that no array is longer than STRIDE or their number by it.
    low, high = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - F.col("t")), F.least("x", "y")
    cells = pairs.withColumn("from", F.explode(F.sequence(low, high, F.lit(STRIDE).cast("long")))).withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + STRIDE - 1, high))))

    def lf(v: Column) -> Column:
        """ln v! by Stirling's series from 20 on, exact below."""
        v = v.cast("double")
        big = v * F.log(v) - v + 0.5 * F.log(2 * F.pi() * v) + 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v**5)
        return F.when(v < 20, F.log(F.factorial(F.least(v, F.lit(20.0)).cast("int")).cast("double"))).otherwise(big)

    x, y, t, k = (F.col(c) for c in "xytk")
    log_p = lf(x) + lf(y) + lf(t - x) + lf(t - y) - lf(t) - lf(k) - lf(x - k) - lf(y - k) - lf(t - x - y + k)
    expected = cells.agg(F.sum(F.col("ca") * F.col("cb") * (k / t) * F.log(t * k / (x * y)) * F.exp(log_p)).alias("emi"))
    one = _entropies(table).join(expected, F.lit(True))
    gap = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    return one.select(F.round(F.when(F.abs(gap) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("emi")) / gap), 4).alias("ami"))


def coherence(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Grp, n, coherence: mean cosine of the pairs in a group, from the length of the sum of unit vectors; pairs never meet.

    Groups of one have coherence 1.
    """
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, c: s + c.cast("double") * c.cast("double")))
    spread = vectors.select(F.col(group).alias("grp"), F.posexplode(F.transform(v, lambda c: c.cast("double") / norm)).alias("pos", "c"))
    sums = spread.groupBy("grp", "pos").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    return sums.groupBy("grp").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select("grp", "n", F.round(F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0), 6).alias("coherence"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """A-10: grp, pos, c of the unit-length mean of unit vectors, long."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, c: s + c.cast("double") * c.cast("double")))
    spread = vectors.select(F.col(group).alias("grp"), F.posexplode(F.transform(v, lambda c: c.cast("double") / norm)).alias("pos", "c"))
    mean = spread.groupBy("grp", "pos").agg(F.avg("c").alias("c"))
    return mean.select("grp", "pos", (F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("grp")))).alias("c"))


def nearest_centroids(vectors: DataFrame, id_col: str, group: str, vector: str, margin: float = 0.02, most_groups: int = 5_000) -> DataFrame:
    """Id, current, best, moves: the group whose centroid is nearest, and whether it beats the current one by the margin.

    Centroids are one row per group, broadcast if there are few.
    """
    middle = centroids(vectors, group, vector).groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("m"))
    middle = written(middle, "centroids")
    if middle.count() > most_groups:
        raise ValueError("too many groups to hold against each vector; split the table by a coarser group first")
    table = middle.agg(F.collect_list(F.struct("grp", "m")).alias("all"))
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, c: s + c.cast("double") * c.cast("double")))
    unit = F.transform(v, lambda c: c.cast("double") / norm)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group).alias("current"), unit.alias("u")).join(F.broadcast(table), F.lit(True))
    sims = F.transform("all", lambda g: F.struct(F.round(F.aggregate(F.zip_with(g["m"], F.col("u"), lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, c: s + c), 9).alias("sim"), g["grp"].alias("grp")))
    best = F.array_max(F.transform("sims", lambda s: F.struct(s["sim"].alias("sim"), (-s["grp"]).alias("low"), s["grp"].alias("grp"))))
    now = F.get(F.filter("sims", lambda s: s["grp"] == F.col("current")), F.lit(0))["sim"]
    out = rows.withColumn("sims", sims).select("id", "current", best.alias("b"), now.alias("now"))
    return out.select("id", "current", F.col("b.grp").alias("best"), ((F.col("b.grp") != F.col("current")) & (F.col("b.sim") > F.col("now") + margin)).alias("moves"))


def npmi(nodes: DataFrame, texts: DataFrame, id_col: str, text_col: str, top: int = 5) -> DataFrame:
    """V2: mean over aggregations of the mean NPMI of their label's terms; pairs are counted only where a label needs them."""
    tokens = texts.select(F.col(id_col).alias("doc"), eval_tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    total = tokens.agg(F.count("*").alias("n"))
    labels = nodes.where("type = 'aggregation'").select("id", F.explode(eval_tokens(F.col("name"))).alias("term"))
    wanted = labels.select("term").distinct()
    present = written(tokens.select("doc", F.explode("t").alias("term")).join(F.broadcast(wanted) if wanted.limit(100_001).count() <= 100_000 else wanted, "term", "left_semi"), "npmi-terms")
    df = present.groupBy("term").agg(F.count("*").alias("df"))
    chosen = labels.join(df, "term").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), "term"))).where(F.col("r") <= top)
    a, b = chosen.select("id", F.col("term").alias("x"), F.col("df").alias("dx")), chosen.select("id", F.col("term").alias("y"), F.col("df").alias("dy"))
    needed = written(a.join(b, "id").where("x < y"), "npmi-pairs")
    pairs = needed.select("x", "y").distinct()
    together = pairs.join(present.select("doc", F.col("term").alias("x")), "x").join(present.select("doc", F.col("term").alias("y")), ["doc", "y"]).groupBy("x", "y").agg(F.count("*").alias("c"))
    scored = needed.join(together, ["x", "y"], "left").join(total, F.lit(True))
    p = (F.coalesce("c", F.lit(0)) + 1e-12) / F.col("n")
    pmi = F.log(p / (F.col("dx") / F.col("n") * (F.col("dy") / F.col("n")) + 1e-12) + 1e-12)
    means = scored.groupBy("id").agg(F.avg(pmi / (-F.log(p + 1e-12))).alias("m"))
    return means.agg(F.round(F.coalesce(F.avg("m"), F.lit(0.0)), 4).alias("npmi"))


def lineage(tree: Tree) -> DataFrame:
    """Leaf, ancestor, depth of leaves below the root, by names."""
    up = closure(tree.edges).where(f"anc <> {ROOT}")
    leaf = tree.nodes.where("type = 'attribute'").select(F.col("id").alias("desc"), F.col("name").alias("leaf"))
    return up.join(leaf, "desc").select("leaf", F.col("anc").alias("ancestor"), "dist")


def _pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """Number of unordered pairs of leaves that agree in all keys, from group sizes."""
    sizes = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long").alias("pairs"))


def _matched(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Leaf, and full and first keys of its path in both trees (null without ancestors), of leaves that both have; of a leaf that comes more than once, the last path in order."""

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        own = rows.groupBy("leaf").agg(F.max("path").alias("path"))
        full = F.when(F.size("path") > 0, F.array_join("path", PATH_SEP))
        return own.select("leaf", full.alias(f"{side}_full"), F.get("path", F.lit(0)).alias(f"{side}_first"))

    return keyed(system, "s").join(keyed(gold, "g"), "leaf")


def _counted(rows: DataFrame, **keys: tuple[str, ...]) -> DataFrame:
    """One row with n_matched_leaves and, by name, the number of unordered pairs that agree in the keys. Pairs are counted from group sizes and never made."""
    one = rows.agg(F.count("*").alias("n_matched_leaves"))
    for name, own in keys.items():
        one = one.join(_pairs(rows, *own).withColumnRenamed("pairs", name), F.lit(True))
    return one


def _scores(rows: DataFrame, s: str, g: str, prefix: str) -> DataFrame:
    """Precision, recall and F1 of pairs; 1 if both trees have none."""
    one = _counted(rows, s=(s,), g=(g,), t=(s, g))
    empty = (F.col("s") == 0) & (F.col("g") == 0)
    p = F.when(empty, 1.0).when(F.col("s") == 0, 0.0).otherwise(F.col("t") / F.col("s"))
    r = F.when(empty, 1.0).when(F.col("g") == 0, 0.0).otherwise(F.col("t") / F.col("g"))
    return one.select("n_matched_leaves", F.round(p, 4).alias(f"{prefix}_p"), F.round(r, 4).alias(f"{prefix}_r"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias(f"{prefix}_f1"))


def edge_f1(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Of pairs of shared leaves with the same immediate parent; both have (leaf, path array)."""
    return _scores(_matched(system, gold), "s_full", "g_full", "edge")


def ancestor_f1(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Of pairs of shared leaves that share any ancestor, which is to share the first."""
    return _scores(_matched(system, gold), "s_first", "g_first", "ancestor")


def refinement(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Of pairs of shared leaves, siblings in the system that gold groups nowhere (wrong_merge), gold's siblings that the system groups only higher up (refined) or nowhere (missed), and their rates."""
    one = _counted(_matched(system, gold), n_system=("s_full",), n_gold=("g_full",), grouped=("s_full", "g_first"), within=("g_full", "s_first"), same=("g_full", "s_full"))
    wrong, refined, missed = F.col("n_system") - F.col("grouped"), F.col("within") - F.col("same"), F.col("n_gold") - F.col("within")

    def rate(n: Column, of: str) -> Column:
        return F.round(F.when(F.col(of) > 0, n / F.col(of)).otherwise(0.0), 4)

    return one.select("n_matched_leaves", "n_system", "n_gold", wrong.alias("wrong_merge"), refined.alias("refined"), missed.alias("missed"), rate(wrong, "n_system").alias("wrong_merge_rate"), rate(refined, "n_gold").alias("refinement_rate"), rate(missed, "n_gold").alias("missed_rate"))


def top_clusters(tree: Tree) -> DataFrame:
    """V4: leaf (id), name, cluster of each leaf: its ancestor right below the root; a leaf at the root is a cluster of its own."""
    first = tree.edges.where(f"parent = {ROOT}").select(F.col("child").alias("anc"))
    below = closure(tree.edges).join(first, "anc", "left_semi").groupBy(F.col("desc").alias("id")).agg(F.min("anc").alias("anc"))
    leaves = tree.nodes.where("type = 'attribute'").select("id", "name")
    return leaves.join(below, "id", "left").select(F.col("id").alias("leaf"), "name", F.coalesce("anc", "id").alias("cluster"))


def node_ids(rows: DataFrame, tree: Tree, name: str, by: str = "name") -> DataFrame:
    """Rows with node, the id of the leaf whose column ``by`` (its name, or ``leaf_id`` where nodes carry it) is that of rows, the smallest of several, -1 if there is none."""
    leaves = tree.nodes.where("type = 'attribute'").groupBy(F.col(by).alias("\u0000name")).agg(F.min("id").alias("node"))
    return rows.join(leaves, F.col(name) == F.col("\u0000name"), "left").drop("\u0000name").withColumn("node", F.coalesce("node", F.lit(-1).cast("long")))


def group_preservation(tree: Tree, rows: DataFrame, name: str, group: str, by: str = "name") -> DataFrame:
    """V4: purity, ari, nmi, ami of the clusters right below the root against the rows' groups; rows without a leaf take no part. ``by`` as in node_ids(): names may repeat, leaf ids do not."""
    found = node_ids(rows.select(F.col(name).alias("name"), F.col(group).alias("group")), tree, "name", by).where("node >= 0")
    table = written(contingency(found.join(top_clusters(tree).select(F.col("leaf").alias("node"), "cluster"), "node"), "cluster", "group"), "preservation")
    return purity(table).join(ari(table), F.lit(True)).join(nmi(table), F.lit(True)).join(ami(table), F.lit(True))


def leaf_paths(tree: Tree) -> DataFrame:
    """leaf (name) and the path of its ancestors' ids below the root, as strings."""
    up = closure(tree.edges).where(f"anc <> {ROOT}").groupBy("desc").agg(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("dist", "anc")))), lambda x: x["anc"].cast("string")).alias("path"))
    leaves = tree.nodes.where("type = 'attribute'").select(F.col("id").alias("desc"), F.col("name").alias("leaf"))
    return leaves.join(up, "desc", "left").select("leaf", F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def bundle(tree: Tree, rows: DataFrame | None = None, name: str = "leaf", group: str = "group", gold: DataFrame | None = None, by: str = "name") -> DataFrame:
    """V9: one row of structural statistics and label quality, of group preservation where rows (name, group) are given, and of all gold scores where gold (leaf, path) is."""
    one = structural_stats(tree).join(label_quality(tree), F.lit(True))
    if rows is not None:
        one = one.join(group_preservation(tree, rows, name, group, by), F.lit(True))
    if gold is not None:
        own = written(leaf_paths(tree), "leaf-paths")
        more = [edge_f1(own, gold), ancestor_f1(own, gold), set_overlap(own, gold), refinement(own, gold)]
        for scores in more:
            one = one.join(scores.drop(*[c for c in scores.columns if c in one.columns]), F.lit(True))
    return one


def _prefixes(rows: DataFrame) -> DataFrame:
    return rows.select("leaf", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.array_join(F.slice("path", F.lit(1), n), " > "))).alias("k"))


def set_overlap(system: DataFrame, gold: DataFrame) -> DataFrame:
    """V7: mean best Jaccard of system clusters, of gold clusters, and their F1; clusters are the leaf sets of at least 2 under a prefix."""
    leaves = system.select("leaf").distinct().join(gold.select("leaf").distinct(), "leaf")
    a, b = _prefixes(system).distinct().join(leaves, "leaf"), _prefixes(gold).distinct().join(leaves, "leaf")

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("k").agg(F.count("*").alias("n")).where("n >= 2"), "k")

    a, b = sized(a).select("leaf", F.col("k").alias("i"), F.col("n").alias("ni")), sized(b).select("leaf", F.col("k").alias("j"), F.col("n").alias("nj"))
    both = a.join(b, "leaf").groupBy("i", "j", "ni", "nj").agg(F.count("*").alias("c")).withColumn("jac", F.col("c") / (F.col("ni") + F.col("nj") - F.col("c")))
    p = a.select("i").distinct().join(both.groupBy("i").agg(F.max("jac").alias("m")), "i", "left").agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("p"))
    r = b.select("j").distinct().join(both.groupBy("j").agg(F.max("jac").alias("m")), "j", "left").agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("r"))
    one = p.join(r, F.lit(True)).select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("r", F.lit(0.0)).alias("r"))
    return one.select(F.round("p", 4).alias("overlap_p"), F.round("r", 4).alias("overlap_r"), F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 4).alias("overlap_f1"))


def label_quality(tree: Tree, is_noun: Column | None = None) -> DataFrame:
    """V5: of aggregations: % whose name is a short phrase (1 to 3 words, no slash, its last word a noun), % that repeat a sibling's name, average words. Words are runs of a-z and 0-9. is_noun is a condition on ``head``; without one, heads of over 2 letters count."""
    plain = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != "")
    inner = tree.nodes.where("type = 'aggregation'").select(F.col("id").alias("child"), "name", plain.alias("words"))
    inner = inner.withColumn("head", F.coalesce(F.try_element_at("words", F.lit(-1)), F.lit("")))
    noun = F.length("head") > 2 if is_noun is None else is_noun
    concept = ~F.col("name").contains("/") & F.size("words").between(1, 3) & noun
    own = inner.agg(F.round(100 * F.avg(concept.cast("int")), 1).alias("concept_label_pct"), F.round(F.avg(F.size("words")), 2).alias("avg_label_words"), F.count("*").alias("n"))
    kids = first_parents(tree).join(inner, "child", "right").groupBy("parent").agg(F.count("*").alias("k"), F.count_distinct(F.array_join("words", " ")).alias("d"))
    one = own.join(kids.agg(F.sum(F.col("k") - F.col("d")).alias("again")), F.lit(True))
    return one.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("concept_label_pct", "avg_label_words")], F.coalesce(F.round(100 * F.col("again") / F.col("n"), 1), F.lit(0.0)).alias("redundancy_pct"))


def label_diversity(tree: Tree, table: DataFrame) -> DataFrame:
    """A-15: parent_child and sibling_diversity of aggregations with two or more aggregations below, n_aggregations, n_singletons; table has (doc = node id, term, tfidf) of unit length.

    A parent's diversity is 1 less its children's pairwise cosines over the square of their number.
    """
    inner = tree.nodes.where("type = 'aggregation'").select("id", "name")
    named = inner.where("name <> 'Group'").select(F.col("id").alias("child"))
    kids = tree.edges.join(named, "child", "left_semi").join(inner.select(F.col("id").alias("parent")), "parent", "left_semi").select("parent", "child")
    fan = kids.groupBy("parent").agg(F.count("*").alias("k")).where("k >= 2")
    mine = kids.join(table.select(F.col("doc").alias("child"), "term", F.col("tfidf").alias("c")), "child")
    sums = mine.groupBy("parent", "term").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("own"))
    own = table.select(F.col("doc").alias("parent"), "term", F.col("tfidf").alias("p"))
    by = sums.join(own, ["parent", "term"], "left").groupBy("parent").agg(F.sum(F.col("s") * F.coalesce("p", F.lit(0.0))).alias("dot"), F.sum(F.col("s") * F.col("s") - F.col("own")).alias("pairs"))
    each = fan.join(by, "parent", "left").select((F.coalesce("dot", F.lit(0.0)) / F.col("k")).alias("near"), (1 - F.coalesce("pairs", F.lit(0.0)) / (F.col("k") * F.col("k"))).alias("apart"))
    one = each.agg(F.round(F.coalesce(F.avg("near"), F.lit(0.0)), 4).alias("parent_child"), F.round(F.coalesce(F.avg("apart"), F.lit(0.0)), 4).alias("sibling_diversity"))
    below = inner.join(tree.edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k")), "id", "left")
    return one.join(below.agg(F.count("*").alias("n_aggregations"), F.count_if(F.col("k") == 1).alias("n_singletons")), F.lit(True))


def traco(tree: Tree, table: DataFrame) -> DataFrame:
    """V1: parent-child coherence and sibling diversity; table has (doc = node id, term, tfidf) of unit length.

    Cosines come from equal terms; the mean over a parent's pairs comes from the
    length of its children's sum, so siblings never meet.
    """
    kids = tree.edges.where(f"parent <> {ROOT}").select("parent", "child")
    mine = kids.join(table.select(F.col("doc").alias("child"), "term", F.col("tfidf").alias("c")), "child")
    dots = mine.join(table.select(F.col("doc").alias("parent"), "term", F.col("tfidf").alias("p")), ["parent", "term"]).agg(F.sum(F.col("c") * F.col("p")).alias("s"))
    one = dots.join(kids.agg(F.count("*").alias("n")), F.lit(True)).select(F.round(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)), 4).alias("pc_coherence"))
    sums = mine.groupBy("parent", "term").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("own")).groupBy("parent").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.sum("own").alias("own"))
    fan = kids.groupBy("parent").agg(F.count("*").alias("k")).where("k >= 2").join(sums, "parent", "left")
    div = fan.agg(F.round(F.coalesce(F.avg(1 - F.coalesce(F.col("q") - F.col("own"), F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))), F.lit(0.0)), 4).alias("sibling_diversity"))
    return one.join(div, F.lit(True))
