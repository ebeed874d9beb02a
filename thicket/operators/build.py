"""Trees built from rows: clusters of vectors with contrastive labels (H1), and values of slots or roles, one level after another.

Work goes level by level, each a grouped aggregate over all nodes of the level,
with lineage cut in between; no node's rows meet in one task but those of nodes
under Ward's bound (see ``ward``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import words
from thicket.operators import tfidf, ward
from thicket.operators.slots import slot_order
from thicket.operators.tree import ROOT, Tree, ordered
from thicket.storage import numbered, written

# How far out a role stands in a group's hierarchy.
ROLE_PRIORITY = {"measure": 6, "outcome": 5, "statistic": 4, "condition": 3, "modifier": 2, "subtype": 1}


def text_vectors(rows: DataFrame, id_col: str, text: Column, max_features: int = 300) -> DataFrame:
    """id, vector: TF-IDF of a text's words over the max_features most frequent ones; a text without any has zeros. One row per id."""
    table = tfidf.terms(rows, id_col, text)
    scores = written(tfidf.tfidf(table, rows.count(), max_features), "text-vectors")
    known = [r.term for r in scores.select("term").distinct().orderBy("term").collect()]
    own = scores.groupBy(F.col("doc").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("term", "tfidf"))).alias("m"))
    dense = F.transform(words(*known), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0)))
    return rows.select(F.col(id_col).alias("id")).join(own, "id", "left").select("id", dense.alias("vector"))


def cluster_labels(members: DataFrame, most: int = 2) -> DataFrame:
    """L1 for all nodes of a tree of clusters: node, label, n.

    members has (row, path, words); path lists cluster numbers from the root and
    a node is a prefix of it. A word scores its share among the node's rows less
    that among the parent's other rows, if two rows or half of them have it; the
    best ``most`` positive ones make the label, ties by first row, then word. Else
    the commonest word stands alone, else ``Group``. Words of up to two letters,
    and those that are an ancestor's whole label, are left out.
    """
    kinds = written(members.groupBy("path", "words").agg(F.count("*").alias("times"), F.min("row").alias("row")), "cluster-kinds")
    spread = kinds.select("row", "times", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("node"), "words")
    sizes = written(spread.groupBy("node").agg(F.sum("times").alias("n")), "cluster-sizes")
    each = spread.select("row", "times", "node", F.explode(F.filter(F.array_distinct("words"), lambda w: F.length(w) > 2)).alias("term"))
    counts = written(each.groupBy("node", "term").agg(F.sum("times").alias("f"), F.min("row").alias("first")), "cluster-words")
    above = F.slice("node", F.lit(1), F.size("node") - 1)
    inner = sizes.where(F.size("node") > 1).withColumn("up", above).join(sizes.select(F.col("node").alias("up"), F.col("n").alias("n_up")), "up")
    both = counts.join(inner, "node").join(counts.select(F.col("node").alias("up"), "term", F.col("f").alias("f_up")), ["up", "term"])
    p_in, p_out = F.col("f") / F.col("n"), (F.col("f_up") - F.col("f")) / F.greatest(F.col("n_up") - F.col("n"), F.lit(1))
    score = F.round(p_in - p_out, 9)
    good = ((F.col("f") >= 2) | (p_in >= 0.5)) & (score > 0)
    scored = both.select("up", "node", "term", "f", "first", good.alias("good"), F.when(good, score).otherwise(0.0).alias("score"))
    done, used = [], sizes.where(F.size("node") == 1).select("node", F.array().cast("array<string>").alias("used"))
    for depth in range(2, (sizes.agg(F.max(F.size("node"))).first()[0] or 1) + 1):
        before = used.withColumnRenamed("node", "up")
        free = scored.where(F.size("node") == depth).join(before, "up").where(~F.array_contains("used", F.col("term")))
        order = [F.desc("good"), F.desc("score"), F.when(~F.col("good"), -F.col("f")), "first", "term"]
        best = free.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("r") <= most).where("good OR r = 1")
        named = best.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: F.initcap(x["term"])), " / ").alias("label"))
        level = inner.where(F.size("node") == depth).join(named, "node", "left").join(before, "up").select("node", F.coalesce("label", F.lit("Group")).alias("label"), "n", "used")
        level = written(level, "cluster-labels")
        done.append(level.drop("used"))
        used = level.select("node", F.concat("used", F.array(F.lower("label"))).alias("used"))
    out = sizes.where("false").select("node", F.lit("").alias("label"), "n")
    for level in done:
        out = out.union(level)
    return out


def cluster_tree(rows: DataFrame, vector: str, root: str = "All", **limits: int) -> Tree:
    """H1: the tree of a table of rows by Ward clusters of their vectors, nodes labelled by the words of their members.

    rows has (row, name, words, vector), row unique. Leaves are numbered by row
    from 1, clusters after them from the top, those of the smallest row first.
    ``limits`` go to ``ward.paths``.
    """
    found = ward.paths(rows.withColumn("_grp", F.lit(0)), "row", "_grp", vector, **limits).select(F.col("id").alias("row"), "path")
    members = written(rows.select("row", "name", "words").join(found, "row"), "cluster-members")
    labels = written(cluster_labels(members), "cluster-tree")
    leaves = numbered(members.select("row", "name", "path"), "k", "row").select((F.col("k") + 1).alias("id"), "name", "path")
    many = members.count()
    inner = numbered(labels, "k", "node").select((F.col("k") + many + 1).alias("id"), F.col("label").alias("name"), F.col("node").alias("path"))
    inner = written(inner, "cluster-nodes")
    head = rows.sparkSession.range(1).select(F.lit(ROOT).cast("long").alias("id"), F.lit(root).alias("name"), F.lit("root").alias("type"))
    nodes = head.union(inner.select("id", "name", F.lit("aggregation"))).union(leaves.select("id", "name", F.lit("attribute")))
    parents = inner.select(F.col("path").alias("up"), F.col("id").alias("parent"))
    kids = inner.select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("up")).union(leaves.select("id", "path"))
    edges = kids.join(parents, "up", "left").select(F.coalesce("parent", F.lit(ROOT).cast("long")).alias("parent"), F.col("id").alias("child"))
    return Tree(nodes, ordered(edges))


def nested(rows: DataFrame, values: DataFrame, max_depth: int = 4, least_nodes: int = 2, loose: bool = False) -> DataFrame:
    """grp, row, path: values of rows nested one position after another.

    rows has (grp, row), values (grp, row, pos, value), pos from 0 and one value
    at most for each. A position at which a node's rows have one value or none
    is passed over. Else each value of two rows or more is a node below; rows
    with a value of their own, or without one, stay where they are for good. A
    group with fewer than least_nodes nodes is not nested: its paths are empty,
    as are those of rows of the null group. With ``loose``, a column of that name
    tells rows that may be split further: all but those with a value of their own.
    """
    going = rows.select("grp", "row", F.array().cast("array<string>").alias("path"), F.lit(-1).alias("at"))
    known, state = values.where("value IS NOT NULL").select("grp", "row", "pos", "value"), None
    for _ in range(max_depth):
        # Positions that split nothing are passed over all at once: each node goes to its first one that does.
        met = going.join(known, ["grp", "row"]).where(F.col("pos") > F.col("at"))
        shared = written(met.groupBy("grp", "path", "pos", "value").agg(F.count("*").alias("n")), "nested-values")
        first = shared.groupBy("grp", "path", "pos").agg(F.count("*").alias("kinds")).where("kinds > 1").groupBy("grp", "path").agg(F.min("pos").alias("pos"))
        at = going.drop("at").join(first, ["grp", "path"], "left").join(known, ["grp", "row", "pos"], "left").join(shared, ["grp", "path", "pos", "value"], "left")
        at = written(at.select("grp", "row", "path", "value", "pos", (F.coalesce("n", F.lit(0)) > 1).alias("goes")), "nested")
        stays = at.where("NOT goes").select("grp", "row", "path", F.col("value").isNotNull().alias("alone"))
        state = stays if state is None else state.union(stays)
        going = at.where("goes").select("grp", "row", F.concat("path", F.array("value")).alias("path"), F.col("pos").alias("at"))
        if going.isEmpty():
            break
    rest = going.select("grp", "row", "path", F.lit(False).alias("alone"))
    state = rest if state is None else state.union(rest)
    made = state.where(F.size("path") > 0).select("grp", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("node"))
    enough = made.distinct().groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= least_nodes).select("grp", F.lit(True).alias("fine"))
    out = state.join(enough, "grp", "left").select("grp", "row", F.when(F.col("fine"), F.col("path")).otherwise(F.array().cast("array<string>")).alias("path"), (~F.col("alone")).alias("loose"))
    return out if loose else out.drop("loose")


def slot_hierarchy(rows: DataFrame, assignment: DataFrame, max_depth: int = 4, loose: bool = False) -> DataFrame:
    """Grp, row, path by the group's slots in R5's order (ties: the smaller slot); rows has (grp, row), assignment comes from ``slots.gated``."""
    scores = slot_order(assignment, rows.groupBy("grp").agg(F.count("*").alias("total")))
    placed = scores.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "slot")) - 1)
    return nested(rows, assignment.join(placed.select("grp", "slot", "pos"), ["grp", "slot"]).select("grp", "row", "pos", F.col("phrase").alias("value")), max_depth, loose=loose)


def role_hierarchy(rows: DataFrame, roles: DataFrame, max_depth: int = 4, loose: bool = False) -> DataFrame:
    """Grp, row, path by the group's roles, measure outermost and unknown ones innermost (ties: by name); roles has (grp, row, role, value), empty values count as none."""
    rank = F.coalesce(*[F.when(F.col("role") == name, n) for name, n in ROLE_PRIORITY.items()], F.lit(0))
    known = roles.where("value <> ''")
    placed = known.select("grp", "role").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(rank), "role")) - 1)
    return nested(rows, known.join(placed, ["grp", "role"]).select("grp", "row", "pos", "value"), max_depth, loose=loose)
