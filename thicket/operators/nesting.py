"""Greedy cover of siblings: shared measure phrases (H6) and title descriptors (H9).

All tasks or nodes are covered in the same rounds. H6 takes each task's best phrase a
round, as a new node may be covered again. H9 has a fixed order of phrases; a round settles
every phrase that is the first one left of all the leaves it would take, so what comes
out is what taking one phrase after another gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import LABEL_STOP, ngrams, without_phrase
from thicket.operators.tree import ROOT, Tree, closure, ordered
from thicket.storage import Scratch, numbered, written

WORD = r"[a-z][a-z\-]+"


def content_words(x: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(LABEL_STOP))


def nested_by_measure(tree: Tree) -> Tree:
    """H6: inner children of a node right below the root that share a phrase of two or three words go under a new node of that phrase, if the node has three inner children or more.

    The phrase of most children goes first, then the longer, then the smaller one, until no two children share one.
    A child keeps the words that are left; a single one gets the phrase's longest word (the last of equals) besides;
    a child without any is dissolved into the new node.
    """
    while True:
        inner = tree.nodes.where("type = 'aggregation'").select("id", "name")
        tasks = tree.edges.where(f"parent = {ROOT}").join(inner, F.col("child") == F.col("id")).select(F.col("id").alias("task"))
        kids = tree.edges.select(F.col("parent").alias("task"), F.col("child").alias("id")).join(tasks, "task", "left_semi").join(inner, "id").select("task", "id", content_words(F.col("name")).alias("w"))
        many = kids.groupBy("task").agg(F.count("*").alias("n")).where("n >= 3").select("task")
        kids = written(kids.join(many, "task", "left_semi"), "measure-children")
        phrases = kids.select("task", "id", F.explode(F.array_distinct(ngrams(F.col("w"), 2, 3))).alias("phrase"))
        counts = phrases.groupBy("task", "phrase").agg(F.count("*").alias("n")).where("n >= 2")
        best = counts.groupBy("task").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.size(F.split("phrase", " "))).alias("k"), "phrase")).alias("b")).select("task", "b.phrase")
        best = written(best, "measure-phrases")
        if best.isEmpty():
            return tree
        top = tree.nodes.agg(F.max("id")).first()[0] + 1
        new = written(numbered(best, "k", "task").select("task", "phrase", F.split("phrase", " ").alias("p"), (F.col("k") + top).alias("new")), "measure-nodes")
        own = kids.join(phrases.join(new, ["task", "phrase"]).select("task", "id", "p", "new"), ["task", "id"])
        left = without_phrase(F.col("w"), F.col("p"))
        longest = F.aggregate("p", F.lit(""), lambda held, w: F.when(F.length(w) >= F.length(held), w).otherwise(held))
        moved = own.select("task", "id", "new", left.alias("left"), longest.alias("longest"))
        moved = moved.withColumn("left", F.when((F.size("left") == 1) & ~F.array_contains("left", F.col("longest")), F.concat("left", F.array("longest"))).otherwise(F.col("left")))
        moved = written(moved.select("task", "id", "new", F.initcap(F.array_join("left", " ")).alias("title")), "measure-moves")
        gone = moved.where("title = ''").select("id", "new")
        nodes = tree.nodes.join(gone.select("id"), "id", "left_anti").join(moved.where("title <> ''").select("id", "title"), "id", "left").withColumn("name", F.coalesce("title", "name")).select(*tree.nodes.columns)
        nodes = nodes.unionByName(new.select(F.col("new").alias("id"), F.initcap("phrase").alias("name"), F.lit("aggregation").alias("type")), allowMissingColumns=True)
        links = tree.edges.select("parent", "child").join(moved.select(F.col("task").alias("parent"), F.col("id").alias("child")), ["parent", "child"], "left_anti")
        links = links.join(gone, F.col("parent") == F.col("id"), "left").select(F.coalesce("new", "parent").alias("parent"), "child")
        links = links.union(new.select("task", "new")).union(moved.where("title <> ''").select("new", "id"))
        tree = Tree(written(nodes, "measure-tree"), written(ordered(links.distinct()), "measure-edges"))


def covered(phrases: DataFrame) -> DataFrame:
    """node, phrase, rank, leaf of a greedy cover: in order of rank each phrase of a node takes its leaves that no earlier one took, if those are two or more; phrases has these columns."""
    tables, out = Scratch(), None
    left = tables.written(phrases.select("node", "phrase", "rank", "leaf"), "cover")
    while True:
        # What is left of a phrase only shrinks, so one with a single leaf is done with.
        sizes = left.groupBy("node", "rank").agg(F.count("*").alias("n")).where("n >= 2").select("node", "rank")
        left = left.join(sizes, ["node", "rank"], "left_semi")
        first = left.groupBy("node", "leaf").agg(F.min("rank").alias("least"))
        met = left.join(first, ["node", "leaf"])
        ready = met.groupBy("node", "rank").agg(F.min((F.col("rank") == F.col("least")).cast("int")).alias("all")).where(F.col("all") == 1).select("node", "rank")
        taken = written(left.join(ready, ["node", "rank"], "left_semi"), "covered")
        if taken.isEmpty():
            tables.clear()
            return taken if out is None else out
        out = taken if out is None else out.unionByName(taken)
        after = tables.written(left.join(taken.select("node", "leaf"), ["node", "leaf"], "left_anti").join(ready, ["node", "rank"], "left_anti"), "cover")
        left = after


def split_by_title(tree: Tree, titles: DataFrame, least_leaves: int = 4, common: float = 0.7) -> Tree:
    """H9: leaves of an inner node that share a descriptor of one to three words of their titles go under a new node of it, where a node with least_leaves leaves or more has two such groups of two or more.

    titles has (id, title). Words of the node and those above it, and words of over a share ``common`` of its
    leaves, describe nothing. Longer descriptors go first, then those of more leaves, then the smaller ones.
    """
    kinds = tree.nodes.select("id", "type", "name")
    inner = kinds.where("type = 'aggregation'")
    leaves = tree.edges.select(F.col("parent").alias("node"), F.col("child").alias("id")).join(kinds.where("type = 'attribute'").select("id"), "id", "left_semi").join(inner.select(F.col("id").alias("node")), "node", "left_semi")
    many = leaves.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least_leaves)
    up = closure(tree.edges).select(F.col("desc").alias("node"), F.col("anc").alias("id")).union(inner.select("id", "id")).join(many.select("node"), "node", "left_semi")
    above = up.join(inner.select("id", "name"), "id").select("node", F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("node").agg(F.collect_set("w").alias("above"))
    own = leaves.join(many, "node").join(titles.select("id", "title"), "id", "left").join(above, "node", "left")
    words = F.filter(content_words(F.coalesce("title", F.lit(""))), lambda w: ~F.array_contains(F.coalesce("above", F.array().cast("array<string>")), w))
    own = written(own.select("node", F.col("id").alias("leaf"), "n", words.alias("w")), "title-words")
    frequent = own.select("node", "n", F.explode(F.array_distinct("w")).alias("x")).groupBy("node", "n", "x").agg(F.count("*").alias("c")).where(F.col("c") > common * F.col("n")).groupBy("node").agg(F.collect_set("x").alias("common"))
    own = own.join(frequent, "node", "left").select("node", "leaf", F.filter("w", lambda w: ~F.array_contains(F.coalesce("common", F.array().cast("array<string>")), w)).alias("w"))
    spread = own.select("node", "leaf", F.explode(F.array_distinct(ngrams(F.col("w"), 1, 3))).alias("phrase"))
    counts = spread.groupBy("node", "phrase").agg(F.count("*").alias("c")).where("c >= 2")
    order = Window.partitionBy("node").orderBy((-F.size(F.split("phrase", " "))), F.desc("c"), "phrase")
    found = covered(spread.join(counts.withColumn("rank", F.row_number().over(order)), ["node", "phrase"]))
    enough = found.groupBy("node").agg(F.count_distinct("rank").alias("k")).where("k >= 2").select("node")
    found = written(found.join(enough, "node", "left_semi"), "title-groups")
    top = tree.nodes.agg(F.max("id")).first()[0] + 1
    new = written(numbered(found.select("node", "rank", "phrase").distinct(), "k", "node", "rank").select("node", "rank", "phrase", (F.col("k") + top).alias("new")), "title-nodes")
    moved = found.join(new.select("node", "rank", "new"), ["node", "rank"]).select(F.col("node").alias("parent"), F.col("leaf").alias("child"), "new")
    links = tree.edges.select("parent", "child").join(moved, ["parent", "child"], "left").select(F.coalesce("new", "parent").alias("parent"), "child").union(new.select("node", "new"))
    nodes = tree.nodes.unionByName(new.select(F.col("new").alias("id"), F.initcap("phrase").alias("name"), F.lit("aggregation").alias("type")), allowMissingColumns=True)
    return Tree(nodes, ordered(links))
