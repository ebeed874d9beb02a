"""Trees as two tables: nodes (id, name, type, ...) and edges (parent, child, ord)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import LABEL_STOP, PATH_SEP, PHRASE_STOP, singular, spaced
from thicket.storage import cut, numbered, written

ROOT = 0


@dataclass
class Tree:
    nodes: DataFrame
    edges: DataFrame


def from_paths(rows: DataFrame, path: Column, leaf_name: Column, root: str = "All", payload: list[str] | None = None) -> Tree:
    """Root, a node for each distinct prefix of the path (an array of strings), and a leaf per row.

    Ids follow (depth, path, row), so that they do not depend on the order of
    work. rows needs a column ``row``, unique. Both kinds of ids are given range by
    range of their order. Leaves keep the columns of rows named in ``payload``, null for other nodes.
    """
    payload = payload or []
    own = rows.select("row", path.alias("path"), leaf_name.alias("name"), *[F.col(c).alias(f"_{c}") for c in payload])
    prefixes = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path")).distinct()
    inner = numbered(prefixes.select("path", F.size("path").alias("depth")), "id", "depth", "path").select("path", "depth", (F.col("id") + 1).alias("id"))
    inner = cut(inner)
    many = inner.count()
    leaves = numbered(own, "id", "row").select("path", "name", (F.col("id") + 1 + many).alias("id"), *[F.col(f"_{c}").alias(c) for c in payload])
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(ROOT).cast("long").alias("id"), F.lit(root).alias("name"), F.lit("root").alias("type"))
    nodes = head.union(inner.select("id", F.element_at("path", -1), F.lit("aggregation"))).unionByName(leaves.select("id", "name", F.lit("attribute").alias("type"), *payload), allowMissingColumns=True)
    up = inner.select(F.col("path").alias("up"), F.col("id").alias("parent"))
    kids = inner.where("depth > 1").select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("up")).union(leaves.select("id", F.col("path").alias("up")))
    links = kids.join(up, "up").select("parent", F.col("id").alias("child")).union(inner.where("depth = 1").select(F.lit(ROOT).cast("long"), "id"))
    return Tree(nodes, ordered(links))


def ordered(links: DataFrame) -> DataFrame:
    """parent, child, ord: children numbered by id."""
    return links.select("parent", "child", (F.row_number().over(Window.partitionBy("parent").orderBy("child")) - 1).alias("ord"))


def described(tree: Tree) -> Tree:
    """Nodes as viewers read them: dtype, is_shown, desc and metadata (leaf_id, group_path, row_index) besides id, name and type.

    Leaves take them from what they carry (text, leaf_id, group_path, row, as far as it is there); an inner node's
    desc is its own, or tells its name. Dissolved nodes are not shown.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in tree.nodes.columns else F.lit(None).cast(kind)
    leaf = F.col("type") == "attribute"
    inner = F.when(F.col("type") == "root", F.lit("Root node")).otherwise(F.concat(F.lit("Group: "), "name"))
    meta = F.when(leaf, F.struct(has("leaf_id", "string").alias("leaf_id"), has("group_path", "string").alias("group_path"), has("row", "long").alias("row_index")))
    nodes = tree.nodes.select("id", "name", "type", F.when(leaf, "determine").otherwise(F.col("type")).alias("dtype"), (F.col("type") != "dissolved").alias("is_shown"), F.coalesce(has("desc", "string"), F.when(leaf, has("text", "string")).otherwise(inner), F.lit("")).alias("desc"), meta.alias("metadata"))
    return Tree(nodes, tree.edges)


def closure(edges: DataFrame, most_depth: int = 100) -> DataFrame:
    """Ancestor, descendant, distance of all pairs, by levels; a cycle raises once paths pass most_depth.

    Levels go over nodes with children alone; the others, most of a tree, are met once at the end.
    """
    links = edges.select("parent", "child")
    has = links.select(F.col("parent").alias("child")).distinct()
    inner = cut(links.join(has, "child", "left_semi").select("parent", "child"))
    found = level = inner.select(F.col("parent").alias("anc"), F.col("child").alias("desc"), F.lit(1).alias("dist"))
    for depth in range(2, most_depth + 2):
        if level.isEmpty():
            last = links.join(has, "child", "left_anti").select("parent", F.col("child").alias("leaf"))
            below = found.join(last, F.col("desc") == F.col("parent")).select("anc", F.col("leaf").alias("desc"), (F.col("dist") + 1).alias("dist"))
            return found.union(last.select("parent", "leaf", F.lit(1))).union(below).groupBy("anc", "desc").agg(F.min("dist").alias("dist"))
        level = cut(level.join(inner, F.col("desc") == F.col("parent")).select("anc", F.col("child").alias("desc"), F.lit(depth).alias("dist")))
        found = found.union(level)
    raise ValueError("the edges have a cycle")


def depths(tree: Tree) -> DataFrame:
    """id, depth: shortest distance from the root."""
    return closure(tree.edges).where(f"anc = {ROOT}").select(F.col("desc").alias("id"), F.col("dist").alias("depth"))


def first_parents(tree: Tree) -> DataFrame:
    """Child, parent: the parent whose edge comes first, by parent's id, then order."""
    return tree.edges.groupBy("child").agg(F.min_by("parent", F.struct("parent", "ord")).alias("parent"))


def leaf_counts(tree: Tree) -> DataFrame:
    """A-18: id, leaves below each inner node, each once."""
    leaves = tree.nodes.where("type = 'attribute'").select(F.col("id").alias("desc"))
    return closure(tree.edges).join(leaves, "desc").groupBy(F.col("anc").alias("id")).agg(F.count_distinct("desc").alias("leaves"))


def path_rows(tree: Tree) -> DataFrame:
    """Id, path, depth of all nodes but the root, names from the top joined."""
    names = tree.nodes.select("id", "name")
    up = closure(tree.edges).where(f"anc <> {ROOT}").join(names.withColumnRenamed("id", "anc"), "anc")
    above = up.groupBy("desc").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), "name"))).alias("above"))
    own = names.where(f"id <> {ROOT}").join(above.withColumnRenamed("desc", "id"), "id", "left")
    before = F.coalesce(F.transform("above", lambda x: x["name"]), F.array().cast("array<string>"))
    return own.select("id", F.array_join(F.concat(before, F.array("name")), PATH_SEP).alias("path"), (F.size(before) + 1).alias("depth"))


def structural_stats(tree: Tree) -> DataFrame:
    """V3, A-14: aggregations, leaves, max_depth, avg_leaf_depth, avg_branching, singleton_pct."""
    deep = depths(tree)
    kinds = tree.nodes.select("id", "type")
    leaf = kinds.where("type = 'attribute'").join(deep, "id").agg(F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("avg_leaf_depth"), F.count("*").alias("leaves"))
    fan = tree.edges.groupBy("parent").agg(F.count("*").alias("n")).join(kinds.where("type = 'aggregation'"), F.col("parent") == F.col("id"), "right")
    inner = fan.agg(F.count("*").alias("aggregations"), F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("avg_branching"), F.round(100 * F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 4).alias("singleton_pct"))
    return inner.join(leaf, how="full_outer", on=F.lit(True))


def pruned(tree: Tree) -> Tree:
    """Without aggregations that have no leaf below."""
    full = leaf_counts(tree).select("id")
    nodes = tree.nodes.where("type = 'root'").union(tree.nodes.where("type = 'attribute'")).union(tree.nodes.where("type = 'aggregation'").join(full, "id", "left_semi"))
    edges = tree.edges.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    return Tree(nodes, ordered(edges))


def single_parent(tree: Tree) -> Tree:
    """Each child keeps its deepest parent, the first of equals; parents that the root does not reach have depth 0."""
    return Tree(tree.nodes, ordered(deepest_parents(tree.edges, depths(tree))))


def deepest_parents(edges: DataFrame, deep: DataFrame) -> DataFrame:
    """parent, child: of edges that of each child's deepest parent; deep has (id, depth)."""
    best = edges.join(deep, F.col("parent") == F.col("id"), "left").groupBy("child").agg(F.max_by("parent", F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), (-F.col("parent")).alias("first"))).alias("parent"))
    return best.select("parent", "child")


def compressed(tree: Tree) -> Tree:
    """Chains of aggregations with one aggregation below become one node, names joined by `` / ``."""
    kinds = tree.nodes.select("id", "name", "type")
    only = tree.edges.groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("child")).where("n = 1")
    inner = kinds.where("type = 'aggregation'").select("id")
    links = only.join(inner.withColumnRenamed("id", "parent"), "parent", "left_semi").join(inner.withColumnRenamed("id", "child"), "child", "left_semi").select("parent", "child")
    links = cut(links)
    if links.isEmpty():
        return tree
    heads = links.select("parent").join(links.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("head"))
    chain = closure(links).join(heads, F.col("anc") == F.col("head")).select("head", F.col("desc").alias("id"), "dist").union(heads.select("head", F.col("head"), F.lit(0)))
    joined = chain.join(kinds.select("id", "name"), "id").groupBy("head").agg(F.sort_array(F.collect_list(F.struct("dist", "name"))).alias("c"), F.max_by("id", "dist").alias("tail"))
    names = joined.select(F.col("head").alias("id"), F.array_join(F.transform("c", lambda x: x["name"]), " / ").alias("joined"))
    gone = chain.where("dist > 0").select("id")
    nodes = tree.nodes.join(gone, "id", "left_anti").join(names, "id", "left").withColumn("name", F.coalesce("joined", "name")).drop("joined")
    moved = tree.edges.join(joined.select(F.col("tail").alias("parent"), "head"), "parent", "left").select(F.coalesce("head", "parent").alias("parent"), "child")
    return Tree(nodes, ordered(moved.join(gone.withColumnRenamed("id", "child"), "child", "left_anti").select("parent", "child")))


def merged_duplicates(tree: Tree) -> Tree:
    """H8: of aggregations of one name under one depth-1 node, the shallowest stays, and takes all children."""
    deep = depths(tree)
    up = closure(tree.edges)
    tops = deep.where("depth = 1").select(F.col("id").alias("anc"))
    under = up.join(tops, "anc").select("anc", F.col("desc").alias("id"))
    named = tree.nodes.where("type = 'aggregation'").join(deep, "id").join(under, "id").select("id", "anc", F.lower("name").alias("key"), "depth")
    first = Window.partitionBy("anc", "key").orderBy("depth", "id")
    to = named.withColumn("to", F.first("id").over(first)).where("id <> to").select("id", "to")
    to = cut(to)
    nodes = tree.nodes.join(to, "id", "left_anti")
    edges = tree.edges.join(to.withColumnRenamed("id", "parent").withColumnRenamed("to", "p2"), "parent", "left").join(to.withColumnRenamed("id", "child").withColumnRenamed("to", "c2"), "child", "left")
    edges = edges.where("c2 IS NULL").select(F.coalesce("p2", "parent").alias("parent"), "child").where("parent <> child").distinct()
    return Tree(nodes, ordered(edges))


def factored_prefixes(tree: Tree, least_siblings: int = 3, least_tokens: int = 2, last: int = 0) -> Tree:
    """Siblings of which at least three share a prefix of two or more words, in any case, get a node of that name between, and lose the prefix.

    A parent's longest shared prefixes go first; parents and new nodes are looked at
    again, round by round, until no prefix is left. A prefix does not begin or end
    with a stop word and is never a whole name; it is written as the first of its siblings has it. New ids
    follow the tree's and ``last``.
    """
    while True:
        inner = tree.nodes.where("type = 'aggregation'").select(F.col("id").alias("child"), spaced(F.trim("name")).alias("w"))
        kids = tree.edges.join(inner, "child").where(F.size("w") > least_tokens).select("parent", "child", "w")
        lengths = F.sequence(F.lit(least_tokens), F.size("w") - 1)
        spread = kids.select("parent", "child", "w", F.explode(lengths).alias("n")).withColumn("prefix", F.transform(F.slice("w", F.lit(1), F.col("n")), F.lower))
        fine = ~F.get("prefix", F.lit(0)).isin(PHRASE_STOP) & ~F.element_at("prefix", -1).isin(PHRASE_STOP)
        groups = spread.where(fine).groupBy("parent", "n", "prefix").agg(F.count("*").alias("c"), F.min(F.struct("w", "child")).alias("first")).where(F.col("c") >= least_siblings)
        longest = groups.groupBy("parent").agg(F.max("n").alias("n"))
        name = F.array_join(F.slice("first.w", F.lit(1), F.col("n")), " ")
        found = written(groups.join(longest, ["parent", "n"]).select("parent", "n", "prefix", name.alias("name")), "shared-prefixes")
        if found.isEmpty():
            return tree
        top = max(tree.nodes.agg(F.max("id")).first()[0], last) + 1
        new = written(numbered(found, "id", "parent", "prefix").withColumn("id", F.col("id") + top), "prefix-nodes")
        moves = kids.join(new.select("parent", "n", "prefix", F.col("id").alias("to")), "parent").where((F.size("w") > F.col("n")) & (F.transform(F.slice("w", F.lit(1), F.col("n")), F.lower) == F.col("prefix")))
        moves = written(moves.select("parent", "child", "to", F.array_join(F.slice("w", F.col("n") + 1, F.size("w")), " ").alias("rest")), "prefix-moves")
        edges = tree.edges.select("parent", "child").join(moves.select("parent", "child", "to"), ["parent", "child"], "left").select(F.coalesce("to", "parent").alias("parent"), "child").union(new.select("parent", F.col("id").alias("child")))
        nodes = tree.nodes.join(moves.select(F.col("child").alias("id"), "rest"), "id", "left").withColumn("name", F.coalesce("rest", "name")).select(*tree.nodes.columns)
        nodes = nodes.unionByName(new.select("id", "name", F.lit("aggregation").alias("type")), allowMissingColumns=True)
        tree = Tree(written(nodes, "prefix-tree"), written(ordered(edges), "prefix-edges"))


def dissolved(tree: Tree, noise: Column) -> DataFrame:
    """id, up of aggregations for which noise holds: the nearest node above that stays."""
    parents = first_parents(tree)
    gone = cut(tree.nodes.where("type = 'aggregation'").where(noise).select("id").join(parents, F.col("id") == F.col("child")).select("id", F.col("parent").alias("up")))
    while True:  # a dissolved node's parent may be dissolved, too
        higher = gone.alias("a").join(gone.alias("b"), F.col("a.up") == F.col("b.id"), "left").select("a.id", F.coalesce("b.up", "a.up").alias("up"))
        higher = cut(higher)
        if higher.join(gone, ["id", "up"], "left_anti").isEmpty():
            return gone
        gone = higher


def lifted(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """parent, child of edges, whose parents in ``gone`` give way to those above."""
    return edges.join(gone.withColumnRenamed("id", "parent"), "parent", "left").select(F.coalesce("up", "parent").alias("parent"), "child")


def without_noise(tree: Tree, noise: Column) -> Tree:
    """Aggregations for which noise holds are dissolved; their children go to their parents."""
    gone = dissolved(tree, noise)
    edges = lifted(tree.edges, gone)
    return Tree(tree.nodes.join(gone, "id", "left_anti"), ordered(edges.join(gone.select(F.col("id").alias("child")), "child", "left_anti").distinct()))


def stripped_prefixes(tree: Tree) -> Tree:
    """A node's name without its parent's in front, level by level from the top, as parents' names change."""
    nodes, parents = tree.nodes, first_parents(tree)
    levels = depths(tree)
    for depth in range(2, (levels.agg(F.max("depth")).first()[0] or 0) + 1):
        up = parents.join(nodes.select(F.col("id").alias("parent"), F.col("name").alias("above")), "parent").join(levels.where(f"depth = {depth}").select(F.col("id").alias("child")), "child").select(F.col("child").alias("id"), "above")
        lead = F.lower(F.expr("substring(name, 1, length(above))")) == F.lower("above")
        rest = F.regexp_replace(F.expr("substring(name, length(above) + 1)"), r"^[\s\-—:/]+", "")
        cuts = lead & F.expr("substring(name, length(above) + 1)").rlike(r"^[\s\-—:/]") & (rest != "")
        nodes = cut(nodes.join(up, "id", "left").withColumn("name", F.when(F.coalesce(cuts, F.lit(False)) & (F.col("type") == "aggregation"), rest).otherwise(F.col("name"))).drop("above"))
    return Tree(nodes, tree.edges)


def visible(tree: Tree) -> Tree:
    """without dissolved nodes and edges to them."""
    nodes = tree.nodes.where("type <> 'dissolved'")
    return Tree(nodes, tree.edges.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi"))


def search(tree: Tree, text: str, columns: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """F8: nodes that contain the text in any case."""
    return tree.nodes.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def moved(tree: Tree, node: int, to: int) -> Tree:
    """The node under another parent; refused if that lies below it."""
    if node == to or not closure(tree.edges).where((F.col("anc") == node) & (F.col("desc") == to)).isEmpty():
        raise ValueError("a node can't move below itself")
    edges = tree.edges.where(F.col("child") != node).select("parent", "child")
    return Tree(tree.nodes, ordered(edges.union(tree.nodes.sparkSession.createDataFrame([(to, node)], "parent long, child long"))))


def deleted(tree: Tree, node: int) -> Tree:
    """Without the node; its children go to its parents."""
    return without_noise(Tree(tree.nodes.withColumn("type", F.when(F.col("id") == node, "aggregation").otherwise(F.col("type"))), tree.edges), F.col("id") == node)


def added(tree: Tree, parent: int, name: str, kind: str = "aggregation") -> Tree:
    """With a node more, at the next id."""
    spark = tree.nodes.sparkSession
    new = tree.nodes.agg(F.max("id")).first()[0] + 1
    nodes = tree.nodes.unionByName(spark.createDataFrame([(new, name, kind)], "id long, name string, type string"), allowMissingColumns=True)
    return Tree(nodes, ordered(tree.edges.select("parent", "child").union(spark.createDataFrame([(parent, new)], "parent long, child long"))))


def renamed(tree: Tree, node: int, name: str) -> Tree:
    """H29."""
    return Tree(tree.nodes.withColumn("name", F.when(F.col("id") == node, name).otherwise(F.col("name"))), tree.edges)


def nested_by_head(tree: Tree) -> Tree:
    """H7: inner children of a node right below the root that share their last word go under a new node of that word, if the node has three inner children or more.

    The word's longest form names the new node; a child keeps the words that are
    left, and one without any is dissolved into the new node. New ids follow (node, word).
    """
    inner = tree.nodes.where("type = 'aggregation'").select("id", "name")
    tasks = tree.edges.where(f"parent = {ROOT}").join(inner, F.col("child") == F.col("id")).select(F.col("id").alias("task"))
    own = F.filter(F.regexp_extract_all(F.lower("name"), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda w: ~w.isin(LABEL_STOP))
    kids = tree.edges.select(F.col("parent").alias("task"), F.col("child").alias("id")).join(tasks, "task", "left_semi").join(inner, "id").select("task", "id", own.alias("w"))
    many = kids.groupBy("task").agg(F.count("*").alias("n")).where("n >= 3").select("task")
    headed = kids.where(F.size("w") > 0).join(many, "task", "left_semi").withColumn("form", F.try_element_at("w", F.lit(-1))).withColumn("head", singular(F.col("form")))
    heads = headed.groupBy("task", "head").agg(F.count("*").alias("n"), F.min(F.struct((-F.length("form")).alias("l"), "form")).alias("f")).where("n >= 2")
    last = tree.nodes.agg(F.max("id")).first()[0]
    made = cut(heads.select("task", "head", F.initcap("f.form").alias("title"), (F.row_number().over(Window.orderBy("task", "head")) + F.lit(last)).cast("long").alias("new")))
    moved = cut(headed.join(made, ["task", "head"]).select("task", "id", "new", F.array_join(F.filter("w", lambda w: singular(w) != F.col("head")), " ").alias("rest")))
    gone, names = moved.where("rest = ''").select("id", "new"), moved.where("rest <> ''").select("id", F.initcap("rest").alias("title"))
    nodes = tree.nodes.join(gone.select("id"), "id", "left_anti").join(names, "id", "left").withColumn("name", F.coalesce("title", "name")).select(*tree.nodes.columns)
    nodes = nodes.unionByName(made.select(F.col("new").alias("id"), F.col("title").alias("name"), F.lit("aggregation").alias("type")), allowMissingColumns=True)
    links = tree.edges.select("parent", "child").join(moved.select(F.col("task").alias("parent"), F.col("id").alias("child")), ["parent", "child"], "left_anti")
    links = links.join(gone, F.col("parent") == F.col("id"), "left").select(F.coalesce("new", "parent").alias("parent"), "child")
    links = links.union(made.select("task", "new")).union(moved.where("rest <> ''").select("new", "id"))
    return Tree(nodes, ordered(links.distinct()))
