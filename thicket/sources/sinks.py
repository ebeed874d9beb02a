"""Trees and tables as files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.tree import Tree


def tree_rows(tree: Tree) -> DataFrame:
    """id, name, type, related, and what else of ``tree.described()`` the nodes have: a row per node with its children in order."""
    more = [c for c in ("dtype", "is_shown", "desc", "metadata") if c in tree.nodes.columns]
    kids = tree.edges.groupBy("parent").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "child"))), lambda x: x["child"]).alias("related"))
    return tree.nodes.join(kids, F.col("id") == F.col("parent"), "left").select("id", "name", "type", *more, F.coalesce("related", F.array().cast("array<long>")).alias("related"))


def write_tree(tree: Tree, path: str) -> None:
    """K1: one JSON object a node, in files of a folder."""
    tree_rows(tree).write.mode("overwrite").json(path)


def write_facets(trees: dict[str, Tree], path: str) -> None:
    """K2: all facet trees in one folder, told apart by tree_id."""
    parts = [tree_rows(t).select(F.lit(name).alias("tree_id"), "*") for name, t in trees.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out.write.mode("overwrite").partitionBy("tree_id").json(path)


def tree_list(tree: Tree) -> DataFrame:
    """K1: one row, json: the tree as one list of nodes in order of ids, as viewers read it. For trees that are looked at; larger ones go by write_tree()."""
    rows = tree_rows(tree)
    nodes = F.sort_array(F.collect_list(F.struct(*rows.columns)))
    return rows.agg(F.to_json(nodes).alias("json"))


def facet_list(trees: dict[str, Tree]) -> DataFrame:
    """K2: one row, json: an object of facet names and their lists of nodes."""
    out = None
    for name, t in trees.items():
        one = tree_list(t).select(F.lit(name).alias("name"), "json")
        out = one if out is None else out.union(one)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("name", "json"))), lambda x: F.concat(F.to_json(F.array(x["name"])), F.lit("\u0000"), x["json"]))
    return out.agg(F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "(?s)^\\[(.*?)\\]\u0000", "$1: ")), ", "), F.lit("}")).alias("json"))


def safe_name(name: Column) -> Column:
    """A file name with all but letters, digits, ``_``, ``.`` and ``-`` as ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_.\-]", "_")


def zipped(spark: SparkSession, folder: str, glob: str = "*") -> bytes:
    """K7: a ZIP of a folder's files, read by Spark from any store, with paths below the folder as names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for r in files.select("path", "content").orderBy("path").toLocalIterator():  # a file at a time
            out.writestr(r.path.rpartition(folder.split("://")[-1].strip("/"))[2].lstrip("/"), bytes(r.content))
    return held.getvalue()


def write_canonical(rows: DataFrame, path: str) -> None:
    """K3: canonical rows without the raw columns."""
    rows.drop("raw").write.mode("overwrite").option("header", True).csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """K4, K5: provenance, roles and audits, nested values as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema.fields]
    rows.select(flat).write.mode("overwrite").option("header", True).csv(path)


def save(tree: Tree, rows: DataFrame, folder: str, base: str) -> None:
    """K6: tree and canonical rows under one base name."""
    write_tree(tree, f"{folder}/{base}_tree")
    write_canonical(rows, f"{folder}/{base}_canonical")
