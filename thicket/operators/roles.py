"""Roles of variables, metrics of a build, and averaged word vectors (J15, A-17, M1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import name_tokens
from thicket.operators.tree import Tree, closure, first_parents
from thicket.storage import small

# Roles with a column of their own.
STANDARD = "measure statistic condition subtype outcome modifier".split()
MOST_WORDS = 200_000


def role_table(tree: Tree, rows: DataFrame, roles: DataFrame, audit: DataFrame) -> DataFrame:
    """Id, grp, label, a column for each standard role and other of each variable.

    rows has (id, grp, label), roles (id, role) of tree nodes, audit (id, role,
    value) what was read for a variable. An audit's value wins unless it is empty, and of
    several the smallest; else the name of the nearest node above with the role. Other
    roles are listed by name; what is missing is empty.
    """
    up = closure(first_parents(tree).select("parent", "child"))
    above = up.join(roles.select(F.col("id").alias("anc"), "role"), "anc").join(tree.nodes.select(F.col("id").alias("anc"), "name"), "anc")
    nearest = above.groupBy(F.col("desc").alias("id"), "role").agg(F.min_by("name", "dist").alias("name"))
    told = audit.where(F.coalesce("value", F.lit("")) != "").groupBy("id", "role").agg(F.min("value").alias("value"))
    both = nearest.join(told, ["id", "role"], "full_outer").select("id", "role", F.coalesce("value", "name").alias("value"))
    other = F.sort_array(F.collect_list(F.when(~F.col("role").isin(STANDARD), F.concat_ws(": ", "role", "value"))))
    wide = both.groupBy("id").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in STANDARD], F.array_join(other, "; ").alias("other"))
    return rows.select("id", "grp", "label").join(wide, "id", "left").select("id", "grp", "label", *[F.coalesce(c, F.lit("")).alias(c) for c in [*STANDARD, "other"]])


def build_metrics(rows: DataFrame, score: str, family: str, concepts: DataFrame) -> DataFrame:
    """A-17: one row of a build's counts and rates; a null score is in no count but the total, a null family is none; an empty table has rates of 0 and no average."""
    s, n = F.col(score), F.greatest(F.count("*"), F.lit(1))
    has_family = F.coalesce(F.col(family), F.lit("")) != ""

    def rate(x: Column) -> Column:
        return F.round(100 * F.count_if(x) / n, 1)

    own = rows.agg(
        F.count("*").alias("variables"), rate(s > 0.08).alias("coverage_pct"), F.round(F.avg(s), 3).alias("avg_confidence"), F.count_if(s == 0).alias("fallbacks"), rate(s == 0).alias("fallback_pct"),
        F.count_if((s > 0) & (s <= 0.25)).alias("low_confidence"), F.count_if(has_family).alias("with_family"), rate(has_family).alias("family_pct"),
    )
    table = concepts.agg(F.count("*").alias("concepts"), *[F.count_if(F.col("source").contains(x)).alias(x) for x in ("wikidata", "pubmed")])
    return own.join(F.broadcast(table), how="inner", on=F.lit(True))


def averaged_vectors(rows: DataFrame, row: str, text: Column, vectors: DataFrame) -> DataFrame:
    """M1: row, pos, c: the mean vector of a text's words, at length 1; zeros for texts without a known word.

    vectors has (word, vec), all of one length; words that repeat in a text count
    each time. Positions are averaged as rows, so partial sums come before the shuffle.
    """
    own = rows.select(F.col(row).alias("row"), name_tokens(text).alias("w"))
    counts = own.select("row", F.explode("w").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    spread = counts.join(small(vectors.select("word", "vec"), MOST_WORDS), "word").select("row", "n", F.posexplode("vec").alias("pos", "x"))
    means = spread.groupBy("row", "pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    norms = means.groupBy("row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    known = means.join(norms, "row").select("row", "pos", (F.col("x") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("c"))
    size = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    if not size:
        return known
    none = own.select("row").join(norms.select("row"), "row", "left_anti").select("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"), F.lit(0.0).alias("c"))
    return known.union(none)
