"""Variable codes: families, expansions, conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that expand no code.
EXPANSION_STOP = "the and for with from that this are was number total mean each per all not its has".split()


def first_code(label: Column) -> Column:
    return F.trim(F.split(label, "/")[0])


def is_coded(label: Column) -> Column:
    """C1."""
    return first_code(label).rlike("^[A-Z][A-Z0-9_]{2,}$")


def is_acronym(x: Column) -> Column:
    """Upper case, 2 to 6 characters, at least 2 letters."""
    return (F.upper(x) == x) & F.length(x).between(2, 6) & (F.regexp_count(x, F.lit("[A-Z]")) >= 2)


def families(rows: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Id, family: the longest alphabetic prefix of 3 letters on that at least two codes share; empty if there is none.

    Prefixes are counted once per row, and the join back is on the prefix.
    """
    code = first_code(F.col(label_col))
    alpha = F.when(is_coded(F.col(label_col)), F.regexp_extract(code, "^([A-Za-z]+)", 1)).otherwise("")
    own = rows.select(F.col(id_col).alias("id"), alpha.alias("alpha"))
    spread = own.where(F.length("alpha") >= 3).select("id", F.explode(F.transform(F.sequence(F.lit(3), F.length("alpha")), lambda n: F.substring(F.col("alpha"), F.lit(1), n))).alias("prefix"))
    shared = spread.groupBy("prefix").agg(F.count("*").alias("n")).where("n >= 2").select("prefix")
    best = spread.join(shared, "prefix").groupBy("id").agg(F.max_by("prefix", F.length("prefix")).alias("family"))
    return own.select("id").join(best, "id", "left").select("id", F.coalesce("family", F.lit("")).alias("family"))


def condition_digit(label: Column, text: Column) -> Column:
    """The first run of digits in the code that is a word of the text; null if none is."""
    low = F.lower(text)
    runs = F.regexp_extract_all(first_code(label), F.lit(r"(\d+)"), F.lit(1))
    return F.get(F.filter(runs, lambda d: F.rlike(low, F.concat(F.lit(r"\b"), d, F.lit(r"\b")))), F.lit(0))


def expansions(rows: DataFrame, row_col: str, label_col: str, text_col: str, group_col: str) -> DataFrame:
    """Segment, expansion: by parentheses in a text first, then by a constant suffix of a family, then by the family's group."""
    text = F.col(text_col)
    found = []
    for pattern, short, long in ((r"\b([A-Z]{2,})\s*\(([^)]{4,})\)", 1, 2), (r"\b((?:[A-Za-z][A-Za-z\-]+\s+){1,5})\(([A-Z]{2,})\)", 2, 1)):
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(short)).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(long)).alias("l"))
        found.append(rows.select(F.col(row_col).alias("row"), F.posexplode(both).alias("pos", "hit")).select("row", "pos", F.col("hit.s").alias("segment"), F.trim(F.regexp_extract(F.col("hit.l"), r"^([^.;]*)", 1)).alias("expansion")))
    first = found[0].union(found[1]).where(F.length("expansion") >= 4).groupBy("segment").agg(F.min_by("expansion", F.struct("row", "pos")).alias("expansion")).withColumn("step", F.lit(1))
    fam = families(rows, row_col, label_col).where("family <> ''")
    coded = rows.join(fam, F.col(row_col) == F.col("id"))
    segments = F.regexp_extract_all(F.expr(f"substring(split({label_col}, '/')[0], length(family) + 1)"), F.lit("[A-Z]{2,}"), F.lit(0))
    seg = coded.select(F.col(row_col).alias("row"), "family", F.col(text_col).alias("text"), F.posexplode(F.reverse(segments)).alias("pos", "segment"))
    constant = seg.groupBy("family", "pos").agg(F.count_distinct("segment").alias("n"), F.count("*").alias("rows")).where("n = 1 AND rows >= 2").select("family", "pos")
    second = seg.join(constant, ["family", "pos"]).where(F.col("text").contains(F.concat(F.col("segment"), F.lit(": "))) | F.col("text").contains(F.concat(F.col("segment"), F.lit(" - "))))
    second = second.withColumn("after", F.expr("substring(text, locate(segment, text) + length(segment))")).withColumn("expansion", F.trim(F.regexp_extract("after", r"^[-: ]+([A-Za-z][A-Za-z \-]{3,59})", 1)))
    second = second.where(F.length("expansion").between(4, 60)).groupBy("segment").agg(F.min_by("expansion", "row").alias("expansion")).withColumn("step", F.lit(2))
    third = coded.groupBy("family").agg(F.min_by(F.split(F.col(group_col), " > ")[0], row_col).alias("expansion")).where("expansion <> family AND expansion <> 'Ungrouped' AND expansion <> ''").select(F.col("family").alias("segment"), "expansion", F.lit(3).alias("step"))
    best = Window.partitionBy("segment").orderBy("step")
    return first.union(second.select("segment", "expansion", "step")).union(third).withColumn("r", F.row_number().over(best)).where("r = 1").select("segment", "expansion", "step")


def covered(text: Column, expansion: Column) -> Column:
    """Whether at least 60 % of the expansion's content words are words of the text."""
    own = F.filter(F.regexp_extract_all(F.lower(expansion), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(EXPANSION_STOP))
    inside = F.filter(own, lambda w: F.rlike(F.lower(text), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    return (F.size(own) == 0) | (F.size(inside) >= 0.6 * F.size(own))
