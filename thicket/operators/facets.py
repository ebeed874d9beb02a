"""Facets of variables, as columns, and their trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.codes import first_code
from thicket.operators.profile import top_group
from thicket.operators.tree import Tree, from_paths

# Words of statistics, and those that stand for another.
STATISTICS = "mean|average|median|standard deviation|std|percent|proportion|probability|total|sum|count|maximum|minimum|range|variance|coefficient|ratio|rate|frequency"
SAME_STATISTIC = {"average": "Mean", "std": "Standard Deviation", "proportion": "Percent", "sum": "Total", "count": "Total", "frequency": "Rate"}
# Words of outcomes and of units.
OUTCOMES = "error|errors|miss|false alarm|omission|commission|incorrect|outcome|penalty"
UNITS = "second|msec|millisecond|month|week|day|year|trial|block|session|delay"


def first_hit(text: Column, pattern: str) -> Column:
    return F.get(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({pattern})\b"), F.lit(1)), F.lit(0))


def statistic(text: Column) -> Column:
    """The first statistic named in a text; Other if there is none."""
    hit = first_hit(text, STATISTICS)
    named = F.initcap(hit)
    for word, name in SAME_STATISTIC.items():
        named = F.when(hit == word, name).otherwise(named)
    return F.coalesce(named, F.lit("Other"))


def outcome(text: Column) -> Column:
    return F.coalesce(F.initcap(first_hit(text, OUTCOMES)), F.lit("Other"))


def condition(label: Column) -> Column:
    """The first run of digits in the code, validated by nothing."""
    hit = F.regexp_extract(first_code(label), r"(\d+)", 1)
    return F.when(hit == "", "No Condition").otherwise(hit)


def condition_name(rows: DataFrame, text_col: str) -> str:
    """The most common unit word of all texts and ``Condition``; ties go to the first by name."""
    hits = rows.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(rf"\b({UNITS})\b"), F.lit(1))).alias("u"))
    best = hits.groupBy("u").count().orderBy(F.desc("count"), "u").first()
    return f"{best.u.title()} Condition" if best else "Condition"


def facets(rows: DataFrame, scale_columns: list[str] | None = None) -> dict[str, Column]:
    """Facets of canonical rows by name, before those with one value are left out."""
    raw = [F.nullif(F.trim(F.element_at("raw", c)), F.lit("")) for c in scale_columns or []]
    out = {"Task": top_group(F.col("group_path")), "Variant": F.coalesce(F.get(F.split("group_path", " > "), F.lit(1)), F.lit("Other")), "Statistic": statistic(F.col("semantic_text")), "Condition": condition(F.col("label")), "Outcome Type": outcome(F.col("semantic_text"))}
    return out | ({"Scale/Precision": F.coalesce(*raw, F.lit("Unspecified"))} if raw else {})


def usable(rows: DataFrame, columns: dict[str, Column]) -> dict[str, Column]:
    """Facets with more than one value, from one aggregation."""
    counts = rows.agg(*[F.count_distinct(c).alias(f"c{i}") for i, c in enumerate(columns.values())]).first()
    return {name: c for i, (name, c) in enumerate(columns.items()) if counts[i] > 1}


def facet_tree(rows: DataFrame, facet: Column, name: str) -> Tree:
    """Root, a node for each value, a leaf for each row, which keeps its leaf_id, group_path and text where rows have them."""
    return from_paths(rows, F.array(facet), F.col("label"), name, [c for c in ("leaf_id", "group_path", "text") if c in rows.columns])
