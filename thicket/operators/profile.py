"""Column profiles, role detection and the canonical variable table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import CHUNK_SEP, LEAF_SEP, PATH_SEP, safe, without_urls

# Words in column names that speak for a role.
LEAF_KEYS = "variable var field column attribute name code id item indicator question measure concept".split()
GROUP_KEYS = "task category domain module section table dataset assessment test variant group topic instrument form subscale construct".split()
TEXT_KEYS = "description definition desc label title question meaning note notes text display full details explanation comment".split()
META_KEYS = "type dtype data_type datatype unit units format decimal precision values value coding codebook range min max scale".split()
# Columns about representation never become levels.
REPRESENTATION = "decimal precision unit dtype type format scale values range min max coding codebook missing".split()
# Phrases that tell a domain.
DOMAIN_SIGNALS = {
    "cognitive": ["reaction time", "response time", "memory", "attention", "executive", "cognitive", "correct", "error", "delay", "task", "trial", "stimulus", "recall", "recognition", "working memory", "inhibition", "processing speed", "latency", "accuracy", "hit", "false alarm", "miss"],
    "biomedical": ["patient", "clinical", "diagnosis", "treatment", "disease", "symptom", "medication", "hospital", "brain", "neural", "mri", "fmri", "eeg", "biomarker", "genetic", "phenotype", "cohort", "longitudinal"],
    "finance": ["price", "return", "portfolio", "equity", "bond", "yield", "market", "stock", "currency", "gdp", "inflation", "revenue", "profit", "index"],
    "environment": ["temperature", "precipitation", "climate", "emission", "pollution", "biodiversity", "ecosystem", "carbon", "species", "habitat", "soil"],
    "survey": ["questionnaire", "likert", "respondent", "survey", "agree", "disagree", "strongly", "satisfaction", "attitude", "opinion"],
}


def normal_name(column: str, gap: str = "_") -> str:
    """Lower case, runs of other characters as one gap."""
    return re.sub("[^a-z0-9]+", gap, column.strip().lower()).strip(gap)


def key_score(column: str, keys: list[str], gap: str = "_") -> int:
    """How many keys are substrings of the normalized name."""
    name = normal_name(column, gap)
    return sum(k in name for k in keys)


def profile(df: DataFrame, variant: str = "a1") -> DataFrame:
    """A row per column, from one aggregation over all columns.

    variant "a2" drops the length and null terms and lets groups have 300 values.
    """
    flat = {c: t not in ("array", "map", "struct") for c, t in ((f.name, f.dataType.typeName()) for f in df.schema.fields)}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        text = col.cast("string") if flat[c] else F.to_json(col)
        aggs += [F.count(col).alias(f"f{i}"), F.count_distinct(col if flat[c] else text).alias(f"u{i}"), F.avg(F.length(text)).alias(f"l{i}")]
    one = df.agg(*aggs)
    n = F.greatest(F.col("rows"), F.lit(1))
    a2 = variant == "a2"
    gap = " " if a2 else "_"
    items = []
    for i, c in enumerate(df.columns):
        unique, ratio, length, filled = F.col(f"u{i}"), F.col(f"u{i}") / n, F.coalesce(F.col(f"l{i}"), F.lit(0.0)), F.col(f"f{i}") / n

        def yes(condition: Column, points: int) -> Column:
            return F.when(condition, points).otherwise(0)

        leaf = 4 * key_score(c, LEAF_KEYS, gap) + yes(ratio.between(0.5, 1), 3) + (F.lit(0) if a2 else yes(length < 80, 1))
        group = 4 * key_score(c, GROUP_KEYS, gap) + yes((unique > 1) & (unique < F.least(0.5 * n, F.lit(300 if a2 else 80))), 3) + (F.lit(0) if a2 else yes(length < 60, 1))
        text = 5 * key_score(c, [k for k in TEXT_KEYS if not (a2 and k == "comment")], gap) + yes(length > 50, 4) + (F.lit(0) if a2 else yes(filled > 0.5, 1))
        meta = 4 * key_score(c, [k for k in META_KEYS if not (a2 and k == "codebook")], gap) + yes((unique > 1) & (unique < F.least(0.8 * n, F.lit(100))), 2)
        items.append(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.round(filled, 3).alias("non_null"), unique.alias("unique_values"), F.round(ratio, 3).alias("unique_ratio"), F.round(length, 1).alias("avg_length"), leaf.alias("leaf_score"), group.alias("group_score"), text.alias("text_score"), meta.alias("metadata_score")))
    return one.select(F.inline(F.array(*items)))


@dataclass
class Roles:
    leaf: list[str] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    meta: list[str] = field(default_factory=list)


def is_representation(column: str) -> bool:
    plain = re.sub("[^a-z0-9]", "", column.lower())
    return any(k in plain for k in REPRESENTATION)


def roles(df: DataFrame, variant: str = "a1") -> Roles:
    """Roles of columns; ties go to the order of columns. The profile has a row per column."""
    rows = profile(df, variant).collect()
    a2 = variant == "a2"

    def ranked(of: list, *keys: str) -> list[str]:
        return [r.column for r in sorted(of, key=lambda r: (*(-r[k] for k in keys), r.ord))]

    leaf = ranked(rows, "leaf_score", "unique_ratio")[:1]
    text = ranked([r for r in rows if r.text_score >= 4 or (not a2 and r.avg_length > 80)], "text_score") or list(leaf)
    group = ranked([r for r in rows if r.group_score >= 4 and r.column not in leaf and r.unique_values > 1], "group_score")[:3]
    meta = ranked([r for r in rows if r.metadata_score >= 4 and r.column not in text + leaf + group], "metadata_score")[: 4 if a2 else 5]
    if not a2:
        meta += [r.column for r in rows if is_representation(r.column) and r.column not in text + leaf + meta]
        group = [c for c in group if not is_representation(c)]
        meta = meta[:8]
    return Roles(leaf, group, text, meta)


def dtype_guess(meta: Column, label: Column) -> Column:
    """P7."""
    low = F.lower(meta)
    return F.when(low.rlike("num|int|float|double|decimal|continuous"), "number").when(low.rlike("string|text|char|category|categorical|nominal") | F.lower(label).rlike("name|country|gender|sex|site|visit|status"), "string").otherwise("determine")


def top_group(path: Column) -> Column:
    """P12."""
    return F.coalesce(F.nullif(F.split_part(path, F.lit(PATH_SEP), F.lit(1)), F.lit("")), F.lit("Ungrouped"))


def second_group(path: Column) -> Column:
    """P13."""
    return F.get(F.split(path, PATH_SEP), F.lit(1))


def deduplicated(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Ids that come again get ``__2``, ``__3`` and so on, in row order.

    The windows are per id; an id that a third of all rows share makes a large
    window, which is why ids are numbered on rows without their texts.
    """
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(order_col))
    return df.withColumn(id_col, F.when(k == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("__"), k.cast("string"))))


def canonical(df: DataFrame, roles: Roles, row_col: str, source: str = "", variant: str = "a1") -> DataFrame:
    """The canonical rows: source, row, label, leaf_id, group_path, text, semantic_text, dtype, raw. row_col orders the rows from 0."""

    def parts(columns: list[str]) -> Column:
        return F.filter(F.array(*[safe(F.col(f"`{c}`")) for c in columns]) if columns else F.array().cast("array<string>"), lambda p: p != "")

    row = F.col(f"`{row_col}`").cast("long")
    a2 = variant == "a2"
    label = F.concat_ws(LEAF_SEP, parts(roles.leaf))
    label = F.when(label == "", F.concat(F.lit("var_" if a2 else "variable_"), (row if a2 else row + 1).cast("string"))).otherwise(label)
    path = F.concat_ws(PATH_SEP, F.filter(parts(roles.group), lambda p: ~F.lower(p).isin("nan", "none")))
    path = F.when(path == "", "Ungrouped").otherwise(path)
    own = F.col("label") if not a2 else None
    chunks = F.concat_ws(CHUNK_SEP, F.filter(F.array(*[F.when(safe(F.col(f"`{c}`")) != "", F.concat(F.lit(c + ": "), safe(F.col(f"`{c}`")))) for c in dict.fromkeys(roles.group + roles.leaf + roles.text + roles.meta)]), lambda p: p.isNotNull()))
    described = F.concat_ws(" ", parts([c for c in roles.text if c not in roles.leaf]))
    out = df.select(
        F.lit(source).alias("source"), row.alias("row"), label.alias("label"), path.alias("group_path"), chunks.alias("text"),
        F.trim(without_urls(F.when(described != "", described).otherwise(F.concat_ws(" ", parts(roles.leaf))))).alias("semantic_text"),
        F.concat_ws(" ", parts(roles.meta)).alias("meta"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("raw"),
    )
    joined = F.concat(F.col("group_path"), F.lit("."), F.col("label"))
    out = out.withColumn("leaf_id", joined if own is None else F.when(F.col("group_path") == "Ungrouped", own).otherwise(joined))
    out = out.withColumn("dtype", dtype_guess(F.col("meta"), F.col("label")))
    return deduplicated(out, "leaf_id", "row").select("source", "row", "label", "leaf_id", "group_path", "text", "semantic_text", "dtype", "raw")


def domain_scores(texts: DataFrame, text_col: str) -> DataFrame:
    """Domain, score: how many of a domain's signals occur in some text. One pass, one flag per signal."""
    flat = [(d, s) for d, own in DOMAIN_SIGNALS.items() for s in own]
    low = F.lower(F.col(text_col))
    flags = texts.agg(*[F.max(F.when(low.contains(s), 1).otherwise(0)).alias(f"s{i}") for i, (_, s) in enumerate(flat)])
    sums = [F.struct(F.lit(d).alias("domain"), sum((F.coalesce(F.col(f"s{i}"), F.lit(0)) for i, (e, _) in enumerate(flat) if e == d), F.lit(0)).alias("score"), F.lit(k).alias("ord")) for k, d in enumerate(DOMAIN_SIGNALS)]
    return flags.select(F.inline(F.array(*sums)))


def domain(texts: DataFrame, text_col: str) -> str:
    """The domain with most signals, the first of equals; general below two."""
    best = domain_scores(texts, text_col).orderBy(F.desc("score"), "ord").first()
    return best.domain if best.score >= 2 else "general"


def group_filter(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches the regular expression in any case."""
    return rows.where(F.col(column).rlike("(?i)" + pattern))


def field_noise(columns: list[str]) -> list[str]:
    """Words of column names, and generic ones, that never label a node."""
    own = {w for c in columns for w in re.split(r"[^A-Za-z0-9]+", c.lower()) if len(w) >= 2}
    # Words of dictionary columns in general.
    return sorted(own | set("variable field column name code description definition type value values label text".split()))
