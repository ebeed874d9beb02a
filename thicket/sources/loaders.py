"""Dictionary files as DataFrames of strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.storage import numbered
from pyspark.sql import types as T

ENCODINGS = ("UTF-8", "ISO-8859-1")
SEPARATORS = (",", "\t", ";", "|")


def cleaned(df: DataFrame) -> DataFrame:
    """Names without blanks around and without semicolons."""
    return df.toDF(*[c.replace("﻿", "").strip().replace(";", "") or f"column_{i}" for i, c in enumerate(df.columns)])


def read_csv(spark: SparkSession, path: str, variant: str = "a1") -> DataFrame:
    """The separator and encoding with the highest ``10 * columns - mean share of nulls``, the first of equals.

    Each trial is one aggregation. variant "a2" wants two columns, drops broken
    lines and repairs nothing.
    """
    best = None
    for encoding in ENCODINGS:
        for sep in SEPARATORS:
            reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
            df = cleaned((reader.option("mode", "DROPMALFORMED") if variant == "a2" else reader).csv(path))
            if not df.columns or (variant == "a2" and len(df.columns) < 2):
                continue
            shares = df.agg(*[F.avg(F.isnull(f"`{c}`").cast("int")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
            known = [s for s in shares if s is not None]
            score = 10 * len(df.columns) - (sum(known) / len(known) if known else 1.0)
            if best is None or score > best[0]:
                best = (score, df)
    if best is None:
        raise ValueError(f"no table in {path}")
    return best[1] if variant == "a2" else unpacked(spark, path, best[1])


def unpacked(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """S3: if over half of the first column's values have commas and over 70 % of the rest are null, each line was one quoted string; it is cut anew."""
    first, rest = df.columns[0], df.columns[1:]
    packed = F.avg(F.contains(F.coalesce(F.col(f"`{first}`"), F.lit("")), F.lit(",")).cast("int"))
    nulls = reduce(lambda a, b: a + b, [F.avg(F.isnull(f"`{c}`").cast("int")) for c in rest]) / len(rest) if rest else F.lit(1.0)
    row = df.agg(packed.alias("p"), nulls.alias("n")).first()
    if not ("," in first or rest) or (row.p or 0) <= 0.5 or (row.n or 0) <= 0.7:
        return df
    lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace(F.trim("value"), ";+$", ""), '^"|"$', "").alias("line"))
    names = [c.strip().strip('"').replace(";", "") for c in lines.first().line.split(",")]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    fields = F.from_csv(F.regexp_replace("line", '""', '"'), schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"quote": '"'})
    header = ",".join(names)
    return lines.where(F.regexp_replace("line", '"', "") != header).where(F.size(F.split("line", ",")) >= len(names)).select(fields.alias("r")).select("r.*")


def flattened(df: DataFrame) -> DataFrame:
    """Nested records as columns with dotted names, all strings."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`")[g].alias(f"{f.name}.{g}") for g in f.dataType.names]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(columns)
    return df.select([(F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or the first list of records in an object."""
    df = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists:
        df = df.select(F.inline(f"`{lists[0]}`"))
    return flattened(df)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a pipe table, padded or cut to its header."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).where("line LIKE '%|%'").where(~F.col("line").rlike(r"^[\s|:\-]+$"))
    cells = lines.select("at", F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("c"))
    head = cells.orderBy("at").first()
    return cells.where(F.col("at") > head["at"]).select([F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(head.c)])


def load_any(spark: SparkSession, path: str, variant: str = "a1") -> DataFrame:
    """By suffix. S6: Excel needs a package that is not here."""
    low = path.lower()
    if low.endswith(".json"):
        return read_json(spark, path)
    if low.endswith(".parquet"):
        return flattened(spark.read.parquet(path))
    if low.endswith((".md", ".markdown")):
        return read_markdown(spark, path)
    if low.endswith((".xls", ".xlsx")):
        raise NotImplementedError("Excel files need openpyxl; save the sheet as CSV")
    return read_csv(spark, path, variant)


def probably_raw(df: DataFrame) -> bool:
    """Over 20 columns, and none named like a text."""
    from thicket.operators.profile import TEXT_KEYS, key_score

    return len(df.columns) > 20 and not any(key_score(c, TEXT_KEYS) for c in df.columns)


def raw_to_dictionary(df: DataFrame, most: int = 5) -> DataFrame:
    """Variable, description of each column: its type and its first distinct values in order.

    Values are numbered within a column after equal ones are one, so a column's
    state is a row per distinct value, pre-aggregated in each task.
    """
    at = F.monotonically_increasing_id()
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("variable"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"`{f.name}`").cast("string").alias("value")) for i, f in enumerate(df.schema.fields)])
    long = df.select(at.alias("at"), F.explode(items).alias("i")).select("at", "i.*")
    first = long.where("value IS NOT NULL").groupBy("ord", "variable", "dtype", "value").agg(F.min("at").alias("at"))
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("ord").orderBy("at", "value"))).where(F.col("r") <= most)
    values = kept.groupBy("ord", "variable", "dtype").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda v: v["value"]), ", ").alias("values"))
    return values.select("ord", "variable", F.concat(F.lit("Column dtype: "), "dtype", F.lit(" Values: "), "values").alias("description"))


def merged(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables under one schema, with their source and a row number over all."""
    parts = [df.withColumn("_source", F.lit(name)).withColumn("_at", F.monotonically_increasing_id()) for name, df in tables]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = {name: i for i, (name, _) in enumerate(tables)}
    rank = F.create_map(*[x for name, i in order.items() for x in (F.lit(name), F.lit(i))])
    return numbered(both.withColumn("_rank", rank[F.col("_source")]), "_row", "_rank", "_at").drop("_at", "_rank")


def capped(df: DataFrame, most: int) -> DataFrame:
    """The first rows by source and number; for a user who asks for it."""
    return df.orderBy("_source", "_row").limit(most)


def read_tree(spark: SparkSession, path: str, lines: bool = True):
    """A tree from JSON, an object a line as sinks.write_tree has it, or (lines=False) one list of objects."""
    from thicket.operators.tree import Tree, ordered

    rows = spark.read.schema("id long, name string, type string, related array<long>").option("multiLine", not lines).json(path)
    return Tree(rows.select("id", "name", "type"), ordered(rows.select(F.col("id").alias("parent"), F.explode("related").alias("child"))))
