"""Caller's functions over batches of rows, with grounding and an audit.

A function, such as a client of a language model, is called on the executors for a batch of rows at a
time; what it says is written once, so that a task that is run again later does not change the
answers. Every answer is held against the row's own text before it counts: it must stand there word for
word, or have no word whose stem does not. What is refused stands in the audit with the reason.
No model comes with the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import PHRASE_STOP, concept_and_body, is_boilerplate, light_stem, spaced
from thicket.storage import written

# Roles that are taken from single rows, in this order.
ROW_ROLES = ["measure", "statistic", "condition", "subtype"]
#: Rows that a function is given at once.
BATCH = 64
#: (concept, full text, concepts of the group's first rows) of each row to a role's value by role.
Extractor = Callable[[list[str], list[str], list[list[str]]], list[dict[str, str]]]
#: (candidate, terms, path, sample texts) of each node to a label.
Labeller = Callable[[list[str], list[list[str]], list[str], list[list[str]]], list[str]]


def answered(rows: DataFrame, keys: list[str], given: list[str], ask: Callable[..., list], kind: str, batch: int = BATCH) -> DataFrame:
    """keys, answer, failed of rows: what ask() says of the given columns, a batch at a time; an exception, or a list of another length, leaves the batch without answers."""
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys), f"answer {kind}", "failed string"])
    answer = {"string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                try:
                    out, failed = list(ask(*[part.column(len(keys) + i).to_pylist() for i in range(len(given))])), None
                    if len(out) != part.num_rows:
                        out, failed = [None] * part.num_rows, f"{len(out)} answers for {part.num_rows} rows"
                except Exception as e:  # a caller's function may fail in any way; the audit tells
                    out, failed = [None] * part.num_rows, f"exception: {type(e).__name__}"
                if kind != "string":
                    out = [None if o is None else [(str(k), v if isinstance(v, str) else None) for k, v in o.items()] for o in out]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], pa.array(out, answer), pa.array([failed] * part.num_rows, pa.string())], [*keys, "answer", "failed"])

    return written(rows.select(*keys, *given).mapInArrow(run, schema), "answers")


def stems(text: Column, least: int = 3) -> Column:
    """Stems of the words of a text of ``least`` characters or more, without marks at their ends and stop words."""
    words = F.transform(spaced(F.lower(text)), lambda w: F.regexp_replace(w, r"^[,.()\[\]{}\"']+|[,.()\[\]{}\"']+$", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(PHRASE_STOP)), light_stem))


def grounded(rows: DataFrame, value: str, ground: str) -> DataFrame:
    """rows with missing: null where the value stands in the ground or all its stems do; else the stems that do not, or ``boilerplate``, or ``(no content words)``."""
    own, there = stems(F.col(value)), stems(F.col(ground))
    inside = F.contains(F.lower(ground), F.lower(value))
    rest = F.sort_array(F.array_except("\u0000own", "\u0000there"))
    missing = F.when(is_boilerplate(F.col(value)), F.array(F.lit("boilerplate"))).when(inside, None).when(F.size("\u0000own") == 0, F.array(F.lit("(no content words)"))).when(F.size(rest) > 0, rest)
    return rows.withColumn("\u0000own", own).withColumn("\u0000there", there).withColumn("missing", missing).drop("\u0000own", "\u0000there")


def row_roles(rows: DataFrame, extract: Extractor, least_rows: int = 4, coverage: float = 0.4, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """R2: (grp, row, role, value) of the groups that hold, and the audit (grp, row, role, value, accepted, reason) of every answer.

    rows has (grp, row, text). A group holds with least_rows rows, two roles of two values or more, and one of those
    in a share ``coverage`` of its rows. Roles are those of ROW_ROLES; answers of other roles are refused. A row without text is not asked.
    """
    concept, body = concept_and_body(F.coalesce("text", F.lit("")))
    own = rows.select("grp", "row", F.substring(concept, 1, 300).alias("concept"), F.substring(F.trim(F.concat_ws(" ", concept, body)), 1, 600).alias("full"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy("row"))
    samples = own.withColumn("r", first).where(F.col("r") <= 3).groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "concept"))), lambda x: x["concept"]).alias("samples"))
    totals = own.groupBy("grp").agg(F.count("*").alias("total"))
    asked = own.join(totals.where(F.col("total") >= least_rows), "grp").join(samples, "grp").where(F.length(F.trim("concept")) >= 3)
    said = answered(asked, ["grp", "row", "full"], ["concept", "full", "samples"], extract, "map<string,string>", batch)
    values = said.where("answer IS NOT NULL").select("grp", "row", "full", F.explode("answer").alias("role", "raw"))
    values = values.select("grp", "row", "full", "role", F.regexp_replace(F.trim("raw"), r"^[\"']+|[\"']+$", "").alias("value")).where("value <> ''")
    held = grounded(values, "value", "full")
    reason = F.when(~F.col("role").isin(ROW_ROLES), F.lit("unknown role")).when(F.col("missing").isNull(), F.lit("accepted")).otherwise(F.array_join("missing", ", "))
    checked = written(held.select("grp", "row", "role", "value", reason.alias("reason")), "row-roles")
    failed = said.where("failed IS NOT NULL").select("grp", "row", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("value"), F.col("failed").alias("reason"))
    audit = checked.union(failed).select("grp", "row", "role", "value", (F.col("reason") == "accepted").alias("accepted"), "reason")
    fine = checked.where("reason = 'accepted'").select("grp", "row", "role", "value")
    kinds = fine.groupBy("grp", "role").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= 2)
    kept = fine.join(kinds.select("grp", "role"), ["grp", "role"], "left_semi")
    shape = kept.groupBy("grp").agg(F.count_distinct("role").alias("roles"), F.count_distinct("row").alias("covered")).join(totals, "grp")
    good = shape.where((F.col("roles") >= 2) & (F.col("covered") >= coverage * F.col("total"))).select("grp")
    return kept.join(good, "grp", "left_semi").select("grp", "row", "role", "value"), audit


def refined_labels(nodes: DataFrame, label: Labeller, batch: int = BATCH) -> DataFrame:
    """Node, label, accepted, proposed, reason of nodes (node, candidate, terms, path, samples): the caller's label, if every word of it has a stem in the node's terms, samples or path; else the candidate."""
    key = nodes.schema["node"].dataType.simpleString()
    own = nodes.select("node", "candidate", F.slice(F.coalesce("terms", F.array().cast("array<string>")), 1, 10).alias("terms"), F.coalesce("path", F.lit("")).alias("path"), F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, 4).alias("samples"))
    said = answered(own, ["node", "candidate", "terms", "path", "samples"], ["candidate", "terms", "path", "samples"], label, "string", batch)
    ground = F.lower(F.concat_ws(" ", F.col("terms"), F.col("samples"), F.col("path")))
    plain = lambda x: F.array_distinct(F.transform(F.filter(spaced(F.lower(x)), lambda w: F.length(w) >= 3), light_stem))
    held = said.withColumn("proposed", F.trim(F.coalesce("answer", F.lit("")))).withColumn("own", plain(F.col("proposed"))).withColumn("there", plain(ground))
    rest = F.sort_array(F.array_except("own", "there"))
    reason = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("proposed") == "", F.lit("empty")).when(F.size(rest) > 0, F.concat(F.lit("ungrounded: "), F.array_join(rest, ", "))).otherwise(F.lit("accepted"))
    out = held.select(F.col("node").cast(key).alias("node"), "candidate", "proposed", reason.alias("reason"))
    fine = F.col("reason") == "accepted"
    return out.select("node", F.when(fine, F.col("proposed")).otherwise(F.col("candidate")).alias("label"), fine.alias("accepted"), "proposed", "reason")
