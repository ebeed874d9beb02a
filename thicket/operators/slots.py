"""Phrase slots of a group's texts (R1, R4, R5, A-5, J7, W5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import is_meaningful, ngrams, spaced
from thicket.storage import dealt

# Words that stand for numbers in conditions, and what conditions count.
CONDITION_NUMBERS = ["all", "none", "simultaneous"]
CONDITION_HINTS = "second seconds minute minutes hour hours day days month months year years week weeks box boxes token tokens pattern patterns trial trials".split()


def prefix_of(text: Column) -> Column:
    """What stands before the first colon, as lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.substring_index(text, ":", 1)), r"[^\p{Alnum}]+", " "))


def stand_for(table: DataFrame) -> Column:
    """For how many rows each row of the table stands: its column ``times``, if there is one."""
    return F.col("times") if "times" in table.columns else F.lit(1)


def phrases(rows: DataFrame, group: str, row: str, text: Column, least: int = 2) -> DataFrame:
    """R1, A-5: grp, row, phrase: 1- to 4-grams in two rows of a group or more, without those that a longer kept one of the row contains (W5), counted again.

    Where rows have a column ``times``, each stands for so many rows of its text, and the result has it, too.
    """
    more = ["times"] if "times" in rows.columns else []
    spread = rows.select(F.col(group).alias("grp"), F.col(row).alias("row"), *more, F.explode(F.array_distinct(ngrams(spaced(text), 1, 4))).alias("phrase")).where("length(phrase) >= 3")

    def frequent(table: DataFrame) -> DataFrame:
        counts = table.groupBy("grp", "phrase").agg(F.sum(stand_for(table)).alias("n")).where(F.col("n") >= least)
        return table.join(counts, ["grp", "phrase"])

    kept = frequent(spread).groupBy("grp", "row").agg(F.collect_set("phrase").alias("all"), *[F.max(c).alias(c) for c in more])
    # A row has a few dozen phrases at most, so containment is settled within it.
    top = kept.select("grp", "row", *more, F.explode(F.filter("all", lambda p: ~F.exists("all", lambda q: (q != p) & F.contains(q, p)))).alias("phrase"))
    return frequent(top).where(is_meaningful(F.col("phrase"))).select("grp", "row", "phrase", "n", *more)


def exclusion(table: DataFrame) -> DataFrame:
    """Grp, a, b, m of phrases a < b of a group: 1 - rows with both / rows of the rarer. Pairs that never meet have m = 1 and are left out."""
    x = table.select("grp", "row", F.col("phrase").alias("a"), F.col("n").alias("na"), stand_for(table).alias("times"))
    y = table.select("grp", "row", F.col("phrase").alias("b"), F.col("n").alias("nb"))
    met = x.join(y, ["grp", "row"]).where("a < b").groupBy("grp", "a", "b", "na", "nb").agg(F.sum("times").alias("c"))
    return met.select("grp", "a", "b", F.round(1 - F.col("c") / F.least("na", "nb"), 6).alias("m"))


def slots_of(counts: dict[str, int], met: dict[tuple[str, str], float], near: float = 0.75, least: float = 0.6) -> list[list[str]]:
    """Slots of two phrases or more: from each phrase not yet seen, most frequent first, those that exclude each other are gathered, last found first."""
    order = sorted(counts, key=lambda p: (-counts[p], p))
    number = {p: i for i, p in enumerate(order)}
    # Only pairs that meet can be too close; the others are 1 apart.
    close, barred = [[] for _ in order], [[] for _ in order]
    for (p, q), m in met.items():
        for bound, lists in ((near, close), (least, barred)):
            if m < bound:
                lists[number[p]].append(number[q])
                lists[number[q]].append(number[p])
    seen, found = np.zeros(len(order), bool), []
    for seed in range(len(order)):
        if seen[seed]:
            continue
        slot, work = [seed], [seed]
        free = np.ones(len(order), bool)  # not in the slot, and apart enough from all of it
        free[[seed, *barred[seed]]] = False
        while work:
            at = work.pop()
            mine = free.copy()
            mine[close[at]] = False
            for p in np.flatnonzero(mine).tolist():
                if free[p]:
                    slot.append(p)
                    work.append(p)
                    free[[p, *barred[p]]] = False
        if len(slot) > 1:
            seen[slot] = True
            found.append([order[p] for p in slot])
    return found


def slots(table: DataFrame) -> DataFrame:
    """grp, slot, phrase of all groups; the input of a group is its phrases and their pairs, not its rows."""
    counts = table.groupBy("grp", "phrase").agg(F.max("n").alias("n"))
    left = counts.select("grp", F.lit(0).alias("kind"), F.col("phrase").alias("a"), F.lit("").alias("b"), F.col("n").cast("double").alias("v"))
    right = exclusion(table).select("grp", F.lit(1).alias("kind"), "a", "b", F.col("m").alias("v"))

    def one(pdf):
        import pandas as pd

        own = pdf[pdf.kind == 0]
        pairs = pdf[pdf.kind == 1]
        met = dict(zip(zip(pairs.a, pairs.b), pairs.v))
        found = slots_of(dict(zip(own.a, own.v)), met)
        rows = [(pdf.grp.iloc[0], i, p) for i, slot in enumerate(found) for p in slot]
        return pd.DataFrame(rows, columns=["grp", "slot", "phrase"])

    return dealt(left.union(right), "grp").groupBy("grp").applyInPandas(one, f"grp {left.schema['grp'].dataType.simpleString()}, slot int, phrase string")


def assigned(table: DataFrame, slot_table: DataFrame) -> DataFrame:
    """Grp, row, slot, phrase: the most frequent phrase of each slot in a row, ties by phrase."""
    best = Window.partitionBy("grp", "row", "slot").orderBy(F.desc("n"), "phrase")
    more = ["times"] if "times" in table.columns else []
    return table.join(slot_table, ["grp", "phrase"]).withColumn("r", F.row_number().over(best)).where("r = 1").select("grp", "row", "slot", "phrase", *more)


def gated(table: DataFrame, assignment: DataFrame, rows_per_group: DataFrame, coverage: float = 0.55) -> DataFrame:
    """Assignments of groups that hold: four rows, four phrases and two slots or more, and a slot's phrase in 0.55 of all rows; rows_per_group has (grp, total)."""
    rows = assignment.groupBy("grp", "row").agg(F.max(stand_for(assignment)).alias("times"))
    covered = rows.groupBy("grp").agg(F.sum("times").alias("covered"))
    held = assignment.groupBy("grp").agg(F.count_distinct("slot").alias("slots")).join(covered, "grp")
    many = table.groupBy("grp").agg(F.count_distinct("phrase").alias("phrases"))
    fine = held.join(many, "grp").join(rows_per_group, "grp").where((F.col("total") >= 4) & (F.col("phrases") >= 4) & (F.col("slots") >= 2) & (F.col("covered") / F.col("total") >= coverage))
    return assignment.join(fine.select("grp"), "grp", "left_semi")


def is_condition(phrase: Column) -> Column:
    """A phrase with a number, or a word like one, and a word for what is counted."""
    own = F.split(phrase, " ")
    return F.exists(own, lambda w: w.rlike(r"^\d+$") | w.isin(CONDITION_NUMBERS)) & F.exists(own, lambda w: w.isin(CONDITION_HINTS))


def slot_order(assignment: DataFrame, rows_per_group: DataFrame) -> DataFrame:
    """Grp, slot, score, of slots with a positive score: distinct values - 0.6 singletons + 0.4 coverage + 0.3 (words - 1) - 0.8 share of conditions."""
    values = assignment.groupBy("grp", "slot", "phrase").agg(F.count("*").alias("n"))
    words, digits = F.size(F.split("phrase", " ")), is_condition(F.col("phrase")).cast("int")
    sums = values.groupBy("grp", "slot").agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("s"), F.sum("n").alias("c"), F.avg(words).alias("w"), F.avg(digits).alias("g"))
    score = F.col("d") - 0.6 * F.col("s") + 0.4 * F.col("c") / F.col("total") + 0.3 * (F.col("w") - 1) - 0.8 * F.col("g")
    return sums.join(rows_per_group, "grp").select("grp", "slot", F.round(score, 6).alias("score")).where("score > 0")
