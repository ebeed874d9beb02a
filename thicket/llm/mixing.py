"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a budget of words. A document's hash, cut to ``3 * BITS`` bits,
orders the documents of a source once and for all, so budgets are nested: a
larger budget takes a superset. The threshold of a source is found without a
sort: words are summed by (source, top hash bits), the bucket in which the
budget ends is found, and only that boundary bucket is summed again by the next
bits, three times in all. The mix is then a filter on the hash. Rows of the last bucket
share all bits, so they repeat an id and a text (or collide): those are numbered, range by
range, and as many of them go in as come nearest to the budget.

All steps are DataFrame operations; what moves is a histogram of at most
``sources * 2**BITS`` rows a level, pre-aggregated before its shuffle.

Defined cases: a null text has size 0; a null source is a source of its own,
last in the order of sources; documents hash by id and text, so rows of one id with
different texts are taken each for itself, and of rows that repeat both some may be taken
once more than others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.storage import numbered, small, written

WORD = r"[^\x20\x09-\x0D]+"
BITS = 10
LEVELS = 3
#: Source tables of up to so many rows (a name and a few numbers each) are broadcast; longer ones are joined by shuffle.
MOST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """The first 30 bits of the MD5 of the id in decimal, a colon and the text, as a long."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - BITS * LEVELS)


def source_targets(sized: DataFrame, weights: Sequence[float], budget: float, most_copies: float) -> DataFrame:
    """A row per source of sized (source, size): source, source_size, target.

    Shares of ``budget`` times all words go by weight; a target stops at
    ``most_copies`` times its source and the excess is shared again by weight.
    The fixed point of that is a water level: sources in order of size per
    weight are capped as long as the level would lie above them.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sums.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)).withColumn("cap", F.lit(float(most_copies)) * F.col("source_size"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    since = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = (
        weighed.withColumn("pot", F.least(F.lit(float(budget)) * F.sum("source_size").over(every), F.sum("cap").over(every)))
        .withColumn("level", (F.col("pot") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(since))
        .withColumn("free", F.col("w") * F.col("level") < F.col("cap"))
        # The first free source in this order fixes the level for itself and all after it.
        .withColumn("at", F.min(F.when(F.col("free"), F.struct(F.row_number().over(by_ratio).alias("n"), F.col("level")))).over(every))
    )
    capped = F.col("at").isNull() | (F.col("w") * F.col("at.level") >= F.col("cap"))
    return leveled.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("w") * F.col("at.level")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), doc_hash(F.col(id_col), F.col(text_col)).alias("h"))


def thresholds(sized: DataFrame, weights: Sequence[float], budget: float, most_copies: int) -> DataFrame:
    """source, source_size, target, whole, edge, more of each source: a document is taken ``whole`` times, and once more if its hash is below ``edge``, or is one of the first ``more`` at it.

    sized (source, size, h) is read once for the sums and once for each level.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most_copies))).otherwise(0)
    targets = written(source_targets(sized, weights, budget, most_copies).withColumn("whole", whole.cast("long")), "mix-targets")
    edge = targets.select("source", (F.col("target") - F.col("whole") * size).alias("rest"), F.lit(0).cast("long").alias("edge"))
    for level in range(LEVELS):
        bucket = F.shiftright(F.col("h"), BITS * (LEVELS - 1 - level))
        inside = sized.alias("s").join(
            small(edge, MOST_SOURCES).alias("e"),
            F.col("s.source").eqNullSafe(F.col("e.source")) & (F.shiftright(bucket, BITS) == F.col("e.edge")),
        )
        sums = inside.groupBy(F.col("s.source").alias("source"), F.col("e.rest").alias("rest"), bucket.alias("edge")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("edge"))
        edge = (
            sums.withColumn("upto", upto)
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .select("source", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"), "edge", "words", "rows")
        )
        edge = written(edge, f"mix-edge{level}")
    cuts = targets.alias("t").join(small(edge, MOST_SOURCES).alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    # The last bucket's rows that come nearest to the budget, by their mean size.
    more = F.ceil(F.col("rest") / (F.col("words") / F.col("rows")) - 0.5)
    return small(written(cuts.select("t.*", F.coalesce("edge", F.lit(0)).alias("edge"), F.greatest(F.coalesce(more, F.lit(0)), F.lit(0)).alias("more")), "mix-cuts"), MOST_SOURCES)


def dealt(rows: DataFrame, cuts: DataFrame, most_copies: int, *kept: str) -> DataFrame:
    """The kept columns and copies of rows (source, h, order, and others); those at a source's edge are written and numbered."""
    met = rows.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select("s.*", "c.source_size", "c.target", "c.whole", "c.edge", "c.more")
    capped = lambda once: F.least(F.col("whole") + once.cast("int"), F.lit(most_copies))
    clear = met.where("h <> edge").withColumn("copies", capped(F.col("h") < F.col("edge")))
    # Few rows but for repeats of one document; their numbers go on from source to source.
    edge = written(met.where("h = edge").withColumn("unique", F.monotonically_increasing_id()), "mix-boundary")
    nth = numbered(edge.withColumn("none", F.col("source").isNull()), "nth", "none", "source", "order", "unique")
    first = small(written(nth.groupBy("source").agg(F.min("nth").alias("first")), "mix-first"), MOST_SOURCES)
    tied = nth.alias("n").join(first.alias("f"), F.col("n.source").eqNullSafe(F.col("f.source"))).select("n.*", "f.first")
    tied = tied.withColumn("copies", capped(F.col("nth") - F.col("first") < F.col("more")))
    return clear.select(*kept, "copies").unionByName(tied.select(*kept, "copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most_copies: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document: copies is how often the mix takes it, 0 to most_copies."""
    sized = written(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    cuts = thresholds(sized, weights, budget, most_copies)
    out = dealt(sized.withColumn("order", F.col("doc_id")), cuts, most_copies, "doc_id", "source", "size", "source_size", "target")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most_copies: int = 2) -> DataFrame:
    """docs with each row repeated as often as the mix takes it. Columns stay; rows are not moved, as the mix is a filter on their hash, but for those at an edge."""
    sized = written(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    cuts = thresholds(sized, weights, budget, most_copies)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("order"), doc_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    out = dealt(rows, cuts, most_copies, "row").where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
