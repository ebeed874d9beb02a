"""Term statistics in long tables (A-3, A-6 to A-9, W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import ngrams
from thicket.storage import small, written

#: Tables of up to so many terms are broadcast.
MOST_TERMS = 500_000


def grams(text: Column, low: int = 1, high: int = 1, pattern: str = r"(?U)\b\w\w+\b", stop: list[str] | None = None) -> Column:
    """N-grams of the lower-cased words of a text, with repeats; stop words go before n-grams are made."""
    return ngrams(F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(stop) if stop else F.lit(True)), low, high)


def terms(docs: DataFrame, id_col: str, text: Column, low: int = 1, high: int = 1, pattern: str = r"(?U)\b\w\w+\b", stop: list[str] | None = None) -> DataFrame:
    """doc, term, tf: n-grams of the lower-cased words of a text; stop words go before n-grams are made."""
    # Texts are dealt by document once; counts by document, their lengths and joins by document then need no further shuffle.
    dealt = docs.select(F.col(id_col).alias("doc"), text.alias("\u0000text")).repartition("doc")
    spread = dealt.select("doc", F.explode(grams(F.col("\u0000text"), low, high, pattern, stop)).alias("term"))
    return spread.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def doc_freq(table: DataFrame) -> DataFrame:
    """A-3: term, df."""
    return table.groupBy("term").agg(F.count("*").alias("df"))


def corpus_idf(table: DataFrame, n_docs: int) -> DataFrame:
    """A-6: term, df, idf = ln((N + 1) / (df + 1)) + 1."""
    return doc_freq(table).withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)


def tfidf(table: DataFrame, n_docs: int, max_features: int | None = None) -> DataFrame:
    """A-7: doc, term, tfidf with smoothed idf and rows of length 1; max_features keeps the terms of highest count, ties by term."""
    if max_features:
        top = table.groupBy("term").agg(F.sum("tf").alias("c")).orderBy(F.desc("c"), "term").limit(max_features).select("term")
        table = table.join(F.broadcast(top) if max_features <= MOST_TERMS else top, "term")
    # The frequencies of terms of several documents go to all tasks, if they are small; any other term has one document.
    several = small(written(doc_freq(table).where("df > 1"), "term-frequencies"), MOST_TERMS)
    idf = F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(1)) + 1)) + 1
    weighed = table.join(several, "term", "left").withColumn("w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return weighed.select("doc", "term", (F.col("w") / norm).alias("tfidf"))


def top_terms(table: DataFrame, n_docs: int, most: int) -> DataFrame:
    """A-8: term, mean_tfidf, df of the highest means; documents without the term count as 0."""
    means = table.groupBy("term").agg((F.sum("tfidf") / n_docs).alias("mean_tfidf"), F.count("*").alias("df"))
    return means.orderBy(F.desc(F.round("mean_tfidf", 9)), "term").limit(most)


def top_terms_per_group(table: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """Grp, term, score, rank: terms of the highest mean in each group; groups has (doc, grp)."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    means = table.join(groups, "doc").groupBy("grp", "term").agg(F.sum("tfidf").alias("s")).join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, "grp").withColumn("score", F.round(F.col("s") / F.col("n"), 6))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "term")))
    return ranked.where(F.col("rank") <= most).select("grp", "term", "score", "rank")


def contrast(presence: DataFrame, groups: DataFrame, least_in: int = 2, share: float = 0.5) -> DataFrame:
    """L1, A-9: grp, term, f_in, score = share inside a group minus share outside, of terms in two or more of its documents or half of them.

    presence has (doc, term) once each, groups (doc, grp); counts outside are the
    totals less those inside, so no document meets another.
    """
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n_in"))
    total = groups.count()
    inside = presence.join(groups, "doc").groupBy("grp", "term").agg(F.count("*").alias("f_in"))
    overall = inside.groupBy("term").agg(F.sum("f_in").alias("f_all"))
    both = inside.join(sizes, "grp").join(overall, "term")
    p_in, p_out = F.col("f_in") / F.greatest("n_in", F.lit(1)), (F.col("f_all") - F.col("f_in")) / F.greatest(F.lit(total) - F.col("n_in"), F.lit(1))
    return both.where((F.col("f_in") >= least_in) | (p_in >= share)).select("grp", "term", "f_in", F.round(p_in - p_out, 9).alias("score"))


def contrastive_labels(presence: DataFrame, groups: DataFrame, most: int = 2) -> DataFrame:
    """L1: grp, label: the two best terms of positive score joined by `` / ``, ties by term; ``Group`` if there is none."""
    ranked = contrast(presence, groups).where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "term"))).where(F.col("r") <= most)
    named = ranked.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: F.initcap(x["term"])), " / ").alias("label"))
    return groups.select("grp").distinct().join(named, "grp", "left").select("grp", F.coalesce("label", F.lit("Group")).alias("label"))
