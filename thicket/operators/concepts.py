"""Concept candidates, concept tables, their scores, and labels from shared titles (E1, E2, E9-E11, F2, F3, J4, J5, J12, L2, A-4, W2, W3, T19)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import LABEL_STOP, PATH_SEP, ngrams, spaced, title_phrases, words
from thicket.operators import tfidf
from thicket.operators.profile import top_group
from thicket.storage import cut, small, written

# Words that tell a state and name no concept.
VALUE_STATES = "true false yes no completed incomplete missing unknown none other na n/a not done pending available unavailable".split()
# Names of groups that stand for no group.
NO_GROUP = ("", "ungrouped", "nan", "none")
# How far a concept's source is trusted; other sources count as noun_phrase.
SOURCE_CONFIDENCE = {"group_path": 0.95, "description_title": 0.91, "bioportal": 0.92, "cognitive_atlas": 0.94, "wikidata": 0.88, "wordnet": 0.83, "pubmed": 0.82, "wikipedia": 0.78, "metadata_tfidf": 0.65, "noun_phrase": 0.55}
# Words of links and documentation, which lower a concept's score.
LINK_WORDS = r"(?i)\b(http|href|wiki|neurolex|org|www|definition|category|link|url)\b"
# Fixed value: the pattern of multi-word phrases.
PHRASE = r"\b([a-z][a-z0-9]{1,}(?:\s+[a-z][a-z0-9]{1,}){1,3})\b"
#: Group names of up to so many words are taken off the front of titles.
MOST_TOP_WORDS = 6
MOST_GROUPS = 100_000


def is_value_state(label: Column) -> Column:
    """whether a label has words besides stop words, and all of them tell a state."""
    own = F.array_except(F.regexp_extract_all(F.lower(label), F.lit(r"\b[a-z]{2,}\b"), F.lit(0)), words(*LABEL_STOP))
    return (F.size(own) > 0) & (F.size(F.array_except(own, words(*VALUE_STATES))) == 0)


def confidence_of(source: Column) -> Column:
    """E9."""
    known = F.create_map(*[F.lit(x) for pair in SOURCE_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.element_at(known, source), F.lit(SOURCE_CONFIDENCE["noun_phrase"]))


def _none(table: DataFrame) -> DataFrame:
    return table.select("label", F.col("n").cast("long").alias("n"))


def titles(rows: DataFrame, text: Column, path: Column) -> DataFrame:
    """label, n of the titles before a colon or a bar: under 0.8 of the text, of 3 characters and 1 to 4 words after a group's name in front is gone, in two rows or more.

    Titles are counted before group names are looked up, so that a title that
    many rows share is one row there.
    """
    all_text = F.coalesce(text, F.lit(""))
    body = F.trim(F.when(all_text.rlike("(?i)description:"), F.regexp_extract(all_text, r"(?is)^.*description\s*:(.*)$", 1)).otherwise(all_text))
    title = F.trim(F.get(F.split(body, "[:|]"), F.lit(0)))
    plain = F.trim(F.regexp_replace(title, r"^[\s\d\W]+", ""))
    found = rows.where((F.length(body) >= 3) & (F.length(title) < 0.8 * F.length(body))).select(plain.alias("title")).where((F.length("title") >= 3) & ~F.col("title").rlike(r"^[\d ]+$")).groupBy("title").agg(F.count("*").alias("n"))
    tops = rows.select(F.lower(F.trim(top_group(path))).alias("top")).distinct().where(~F.col("top").isin(*NO_GROUP[:3]))
    found = found.withColumn("w", spaced(F.col("title")))
    ends = F.sequence(F.lit(1), F.least(F.size("w") - 1, F.lit(MOST_TOP_WORDS)))
    fronts = found.where(F.size("w") > 1).select("title", F.explode(ends).alias("k"), "w").select("title", "k", F.lower(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).alias("top"))
    cuts = fronts.join(small(tops, MOST_GROUPS), "top").groupBy("title").agg(F.max("k").alias("k"))
    label = F.when(F.col("k").isNull(), F.col("title")).otherwise(F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " "))
    own = found.join(cuts, "title", "left").select(label.alias("label"), "n").where((F.length("label") >= 3) & (F.size(spaced(F.col("label"))) <= 4) & ~is_value_state(F.col("label")))
    return _none(own.groupBy("label").agg(F.sum("n").alias("n")).where("n >= 2").where(~F.col("label").contains("_")))


def group_parts(rows: DataFrame, path: Column) -> DataFrame:
    """label, n: parts of group paths, with the number of distinct paths that have them."""
    parts = rows.select(path.alias("path")).where("path IS NOT NULL").distinct().select(F.explode(F.split("path", PATH_SEP)).alias("label")).select(F.trim("label").alias("label"))
    return _none(parts.where((F.length("label") >= 3) & ~F.lower("label").isin(*NO_GROUP)).groupBy("label").agg(F.count("*").alias("n")))


def phrases(rows: DataFrame, text: Column) -> DataFrame:
    """label, n of runs of two to four words that come twice or more, with a word of 3 letters that is no stop word."""
    found = rows.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PHRASE), F.lit(1))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    content = F.exists(spaced(F.col("label")), lambda w: ~w.isin(LABEL_STOP) & (F.length(w) >= 3))
    return _none(found.where("n >= 2").where(content & (F.length("label") >= 5) & ~is_value_state(F.col("label"))))


def top_ngrams(rows: DataFrame, text: Column, most: int) -> DataFrame:
    """label, n, tfidf: of the ``4 * most`` (600 at most) commonest 1- to 3-grams the ``most`` of highest mean weight; single words count half."""
    n = rows.count()
    # Each different text is taken apart once, with its number of rows.
    kinds = rows.select(F.coalesce(text, F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("times")).withColumn("doc", F.monotonically_increasing_id())
    kinds = written(kinds, "concept-texts")
    own = tfidf.terms(kinds, "doc", F.col("text"), 1, 3, stop=LABEL_STOP)
    table = written(own.join(kinds.select("doc", "times"), "doc"), "concept-terms")
    top = table.groupBy("term").agg(F.sum(F.col("tf") * F.col("times")).alias("c"), F.sum("times").alias("df")).orderBy(F.desc("c"), "term").limit(min(600, 4 * most))
    weighed = table.join(F.broadcast(top.select("term", "df")), "term").withColumn("w", F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    means = weighed.select("term", "df", "times", (F.col("w") / norm).alias("u")).groupBy("term", "df").agg((F.sum(F.col("u") * F.col("times")) / n).alias("mean_tfidf"))
    best = means.orderBy(F.desc(F.round("mean_tfidf", 9)), "term").limit(most)
    label = F.col("term")
    fine = (F.length(label) >= 4) & label.rlike(r"\p{L}") & ~is_value_state(label)
    return best.where(fine).select(label.alias("label"), F.col("df").cast("long").alias("n"), (F.col("mean_tfidf") * F.when(label.contains(" "), 1.0).otherwise(0.5)).alias("tfidf"))


def ordered(candidates: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates, those of group paths and titles first, then by weight, frequency and label."""
    first = F.when(F.col("source") == "group_path", 0).when(F.col("source") == "description_title", 1).otherwise(2)
    return candidates.orderBy(first, F.desc(F.round("tfidf", 9)), F.desc("frequency"), "label").limit(most)


def group_counts(candidates: DataFrame, rows: DataFrame, text: Column, path: Column) -> DataFrame:
    """Candidates with cross_group_count: in how many top groups all their words (3 letters on, no stop words) stand, be it within other words.

    Candidates must be a list of bounded length: their words are looked for in
    each distinct word of a group, so texts of a group are never gathered.
    """
    own = candidates.withColumn("w", F.array_distinct(F.array_except(F.regexp_extract_all(F.lower("label"), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), words(*LABEL_STOP))))
    known = sorted({w for r in own.select("w").collect() for w in r.w})
    if not known:
        return own.drop("w").withColumn("cross_group_count", F.lit(0).cast("long"))
    top = F.lower(F.trim(top_group(path)))
    tokens = rows.select(top.alias("top"), F.explode(spaced(F.lower(F.coalesce(text, F.lit(""))))).alias("token")).where(~F.col("top").isin(*NO_GROUP[:3])).distinct()
    has = tokens.select("top", F.explode(F.filter(words(*known), lambda w: F.col("token").contains(w))).alias("word")).distinct()
    met = own.select("label", F.size("w").alias("size"), F.explode("w").alias("word")).join(has, "word").groupBy("label", "size", "top").agg(F.count("*").alias("n")).where("n = size")
    counts = met.groupBy("label").agg(F.count("*").alias("cross_group_count"))
    return own.drop("w").join(counts, "label", "left").withColumn("cross_group_count", F.coalesce("cross_group_count", F.lit(0).cast("long")))


def candidates(rows: DataFrame, row: str, text: Column, path: Column, most: int = 150) -> DataFrame:
    """Label, source, frequency, tfidf, cross_group_count of the ``most`` first concept candidates.

    Sources are titles, group paths, n-grams and phrases; of labels that differ
    in case only, the first source's smallest one stays. Group paths add to a title's frequency.
    """
    sources = [(titles(rows, text, path), "description_title", 0.95), (group_parts(rows, path), "group_path", 1.0), (top_ngrams(rows, text, most), "metadata_tfidf", None), (phrases(rows, text), "noun_phrase", 0.0)]
    every = None
    for place, (found, source, weight) in enumerate(sources):
        own = found.select("label", "n", F.lit(source).alias("source"), F.lit(place).alias("place"), F.col("tfidf") if weight is None else F.lit(weight).alias("tfidf"))
        # One row per label in any case: titles tell their highest count, group parts their sum.
        own = own.groupBy(F.lower("label").alias("key"), "source", "place").agg(F.min("label").alias("label"), (F.sum if place else F.max)("n").alias("n"), F.max("tfidf").alias("tfidf"))
        every = own if every is None else every.unionByName(own)
    first = F.min(F.struct("place", "label", "source", "tfidf", "n"))
    merged = every.groupBy("key").agg(first.alias("f"), F.sum(F.when(F.col("place") == 1, F.col("n"))).alias("paths"))
    more = F.when(F.col("f.place") == 0, F.coalesce("paths", F.lit(0))).otherwise(0)
    merged = merged.select("f.label", "f.source", (F.col("f.n") + more).alias("frequency"), "f.tfidf")
    return group_counts(written(ordered(merged, most), "concepts"), rows, text, path)


def concept_table(found: DataFrame, known: DataFrame | None = None, priority: tuple[str, ...] = ("cognitive_atlas", "wikidata"), most: int = 60) -> DataFrame:
    """E10, and with known E2, J4: label, full_text, source, frequency, tfidf, broader.

    known has (label, source, text, broader array<string>), what a lookup told of
    labels in any case; of the first ``most`` candidates each takes the text of the
    first source of ``priority``. Without known the table is local.
    """
    local = found.select("label", F.col("label").alias("full_text"), "source", "frequency", "tfidf", F.array().cast("array<string>").alias("broader"))
    if known is None:
        return local
    rank = F.array_position(words(*priority), F.col("source"))
    best = known.where((rank > 0) & (F.coalesce("text", F.lit("")) != "")).groupBy(F.lower("label").alias("key")).agg(F.min(F.struct(rank.alias("rank"), "source", "text", F.coalesce("broader", F.array().cast("array<string>")).alias("broader"))).alias("k"))
    asked = found.orderBy((F.col("source") != "group_path"), F.desc(F.round("tfidf", 9)), F.desc("frequency"), "label").limit(most).select(F.lower("label").alias("key"))
    told = asked.join(best, "key")
    full = F.when(F.col("k").isNotNull(), F.concat_ws(". ", "label", "k.text")).otherwise(F.col("full_text"))
    return local.withColumn("key", F.lower("label")).join(told, "key", "left").select("label", full.alias("full_text"), F.coalesce("k.source", "source").alias("source"), "frequency", "tfidf", F.coalesce("k.broader", "broader").alias("broader"))


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _means(vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean (of the vectors) and unit (of the vectors at length 1), by position, so that partial sums are made before the shuffle."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.withColumn("norm", norm).select(*keys, "norm", F.posexplode("vec").alias("pos", "x"))
    sums = rows.groupBy(*keys, "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0)).alias("unit"))
    both = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "mean", "unit"))).alias("v"))
    return both.select(*keys, "n", F.col("v.mean").alias("mean"), F.col("v.unit").alias("unit"))


def scored(members: DataFrame, concepts: DataFrame, most_concepts: int = 10_000) -> DataFrame:
    """Grp, cluster, label, score, fit, contrast, home of the concepts that fit each cluster.

    members has (grp, cluster, vec), concepts (label, source, vec), a list of at
    most ``most_concepts`` rows that all tasks get. fit is the mean cosine to a
    cluster's members, which is one product with the mean of their unit vectors, so
    concepts meet clusters and never members. contrast is fit less the nearest
    sibling's cosine, home three times the cosine to the own group less its mean over
    groups, both cut to 0 to 1; score = 0.30 fit + 0.35 contrast + 0.25 home + 0.10
    confidence, less 0.35 for words of links. Concepts of fit under 0.12 go, and with
    two groups or more those without home. Clusters without siblings have contrast 0; a single group home 0.34.
    """
    listed = concepts.select("label", "source", F.col("vec").cast("array<double>").alias("vec")).orderBy("label", "source").limit(most_concepts + 1).collect()
    if len(listed) > most_concepts:
        raise ValueError(f"over {most_concepts} concepts")
    if not listed:
        return members.sparkSession.createDataFrame([], "grp string, cluster long, label string, source string, score double, fit double, contrast double, home double").select(F.col("grp").cast(members.schema["grp"].dataType), F.col("cluster").cast(members.schema["cluster"].dataType), "label", "source", "score", "fit", "contrast", "home")
    sc = members.sparkSession.sparkContext
    held = sc.broadcast(_units(np.array([r.vec for r in listed])))
    grp, cluster = members.schema["grp"].dataType.simpleString(), members.schema["cluster"].dataType.simpleString()

    def cosines(*wanted: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = len(held.value)
                keys = [c for c in ("grp", "cluster") if c in batch.schema.names]
                at = np.repeat(np.arange(batch.num_rows), m)
                columns = [batch.column(k).take(pa.array(at)) for k in keys] + [pa.array(np.tile(np.arange(m), batch.num_rows))]
                for name in wanted:
                    x = np.array(batch.column(name).to_pylist(), float)
                    columns.append(pa.array(((_units(x) if name == "mean" else x) @ held.value.T).ravel()))
                yield pa.RecordBatch.from_arrays(columns, [*keys, "concept", *wanted])

        return run

    vectors = members.select("grp", "cluster", F.col("vec").cast("array<double>").alias("vec"))
    own = written(_means(vectors, "grp", "cluster").mapInArrow(cosines("mean", "unit"), f"grp {grp}, cluster {cluster}, concept long, mean double, unit double"), "concept-fits")
    homes = written(_means(vectors, "grp").mapInArrow(cosines("mean"), f"grp {grp}, concept long, mean double"), "concept-homes")
    # The two nearest clusters of a group are enough to know each one's nearest sibling.
    near = Window.partitionBy("grp", "concept").orderBy(F.desc("mean"), "cluster")
    two = own.withColumn("r", F.row_number().over(near)).where("r <= 2").groupBy("grp", "concept").agg(F.max(F.when(F.col("r") == 1, F.col("cluster"))).alias("c1"), F.max(F.when(F.col("r") == 1, F.col("mean"))).alias("m1"), F.max(F.when(F.col("r") == 2, F.col("mean"))).alias("m2"))
    several = homes.select("grp").distinct().limit(2).count() > 1
    average = homes.groupBy("concept").agg(F.avg("mean").alias("average"))
    home = homes.join(average, "concept").select("grp", "concept", (F.least(F.greatest((F.col("mean") - F.col("average")) * 3, F.lit(0.0)), F.lit(1.0)) if several else F.lit(0.34)).alias("home"))
    sibling = F.when(F.col("cluster") == F.col("c1"), F.col("m2")).otherwise(F.col("m1"))
    contrast = F.coalesce(F.least(F.greatest(F.col("unit") - sibling, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    names = members.sparkSession.createDataFrame([(i, r.label, r.source) for i, r in enumerate(listed)], "concept long, label string, source string")
    out = own.join(two, ["grp", "concept"]).join(home, ["grp", "concept"]).join(F.broadcast(names), "concept").where("unit >= 0.12").where(F.col("home") > 0)
    noise = F.when(F.col("label").rlike(LINK_WORDS), 0.35).otherwise(0.0)
    out = out.select("grp", "cluster", "label", "source", F.col("unit").alias("fit"), contrast.alias("contrast"), "home")
    return out.withColumn("score", 0.30 * F.col("fit") + 0.35 * F.col("contrast") + 0.25 * F.col("home") + 0.10 * confidence_of(F.col("source")) - noise).select("grp", "cluster", "label", "source", "score", "fit", "contrast", "home")


def phrase_contrast(rows: DataFrame, row: str, title: Column, parent: str, cluster: str, blocked: list[str] | None = None) -> DataFrame:
    """A-4: parent, cluster, phrase, inside, members, outside, siblings: in how many titles of a cluster and of its siblings a phrase stands.

    What siblings have is a parent's total less the cluster's own, so no title meets another.
    """
    return contrast_of(rows, title_phrases(title, blocked), parent, cluster)


def contrast_of(rows: DataFrame, phrases: Column, parent: str, cluster: str) -> DataFrame:
    """As phrase_contrast(), of a column of phrases."""
    keys = [F.col(parent).alias("parent"), F.col(cluster).alias("cluster")]
    own = rows.select(*keys, F.explode(F.array_distinct(phrases)).alias("phrase")).groupBy("parent", "cluster", "phrase").agg(F.count("*").alias("inside"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members"))
    totals = sizes.groupBy("parent").agg(F.sum("members").alias("total"))
    every = own.groupBy("parent", "phrase").agg(F.sum("inside").alias("every"))
    both = own.join(sizes, ["parent", "cluster"]).join(totals, "parent").join(every, ["parent", "phrase"])
    return both.select("parent", "cluster", "phrase", "inside", "members", (F.col("every") - F.col("inside")).alias("outside"), (F.col("total") - F.col("members")).alias("siblings"))


def scored_titles(counts: DataFrame) -> DataFrame:
    """parent, cluster, phrase, score of the phrases that stand in two titles or more of a cluster: how far they set it apart; longer phrases weigh more."""
    n_words = F.size(F.split("phrase", " "))
    score = F.round((F.col("inside") / F.col("members") - F.col("outside") / F.greatest("siblings", F.lit(1))) * (1 + 0.25 * (n_words - 1)), 9)
    return counts.where("inside >= 2").select("parent", "cluster", "phrase", score.alias("score")).where("score > -1")


def title_labels(counts: DataFrame) -> DataFrame:
    """L2: parent, cluster, label, score of the phrase that stands in two titles or more of a cluster and most sets it apart; ties go to the smaller one."""
    best = scored_titles(counts).groupBy("parent", "cluster").agg(F.min(F.struct((-F.col("score")).alias("less"), "phrase")).alias("b"))
    return best.select("parent", "cluster", F.initcap("b.phrase").alias("label"), (-F.col("b.less")).alias("score"))


def accepted(offers: DataFrame) -> DataFrame:
    """Parent, cluster, label: each cluster in its order takes its best label that no earlier sibling has.

    offers has (parent, cluster, ord, label, score). Each turn every cluster asks
    for its best label left and the earliest of those that ask for one keeps it; the
    others never ask for it again. That ends where going through clusters one by one
    would, and no parent is gathered. Clusters without a label left give no row.
    """
    left = cut(offers.select("parent", "cluster", "ord", "label", "score"))
    while True:
        asks = cut(left.groupBy("parent", "cluster", "ord").agg(F.min(F.struct((-F.col("score")).alias("less"), "label")).alias("b")).select("parent", "cluster", "ord", F.col("b.label").alias("label")))
        best = asks.groupBy("parent", "label").agg(F.min(F.struct("ord", "cluster")).alias("first"))
        lost = cut(asks.join(best, ["parent", "label"]).where((F.col("first.ord") != F.col("ord")) | (F.col("first.cluster") != F.col("cluster"))).select("parent", "cluster", "label"))
        if lost.isEmpty():
            return asks.select("parent", "cluster", "label")
        left = cut(left.join(lost, ["parent", "cluster", "label"], "left_anti"))


def described(text: Column) -> Column:
    """What stands before the inner colon of a text's first description-like field (``name: value | ...``); null if there is none."""
    fields = F.filter(F.split(text, r" \| "), lambda c: c.contains(":") & F.lower(F.substring_index(c, ":", 1)).rlike("descrip|def|full"))
    return F.trim(F.get(F.split(F.get(fields, F.lit(0)), ":"), F.lit(1)))


def common_prefixes(rows: DataFrame, cluster: str, text: Column, coverage: float = 0.6, times: Column | None = None) -> DataFrame:
    """Cluster, prefix, n: the longest 2 to 6 words with which descriptions begin in at least ``coverage`` of a cluster's rows that have such a front; ties go to the more frequent, then the smaller one.

    times tells for how many rows each of these stands.
    """
    times = F.lit(1) if times is None else times
    own = rows.select(F.col(cluster).alias("cluster"), spaced(described(text)).alias("w"), times.alias("times")).where(F.size("w").between(2, 6))
    needed = own.groupBy("cluster").agg(F.greatest(F.lit(1), F.floor(F.lit(coverage) * F.sum("times"))).alias("least"))
    fronts = own.select("cluster", "w", "times", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("k")).groupBy("cluster", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("prefix")).agg(F.sum("times").alias("n"))
    best = fronts.join(needed, "cluster").where(F.col("n") >= F.col("least")).groupBy("cluster").agg(F.min(F.struct((-F.col("k")).alias("k"), (-F.col("n")).alias("n"), "prefix")).alias("b"))
    return best.select("cluster", F.initcap("b.prefix").alias("prefix"), (-F.col("b.n")).alias("n"))


def preferred_terms(terms: Column, most: int, noise: list[str] | None = None, prefix: Column | None = None) -> Column:
    """The first ``most`` terms of an array in order of score, without short ones, noise and what the prefix has; a term of two words takes the place of its single words."""
    front = F.lower(F.coalesce(prefix, F.lit(""))) if prefix is not None else F.lit("")

    def step(held, t):
        low, single = F.lower(t), ~t.contains(" ")
        skip = (F.length(t) < 3) | (low.isin(noise) if noise else F.lit(False)) | front.contains(low)
        within = single & F.exists(held, lambda p: p.contains(" ") & F.lower(p).contains(low))
        kept = F.when(single, held).otherwise(F.filter(held, lambda p: p.contains(" ") | ~low.contains(F.lower(p))))
        return F.when((F.size(held) >= most) | skip | within, held).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(terms, F.array().cast("array<string>"), step)


def label_candidates(text: Column, blocked: list[str], used: list[str] | None = None, most_words: int = 3) -> Column:
    """Distinct n-grams of a text's words without parentheses, links and blocked words; those of 4 characters on that repeat no word next to itself."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"(?i)(https?://\S+|www\.\S+)", " ")
    own = F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda w: ~w.isin(blocked))
    return F.filter(F.array_distinct(ngrams(own, 1, most_words)), lambda c: (F.length(c) >= 4) & (~c.isin(used) if used else F.lit(True)) & ~c.rlike(r"\b(\w+)\s+\1\b"))
