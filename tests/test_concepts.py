import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import text
from thicket.operators import concepts

NEW = "title_candidates_part phrase_candidates_part concept_candidates_part title_phrase_counts_part title_labels_part common_prefixes_part".split()


@pytest.mark.parametrize("name", NEW)
def test_queries_match_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from thicket.plans import catalog

    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    rel = con.execute(catalog.ORACLES[name])
    cols = sorted(d[0] for d in rel.description)
    order = [d[0] for d in rel.description]
    key = lambda v: round(float(v), 5) if not isinstance(v, str) else v
    want = sorted([str([key(dict(zip(order, r))[c]) for c in cols]) for r in rel.fetchall()])
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == cols and len(want) > 0
    assert sorted(str([key(r[c]) for c in cols]) for r in df.collect()) == want


def test_titles(spark):
    said = ["DMS Reaction Time: time from stimulus to response", "PAL reaction Time: time from stimulus to response", "Reaction Time | of the trial, in milliseconds", "no colon here", "Not Done: whether it was done at all", "Not Done: whether it was done at all", "raw_name: a column of the table as it is", "raw_name: a column of the table as it is", None, ""]
    rows = spark.createDataFrame([(i, t, "DMS > a" if i % 2 else "Pal > b") for i, t in enumerate(said)], "row long, t string, p string")
    assert {(r.label, r.n) for r in concepts.titles(rows, F.col("t"), F.col("p")).collect()} == {("Reaction Time", 2)}
    empty = concepts.candidates(rows.where("row < 0"), "row", F.col("t"), F.col("p"))
    assert empty.count() == 0


def test_concept_table(spark):
    found = spark.createDataFrame([("Memory", "group_path", 3, 1.0), ("Latency", "noun_phrase", 2, 0.0), ("Rare", "noun_phrase", 1, 0.0)], "label string, source string, frequency long, tfidf double")
    known = spark.createDataFrame([("memory", "wikidata", "a faculty", ["mind"]), ("MEMORY", "cognitive_atlas", "a concept", None), ("latency", "wikidata", "", None), ("rare", "wikidata", "seldom", None)], "label string, source string, text string, broader array<string>")
    assert {r.full_text for r in concepts.concept_table(found).collect()} == {"Memory", "Latency", "Rare"}
    got = {r.label: r for r in concepts.concept_table(found, known, most=2).collect()}
    assert (got["Memory"].full_text, got["Memory"].source) == ("Memory. a concept", "cognitive_atlas")
    assert got["Latency"].full_text == "Latency" and got["Rare"].full_text == "Rare"  # no text; not among the first two


def test_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    members = [(f"g{g}", c, rng.normal(size=6) + 2 * np.eye(6)[(g + c) % 6]) for g in range(3) for c in range(1 + g) for _ in range(5)]
    listed = [("Total Errors", "group_path", 2 * np.eye(6)[0]), ("wiki link", "wikidata", np.eye(6)[1] + 0.1), ("Latency", "other", rng.normal(size=6))]
    rows = spark.createDataFrame([(g, c, v.tolist()) for g, c, v in members], "grp string, cluster long, vec array<double>")
    names = spark.createDataFrame([(a, b, v.tolist()) for a, b, v in listed], "label string, source string, vec array<double>")
    unit = lambda v: v / np.linalg.norm(v)
    clusters = {k: np.array([v for g, c, v in members if (g, c) == k]) for k in {(g, c) for g, c, _ in members}}
    centres = {g: np.mean([v for h, _, v in members if h == g], axis=0) for g in {g for g, _, _ in members}}
    want = {}
    for (g, c), own in clusters.items():
        for label, source, v in listed:
            fit = np.mean([unit(v) @ unit(x) for x in own])
            siblings = [unit(v) @ unit(x.mean(axis=0)) for (h, d), x in clusters.items() if h == g and d != c]
            contrast = np.clip(fit - max(siblings), 0, 1) if siblings else 0.0
            home = np.clip(3 * (unit(v) @ unit(centres[g]) - np.mean([unit(v) @ unit(x) for x in centres.values()])), 0, 1)
            if fit >= 0.12 and home > 0:
                want[g, c, label] = 0.30 * fit + 0.35 * contrast + 0.25 * home + 0.10 * concepts.SOURCE_CONFIDENCE.get(source, 0.55) - (0.35 if label == "wiki link" else 0)
    got = {(r.grp, r.cluster, r.label): r.score for r in concepts.scored(rows, names).collect()}
    assert got.keys() == want.keys() and len(want) > 3 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        concepts.scored(rows, names, most_concepts=2)


def test_accepted_equals_going_one_by_one(spark):
    rng = np.random.default_rng(5)
    offers = [(p, c, c, f"l{x}", float(s)) for p in "ab" for c in range(12) for x, s in zip(rng.permutation(15)[:7], rng.integers(0, 4, 7))]
    want = set()
    for p in "ab":
        used = set()
        for c in range(12):
            own = sorted((-o[4], o[3]) for o in offers if o[:2] == (p, c) and o[3] not in used)
            if own:
                used.add(own[0][1])
                want.add((p, c, own[0][1]))
    table = spark.createDataFrame(offers, "parent string, cluster long, ord long, label string, score double")
    assert {tuple(r) for r in concepts.accepted(table).collect()} == want


def test_columns(spark):
    def of(column):
        return spark.range(1).select(column).first()[0]

    assert of(text.raw_title(F.lit("DMS: Errors (total): the number of errors made"))) == "Errors (total)" and of(text.raw_title(F.lit(" plain "))) == "plain"
    terms = F.array(*[F.lit(t) for t in ("total", "errors", "ab", "total errors", "errors", "latency", "page")])
    assert of(concepts.preferred_terms(terms, 5, ["page"])) == ["total errors", "latency"]
    assert of(concepts.preferred_terms(terms, 1)) == ["total"] and of(concepts.preferred_terms(terms, 5, prefix=F.lit("Total Errors of"))) == ["latency", "page"]
    assert of(concepts.label_candidates(F.lit("Total total errors (SD) www.x.org of it"), ["of", "it"], ["errors"])) == ["total", "total errors"]
    assert of(concepts.described(F.lit("name: x | Full text: Reaction Time: in ms | description: y"))) == "Reaction Time"
    assert of(concepts.is_value_state(F.lit("not done"))) and not of(concepts.is_value_state(F.lit("Reaction"))) and not of(concepts.is_value_state(F.lit("the of")))
    assert of(concepts.confidence_of(F.lit("wordnet"))) == 0.83 and of(concepts.confidence_of(F.lit("x"))) == 0.55


def test_rows_of_one_text_are_taken_apart_once(spark, monkeypatch):
    said = ["memory span of digits", "reaction time of hands", "memory span task"]
    rows = spark.createDataFrame([(i, said[i % 3]) for i in range(31)], "row long, t string")
    seen, terms = [], concepts.tfidf.terms
    monkeypatch.setattr(concepts.tfidf, "terms", lambda docs, *a, **b: seen.append(docs.count()) or terms(docs, *a, **b))
    got = {(r.label, r.n, round(r.tfidf, 9)) for r in concepts.candidates(rows, "row", F.col("t"), F.lit("a"), 20).where("source = 'metadata_tfidf'").select("label", F.col("frequency").alias("n"), "tfidf").collect()}
    assert seen == [3]
    table = terms(rows, "row", F.col("t"), 1, 3, stop=concepts.LABEL_STOP)
    plain = {r.term: (r.df, r.mean_tfidf) for r in concepts.tfidf.top_terms(concepts.tfidf.tfidf(table, 31, 80), 31, 20).collect()}
    assert got and all((n, round(w, 9)) == (plain[t][0], round(plain[t][1] * (1 if " " in t else 0.5), 9)) for t, n, w in got)
