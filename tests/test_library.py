"""Operators of the library on small fixtures."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from thicket.functions import codes, text
from thicket.operators import cluster, evaluate, facets, profile, slots, tree, viz, ward
from thicket.sources import loaders, sinks

def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert [one(spark, text.light_stem, w) for w in ("latencies", "latency", "errors", "error", "completion", "completed")] == ["latenc", "latency", "error", "error", "completion", "complet"]
    assert one(spark, text.concept_title, "KEY: SWM Between errors: The number of times a box is visited again") == "SWM Between errors"
    assert one(spark, text.concept_title, "only a title") == "only a title" and one(spark, text.concept_title, "a b c d e f g h i j k") == ""
    assert one(spark, text.attribute_name, "KEY: Name here: rest") == "Name here" and one(spark, text.attribute_name, "DMS") == "DMS"
    assert one(spark, text.without_markers, "KEY: Note: real text: more") == "real text: more"
    assert one(spark, text.title_case, "a-b 2nd o'neil") == "A-B 2Nd O'Neil" and one(spark, text.singular, "glass") == "glass" and one(spark, text.singular, "errors") == "error"
    assert one(spark, text.json_in, '<think>no {x}</think> ```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, text.json_in, "none") is None
    assert one(spark, lambda x: text.ngrams(F.split(x, " "), 1, 2), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.is_boilerplate, "the number of trials") and not one(spark, text.is_meaningful, "the delay") and one(spark, text.is_meaningful, "delay time")
    assert one(spark, text.without_urls, "see www.a.org/x now").split() == ["see", "now"] and one(spark, lambda x: text.concept_and_body(x)[0], "note: A b: long text") == "A b"
    assert one(spark, lambda x: F.array_join(text.without_phrase(F.split(x, " "), F.array(F.lit("b"), F.lit("c"))), " "), "a b c d") == "a d"


STATISTICS = {"Total": "The total number of {}, over all trials", "Mean": "The mean of {}, in milliseconds", "Median": "The median of {}, in milliseconds", "Standard Deviation": "The standard deviation of {}"}


def dictionary():
    """Three tasks of one variant each, four statistics of errors in four conditions, and two loose rows."""
    rows = []
    for task in ("ABC", "DEF", "GHI"):
        for letter, (statistic, said) in zip("TMDS", STATISTICS.items()):
            for n in (2, 4, 6, 12):
                rows.append((task, f"{task} Recommended Standard", f"{task}{letter}E{n}", f"{task} {statistic} Errors ({n} boxes): {said.format('errors')} where {n} boxes were shown to the subject in the memory test", str(len(rows) % 3)))
    return [*rows, ("JKL", "JKL Clinical", "JKLX", "how the subject felt about attention, and why", "0"), ("JKL", "JKL Clinical", "JKLY", "whether the subject came back", "1")]


def test_sample_dictionary(spark, tmp_path):
    rows, columns = dictionary(), ["Task", "Variant", "name", "description", "Decimal Places"]
    (tmp_path / "d.csv").write_text("\n".join([",".join(columns), *[",".join(f'"{c}"' for c in r) for r in rows]]))
    df = loaders.read_csv(spark, f"file://{tmp_path}/d.csv")
    assert df.count() == len(rows) == 50 and df.columns == columns
    found = profile.roles(df)
    assert (found.leaf, found.group, found.text, found.meta) == (["name"], ["Task", "Variant"], ["description"], ["Decimal Places"])
    own = profile.canonical(df.withColumn("_row", F.monotonically_increasing_id()), found, "_row").cache()
    first = own.orderBy("row").first()
    assert first.label == "ABCTE2" and first.leaf_id == "ABC > ABC Recommended Standard.ABCTE2" and first.group_path == "ABC > ABC Recommended Standard"
    assert first.text.startswith("Task: ABC | Variant: ABC Recommended Standard | name: ABCTE2 | description: ABC Total Errors") and first.text.endswith("| Decimal Places: 0")
    assert {r.top: r["count"] for r in own.groupBy(profile.top_group(F.col("group_path")).alias("top")).count().collect()} == {"ABC": 16, "DEF": 16, "GHI": 16, "JKL": 2}
    assert {r.d for r in own.select(codes.condition_digit(F.col("label"), F.col("semantic_text")).alias("d")).collect()} == {None, "2", "4", "6", "12"}
    assert codes.families(own, "row", "label").where("family <> ''").select("family").distinct().count() >= 12
    stats = {r.s: r["count"] for r in own.groupBy(facets.statistic(F.col("semantic_text")).alias("s")).count().collect()}
    assert stats == {"Total": 12, "Mean": 12, "Median": 12, "Standard Deviation": 12, "Other": 2}
    assert {r.s: r["count"] for r in own.groupBy(facets.outcome(F.col("semantic_text")).alias("s")).count().collect()} == {"Errors": 48, "Other": 2}
    assert profile.domain(own, "text") == "cognitive"


def test_loaders(spark, tmp_path):
    def put(name, content, encoding="utf-8"):
        (tmp_path / name).write_bytes(content.encode(encoding))
        return f"file://{tmp_path}/{name}"

    body = [("a", "b", "c"), ("1", "x", "u"), ("2", "y", "v")]
    for name, sep in (("semi.csv", ";"), ("tab.tsv", "\t"), ("pipe.txt", "|"), ("comma.csv", ",")):
        df = loaders.load_any(spark, put(name, "\n".join(sep.join(r) for r in body)))
        assert df.columns == ["a", "b", "c"] and df.count() == 2
    packed = loaders.load_any(spark, put("packed.csv", 'Task,name,description\n"DMS,A1,first";\n"SWM,A2,second";\n"PAL,A3,third";\n'))
    assert packed.columns == ["Task", "name", "description"] and sorted(r.name for r in packed.collect()) == ["A1", "A2", "A3"]
    assert loaders.load_any(spark, put("r.json", '[{"name": "n", "meta": {"unit": "ms"}}]')).columns == ["meta.unit", "name"]
    assert loaders.load_any(spark, put("w.json", '{"version": 1, "rows": [{"a": "1"}, {"a": "2"}]}')).count() == 2
    table = loaders.load_any(spark, put("t.md", "| a | b |\n|:---:|---|\n| 1 | 2 |\n| 3 |\n"))
    assert sorted(tuple(r) for r in table.collect()) == [("1", "2"), ("3", "")]
    raw = spark.range(30).select(*[(F.col("id") % (i + 1)).alias(f"v{i}") for i in range(25)])
    assert loaders.probably_raw(raw) and loaders.raw_to_dictionary(raw).count() == 25
    assert loaders.merged([("x", raw.select("v0")), ("y", raw.select("v1"))]).count() == 60
    with pytest.raises(NotImplementedError):
        loaders.load_any(spark, "x.xlsx")


def make(spark, nodes, links):
    kinds = {"r": "root", "g": "aggregation", "l": "attribute"}
    return tree.Tree(spark.createDataFrame([(i, n, kinds[k]) for i, n, k in nodes], "id long, name string, type string"), tree.ordered(spark.createDataFrame(links, "parent long, child long")))


def names(t, kind="aggregation"):
    return sorted(r.name for r in t.nodes.where(F.col("type") == kind).collect())


def test_trees(spark, tmp_path):
    t = make(spark, [(0, "All", "r"), (1, "A", "g"), (2, "B", "g"), (3, "a1", "l"), (4, "a2", "l"), (5, "b1", "l")], [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)])
    s = tree.structural_stats(t).first()
    assert (s.aggregations, s.max_depth, s.avg_branching, s.singleton_pct, s.leaves) == (2, 2, 1.5, 50.0, 3)
    sinks.write_tree(t, f"file://{tmp_path}/tree")
    back = loaders.read_tree(spark, f"file://{tmp_path}/tree")
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, t.nodes.collect())) and sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, t.edges.collect()))
    (tmp_path / "list.json").write_text('[\n {"id": 0, "name": "All", "type": "root", "related": [1]},\n {"id": 1, "name": "A", "type": "attribute", "related": []}\n]')
    assert loaders.read_tree(spark, f"file://{tmp_path}/list.json", lines=False).edges.count() == 1
    empty = make(spark, [(0, "All", "r"), (1, "A", "g"), (2, "B", "g"), (3, "a", "l")], [(0, 1), (0, 2), (1, 3)])
    assert names(tree.pruned(empty)) == ["A"]
    dag = make(spark, [(0, "All", "r"), (1, "A", "g"), (2, "A1", "g"), (3, "x", "l")], [(0, 1), (1, 2), (1, 3), (2, 3)])
    assert tree.single_parent(dag).edges.where("child = 3").first().parent == 2
    chain = make(spark, [(0, "All", "r"), (1, "A", "g"), (2, "B", "g"), (3, "x", "l"), (4, "y", "l")], [(0, 1), (1, 2), (2, 3), (2, 4)])
    assert names(tree.compressed(chain)) == ["A / B"]
    twice = make(spark, [(0, "All", "r"), (1, "T", "g"), (2, "Errors", "g"), (3, "X", "g"), (4, "errors", "g"), (5, "l1", "l"), (6, "l2", "l")], [(0, 1), (1, 2), (1, 3), (3, 4), (2, 5), (4, 6)])
    fixed = tree.merged_duplicates(twice)
    assert names(fixed) == ["Errors", "T", "X"] and fixed.edges.where("parent = 2").count() == 2
    shared = make(spark, [(0, "All", "r"), (1, "T", "g"), (2, "Total Errors X", "g"), (3, "Total Errors Y", "g"), (4, "Total Errors Z", "g"), (5, "l", "l")], [(0, 1), (1, 2), (1, 3), (1, 4), (2, 5)])
    assert names(tree.factored_prefixes(shared)) == ["T", "Total Errors", "X", "Y", "Z"]
    noise = make(spark, [(0, "All", "r"), (1, "MOT", "g"), (2, "And", "g"), (3, "2", "g"), (4, "l", "l")], [(0, 1), (1, 2), (2, 3), (3, 4)])
    plain = tree.without_noise(noise, F.lower("name").isin("and", "2"))
    assert names(plain) == ["MOT"] and plain.edges.where("child = 4").first().parent == 1
    strip = make(spark, [(0, "All", "r"), (1, "DMS", "g"), (2, "DMS Errors", "g"), (3, "DMS Errors Total", "g")], [(0, 1), (1, 2), (2, 3)])
    assert names(tree.stripped_prefixes(strip)) == ["DMS", "DMS Errors Total", "Errors"]
    with pytest.raises(ValueError):
        tree.moved(t, 0, 3)
    with pytest.raises(ValueError):
        tree.closure(spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long").withColumn("ord", F.lit(0)), most_depth=5)
    assert tree.moved(t, 5, 1).edges.where("parent = 1").count() == 3 and names(tree.deleted(t, 1)) == ["B"] and names(tree.added(t, 0, "C")) == ["A", "B", "C"]
    spots = {r.id: (r.x, r.y) for r in viz.layout(t).collect()}
    assert spots[3] == (6, 0.0) and spots[1] == (3, 0.9) and spots[5] == (6, 3.6)


def test_metrics(spark):
    same = spark.createDataFrame([(f"l{i}", ["A", f"a{i % 3}"]) for i in range(12)], "leaf string, path array<string>")
    other = spark.createDataFrame([(f"m{i}", ["A"]) for i in range(3)], "leaf string, path array<string>")
    assert evaluate.edge_f1(same, same).first().edge_f1 == evaluate.ancestor_f1(same, same).first().ancestor_f1 == evaluate.set_overlap(same, same).first().overlap_f1 == 1.0
    assert evaluate.set_overlap(same, other).first().overlap_f1 == 0.0 and evaluate.refinement(same, same).first().wrong_merge == 0
    apart = evaluate.edge_f1(same, other).first()
    assert apart.edge_f1 == 1.0 and apart.n_matched_leaves == 0
    deeper = spark.createDataFrame([(f"l{i}", ["A", f"a{i % 3}", f"b{i % 6}"]) for i in range(12)] + [("only", ["A"]), ("none", [])], "leaf string, path array<string>")
    finer = evaluate.refinement(deeper, same).first()
    assert finer.refinement_rate > 0 and finer.missed == 0 and finer.wrong_merge == 0 and finer.n_matched_leaves == 12
    table = evaluate.contingency(spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int"), "a", "b")
    assert evaluate.purity(table).first()[0] == evaluate.ari(table).first()[0] == evaluate.nmi(table).first()[0] == evaluate.ami(table).first()[0] == 1.0
    many = evaluate.contingency(spark.createDataFrame([(i % 4, i % 3 if i % 5 else 7) for i in range(60)], "a int, b int"), "a", "b").cache()
    whole, stride = evaluate.ami(many).first()[0], evaluate.STRIDE
    evaluate.STRIDE = 4
    try:
        assert evaluate.ami(many).first()[0] == whole and whole < 0.5
    finally:
        evaluate.STRIDE = stride
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = evaluate.coherence(spark.createDataFrame([(1, [float(c) for c in v]) for v in x], "g int, v array<double>"), "g", "v").first().coherence
    assert abs(got - (u @ u.T)[np.triu_indices(20, 1)].mean()) < 1e-6


def test_clustering():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.1, (10, 3)) for m in (0, 5, 10)])
    want = np.repeat([0, 1, 2], 10)
    assert (cluster.best_ward(x, 2, 6) == want).all() and (cluster.cut_at(cluster.agglomerate(cluster.distances(x), "average"), 30, 3) == want).all()
    assert len(np.unique(cluster.diagonal_mixture(x, 5))) >= 3 and cluster.good_split(want) and not cluster.good_split(np.r_[np.zeros(29, int), 1])
    labels, centres = cluster.kmeans(x, 3)
    assert all(len(set(labels[want == c])) == 1 for c in range(3)) and len(set(labels)) == 3 and sorted(np.round(centres[:, 0])) == [0, 5, 10]
    found = cluster.aspect_clusters(np.tile(x, (2, 1)), 6)[0]
    assert len(set(found)) == 3 and all(len(set(found[np.tile(want, 2) == c])) == 1 for c in range(3))
    paths = cluster.ward_paths(x, max_depth=2, min_size=6)
    assert len({p[0] for p in paths}) >= 3
    with pytest.raises(ValueError):
        cluster.agglomerate(np.zeros((cluster.MOST_MEMBERS + 1,) * 2))


def test_ward_of_large_nodes(spark):
    rng = np.random.default_rng(6)
    # Six far groups of four near ones each; the label has more vectors than the bound.
    tops = np.linalg.qr(rng.normal(size=(12, 12)))[0][:6]
    x = np.concatenate([t + 0.2 * rng.normal(size=12) / 3 + rng.normal(0, 0.01, (10, 12)) for t in np.repeat(tops, 4, axis=0)])
    top = np.repeat(np.arange(6), 40)
    rows = spark.createDataFrame([(i, 1, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, 2, [float(c) for c in v]) for i, v in enumerate(x[:50])], "id long, g int, v array<double>")
    found = {r.id: r for r in ward.paths(rows, "id", "g", "v", bound=100).collect()}
    assert len(found) == 290 and {r.path[0] for r in found.values()} == {0}
    first = np.array([found[i].path[1] for i in range(240)])
    assert len({*zip(first.tolist(), top.tolist())}) == len({*first.tolist()}) == 6 and first[0] == 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [found[1000 + i].path for i in range(50)] == [[0, *p] for p in cluster.ward_paths(u[:50])]
    for c in range(6):
        own = np.flatnonzero(first == c)
        assert [found[i].path[2:] for i in own] == [list(p) for p in cluster.ward_paths(u[own], depth=1)]
    deep = ward.paths(rows, "id", "g", "v", bound=20).collect()
    assert len(deep) == 290 and all(len(r.path) <= 4 for r in deep)


def test_slots(spark):
    texts = [f"{a} {b} {c}" for a in ("mean", "median") for b in ("latency", "errors") for c in ("early", "late")]
    rows = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "row long, grp string, t string")
    own = slots.phrases(rows, "grp", "row", F.col("t"))
    assert own.count() > 0
    found = slots.slots_of({"mean": 4, "median": 4, "latency": 4, "errors": 4}, {("errors", "mean"): 0.5, ("errors", "median"): 0.5, ("latency", "mean"): 0.5, ("latency", "median"): 0.5})
    assert [sorted(s) for s in found] == [["errors", "latency"], ["mean", "median"]]


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() == 1
    known, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(known) and len(known) > 40


def test_queries_match_their_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from thicket.plans import catalog

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def plain(rows, columns):
        key = lambda v: round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted(str([key(r[c]) for c in sorted(columns)]) for r in rows)

    for name in catalog.ORACLES:
        df = catalog.QUERIES[name](spark, sf)
        rel = con.execute(catalog.ORACLES[name])
        cols = [d[0] for d in rel.description]
        assert plain([dict(zip(cols, r)) for r in rel.fetchall()], cols) == plain([r.asDict() for r in df.collect()], df.columns), name


def test_code_expansions(spark):
    rows = spark.createDataFrame([(0, "RTXA", "Reaction Time (RT) of a trial", "Speed > x"), (1, "RTXB", "the RT again", "Speed > y"), (2, "ZZZ", "plain", "Other")], "row long, label string, text string, grp string")
    found = {r.segment: (r.expansion, r.step) for r in codes.expansions(rows, "row", "label", "text", "grp").collect()}
    assert found["RT"] == ("Reaction Time", 1) and found["RTX"] == ("Speed", 3)
    assert one(spark, lambda x: codes.covered(x, F.lit("Reaction Time")), "the reaction time here") and not one(spark, lambda x: codes.covered(x, F.lit("Reaction Time")), "nothing")
    assert one(spark, codes.is_acronym, "DMS") and not one(spark, codes.is_acronym, "Dms")


def test_traco_is_the_mean_of_cosines(spark):
    rng = np.random.default_rng(2)
    t = make(spark, [(0, "All", "r"), (1, "A", "g"), (2, "a", "l"), (3, "b", "l"), (4, "c", "l")], [(0, 1), (1, 2), (1, 3), (1, 4)])
    x = np.abs(rng.normal(size=(5, 4)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(1, 5) for j in range(4)], "doc long, term string, tfidf double")
    got = evaluate.traco(t, table).first()
    pairs = [1 - x[i] @ x[j] for i in (2, 3, 4) for j in (2, 3, 4) if i < j]
    assert abs(got.pc_coherence - np.mean([x[1] @ x[i] for i in (2, 3, 4)])) < 1e-4 and abs(got.sibling_diversity - np.mean(pairs)) < 1e-4


def test_bundle_and_sinks(spark, tmp_path):
    t = make(spark, [(0, "All", "r"), (1, "A", "g"), (2, "A x", "g"), (3, "l1", "l"), (4, "l2", "l"), (5, "l3", "l"), (6, "A y", "g")], [(0, 1), (1, 2), (1, 6), (2, 3), (2, 4), (0, 5)])
    rows = spark.createDataFrame([("l1", "g"), ("l2", "g"), ("l3", "h"), ("gone", "h")], "leaf string, group string")
    gold = spark.createDataFrame([("l1", ["p", "q"]), ("l2", ["p", "q"]), ("l3", ["z"])], "leaf string, path array<string>")
    got = evaluate.bundle(t, rows, gold=gold).first()
    assert got.purity == got.ari == got.edge_f1 == got.ancestor_f1 == got.overlap_f1 == 1.0 and got.n_matched_leaves == 3 and got.leaves == 3
    assert got.wrong_merge == got.missed == 0 and got.concept_label_pct is not None and got.redundancy_pct == 0.0
    assert {r.leaf: r.cluster for r in evaluate.top_clusters(t).collect()} == {3: 1, 4: 1, 5: 5}
    names = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.6), (2, "x", 0.8), (6, "a", 0.6), (6, "y", 0.8)], "doc long, term string, tfidf double")
    div = evaluate.label_diversity(t, names).first()
    assert (div.parent_child, div.sibling_diversity, div.n_aggregations, div.n_singletons) == (0.6, round(1 - 2 * 0.36 / 4, 4), 3, 0)
    listed = json.loads(sinks.tree_list(t).first().json)
    assert [n["id"] for n in listed] == list(range(7)) and listed[1]["related"] == [2, 6] and listed[3]["related"] == []
    full = json.loads(sinks.tree_list(tree.described(tree.Tree(t.nodes.withColumn("leaf_id", F.concat(F.lit("g."), "name")).withColumn("text", F.lit("said")), t.edges))).first().json)
    assert full[3] == {"id": 3, "name": "l1", "type": "attribute", "dtype": "determine", "is_shown": True, "desc": "said", "metadata": {"leaf_id": "g.l1"}, "related": []} and full[1]["desc"] == "Group: A" and "metadata" not in full[1] and full[0]["desc"] == "Root node"
    both = json.loads(sinks.facet_list({"Task": t, 'odd "name"': t}).first().json)
    assert both["Task"] == both['odd "name"'] == listed
    (tmp_path / "o" / "d").mkdir(parents=True)
    (tmp_path / "o" / "a.txt").write_text("one")
    (tmp_path / "o" / "d" / "b.txt").write_text("two")
    files = zipfile.ZipFile(io.BytesIO(sinks.zipped(spark, f"{tmp_path}/o")))
    assert {n: files.read(n) for n in files.namelist()} == {"a.txt": b"one", "d/b.txt": b"two"}
    assert one(spark, sinks.safe_name, "a b/c-é.csv") == "a_b_c-é.csv"


def test_terms_are_dealt_by_document_once(spark):
    from thicket.operators import tfidf

    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3} only{i}") for i in range(9)] + [(0, "alpha again")], "doc_id long, text string")
    table = tfidf.tfidf(tfidf.terms(docs, "doc_id", F.col("text")), 10)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    rows = {(r.doc, r.term): r.tfidf for r in table.collect()}
    assert len(rows) == 37 and abs(sum(x * x for (d, _), x in rows.items() if d == 0) - 1) < 1e-12


def test_rows_of_the_same_words_meet_groups_as_one(spark, monkeypatch):
    from thicket.operators import groups

    seen, real = [], groups.written
    monkeypatch.setattr(groups, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    rows = spark.createDataFrame([(i, f"red ring{'abc'[i % 3]}", f"g{i % 4}", "f" if i % 2 else None) for i in range(40)], "row long, name string, grp string, family string")
    found = groups.conflicts(rows, "row", F.col("name"), "grp", "family")
    assert found.count() == 40 and found.where("decision IS NULL").count() == 0
    assert seen[0].count() == 6
