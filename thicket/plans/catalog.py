"""All queries on the driver's tables, by name, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import codes, text
from thicket.functions.text import name_tokens
from thicket.operators import build, concepts, evaluate, facets, groups, profile, roles, slots, tfidf, tree, viz, ward
from thicket.sources import sinks
from thicket.storage import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- canonical rows, profiles, roles

PART_ROLES = profile.Roles(leaf=["p_partkey"], group=["p_type", "p_brand"], text=["p_name"], meta=["p_size"])
PART_CANONICAL = """
SELECT (p_partkey - 1)::BIGINT AS row, p_partkey::VARCHAR AS label, p_type || ' > ' || p_brand || '.' || p_partkey AS leaf_id, p_type || ' > ' || p_brand AS group_path,
    'p_type: ' || p_type || ' | p_brand: ' || p_brand || ' | p_partkey: ' || p_partkey || ' | p_name: ' || p_name || ' | p_size: ' || p_size AS text, trim(p_name) AS semantic_text, p_type AS top
FROM part
"""


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.canonical(table(spark, sf_dir, "part").withColumn("row", F.col("p_partkey") - 1), PART_ROLES, "row")


@query(PART_CANONICAL)
def canonical_part(spark, sf_dir):
    return part_rows(spark, sf_dir).select("row", "label", "leaf_id", "group_path", "text", "semantic_text", profile.top_group(F.col("group_path")).alias("top"))


@query(f"""
WITH c AS (SELECT 'p_name' AS "column", count(p_name) AS f, count(DISTINCT p_name) AS u, avg(length(p_name)) AS l, count(*) AS n FROM part
    UNION ALL SELECT 'p_brand', count(p_brand), count(DISTINCT p_brand), avg(length(p_brand)), count(*) FROM part
    UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT p_type), avg(length(p_type)), count(*) FROM part
    UNION ALL SELECT 'p_size', count(p_size), count(DISTINCT p_size), avg(length(p_size::VARCHAR)), count(*) FROM part
    UNION ALL SELECT 'p_partkey', count(p_partkey), count(DISTINCT p_partkey), avg(length(p_partkey::VARCHAR)), count(*) FROM part)
SELECT "column", round(f / n, 3) AS non_null, u AS unique_values, round(u / n, 3) AS unique_ratio, round(l, 1) AS avg_length,
    (CASE "column" WHEN 'p_name' THEN 4 ELSE 0 END + CASE WHEN u / n BETWEEN 0.5 AND 1 THEN 3 ELSE 0 END + CASE WHEN l < 80 THEN 1 ELSE 0 END)::INT AS leaf_score,
    (CASE WHEN u > 1 AND u < least(0.5 * n, 80) THEN 3 ELSE 0 END + CASE WHEN l < 60 THEN 1 ELSE 0 END)::INT AS group_score,
    (CASE WHEN l > 50 THEN 4 ELSE 0 END + CASE WHEN f / n > 0.5 THEN 1 ELSE 0 END)::INT AS text_score,
    (CASE "column" WHEN 'p_type' THEN 4 ELSE 0 END + CASE WHEN u > 1 AND u < least(0.8 * n, 100) THEN 2 ELSE 0 END)::INT AS metadata_score
FROM c
""")
def profile_columns_part(spark, sf_dir):
    columns = ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]
    return profile.profile(table(spark, sf_dir, "part").select(*columns)).drop("ord")


@query("SELECT * FROM (VALUES ('leaf', 'p_name', 0), ('group', 'p_brand', 0), ('group', 'p_size', 1), ('text', 'p_name', 0), ('meta', 'p_type', 0)) t(role, \"column\", ord)")
def role_pick_part(spark, sf_dir):
    found = profile.roles(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size", "p_partkey"))
    rows = [(role, c, i) for role, own in (("leaf", found.leaf), ("group", found.group), ("text", found.text), ("meta", found.meta)) for i, c in enumerate(own)]
    return spark.createDataFrame(rows, "role string, column string, ord int")


@query("""
SELECT p_partkey AS row, CASE WHEN k = 1 THEN p_name ELSE p_name || '__' || k END AS leaf_id
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
""")
def dup_leaf_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("leaf_id"))
    return profile.deduplicated(rows, "leaf_id", "row").select("row", "leaf_id")


_DOMAIN_VALUES = ", ".join(f"('{d}', '{s}')" for d, own in profile.DOMAIN_SIGNALS.items() for s in own)


@query(f"""
SELECT domain, count(*) FILTER (WHERE hit)::INT AS score FROM (
    SELECT v.domain, v.sig, bool_or(contains(lower(d.text), v.sig)) AS hit FROM (VALUES {_DOMAIN_VALUES}) v(domain, sig), documents d GROUP BY ALL) GROUP BY domain
""")
def domain_signals(spark, sf_dir):
    return profile.domain_scores(table(spark, sf_dir, "documents"), "text").select("domain", F.col("score").cast("int").alias("score"))


# --- trees

PART_NODES = """
WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)), m AS (SELECT count(*) AS k FROM t),
n AS (SELECT 0::BIGINT AS id, 'type' AS name, 'root' AS type UNION ALL SELECT id, p_type, 'aggregation' FROM t
    UNION ALL SELECT k + row_number() OVER (ORDER BY p_partkey), p_partkey::VARCHAR, 'attribute' FROM part, m),
e AS (SELECT 0::BIGINT AS parent, id AS child FROM t UNION ALL SELECT t.id, k + row_number() OVER (ORDER BY p_partkey) FROM part JOIN t USING (p_type), m)
"""


def part_tree(spark, sf_dir) -> tree.Tree:
    return facets.facet_tree(part_rows(spark, sf_dir), profile.top_group(F.col("group_path")), "type")


@query(PART_NODES + "SELECT n.id, n.name, n.type, e.parent FROM n LEFT JOIN e ON n.id = e.child")
def facet_tree_part(spark, sf_dir):
    t = part_tree(spark, sf_dir)
    return t.nodes.join(t.edges.select(F.col("child").alias("id"), "parent"), "id", "left").select("id", "name", "type", "parent")


@query(PART_NODES + "SELECT n.id, count(l.child)::BIGINT AS leaves FROM n JOIN (SELECT e.parent AS id, e.child FROM e WHERE e.parent <> 0 UNION ALL SELECT 0, e.child FROM e WHERE e.parent <> 0) l USING (id) GROUP BY n.id")
def tree_leaf_counts_part(spark, sf_dir):
    return tree.leaf_counts(part_tree(spark, sf_dir))


@query("""
WITH f AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
SELECT count(*)::BIGINT AS aggregations, round(avg(n), 4) AS avg_branching, round(100.0 * avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS singleton_pct, 2 AS max_depth, 2.0::DOUBLE AS avg_leaf_depth, sum(n)::BIGINT AS leaves FROM f
""")
def structural_stats_part(spark, sf_dir):
    return tree.structural_stats(part_tree(spark, sf_dir))


def geo_tree(spark, sf_dir) -> tree.Tree:
    """Regions, nations and customers; ids are keys, moved apart by fixed steps."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    node = lambda df, key, step, name, kind: df.select((F.col(key) + step).cast("long").alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
    nodes = spark.range(1).select("id", F.lit("World").alias("name"), F.lit("root").alias("type")).union(node(region, "r_regionkey", 1, "r_name", "aggregation")).union(node(nation, "n_nationkey", 100, "n_name", "aggregation")).union(node(customer, "c_custkey", 1000, "c_name", "attribute"))
    link = lambda df, up, a, down, b: df.select((F.col(up) + a).cast("long").alias("parent"), (F.col(down) + b).cast("long").alias("child"))
    edges = region.select(F.lit(0).cast("long").alias("parent"), (F.col("r_regionkey") + 1).cast("long").alias("child")).union(link(nation, "n_regionkey", 1, "n_nationkey", 100)).union(link(customer, "c_nationkey", 100, "c_custkey", 1000))
    return tree.Tree(nodes, tree.ordered(edges))


GEO = """
WITH RECURSIVE n AS (SELECT 0::BIGINT AS id, 'World' AS name, 'root' AS type UNION ALL SELECT r_regionkey + 1, r_name, 'aggregation' FROM region
    UNION ALL SELECT n_nationkey + 100, n_name, 'aggregation' FROM nation UNION ALL SELECT c_custkey + 1000, c_name, 'attribute' FROM customer),
e AS (SELECT 0::BIGINT AS parent, (r_regionkey + 1)::BIGINT AS child FROM region UNION ALL SELECT n_regionkey + 1, n_nationkey + 100 FROM nation UNION ALL SELECT c_nationkey + 100, c_custkey + 1000 FROM customer),
c AS (SELECT parent AS anc, child AS "desc", 1 AS dist FROM e UNION ALL SELECT c.anc, e.child, c.dist + 1 FROM c JOIN e ON c."desc" = e.parent)
"""


@query(GEO + 'SELECT anc, "desc", dist FROM c')
def geo_tree_closure(spark, sf_dir):
    return tree.closure(geo_tree(spark, sf_dir).edges)


@query(GEO + """SELECT n.id, concat_ws(' > ', (SELECT string_agg(m.name, ' > ' ORDER BY c.dist DESC) FROM c JOIN n m ON c.anc = m.id WHERE c."desc" = n.id AND c.anc <> 0), n.name) AS path,
    (SELECT count(*) FROM c WHERE c."desc" = n.id)::INT AS depth FROM n WHERE n.id <> 0""")
def path_rows_geo(spark, sf_dir):
    return tree.path_rows(geo_tree(spark, sf_dir))


@query(GEO + """, d AS (SELECT "desc" AS id, dist AS depth FROM c WHERE anc = 0), f AS (SELECT n.id, count(e.child) AS k FROM n LEFT JOIN e ON e.parent = n.id WHERE n.type = 'aggregation' GROUP BY 1)
SELECT count(*) AS aggregations, round(avg(k), 4) AS avg_branching, round(100.0 * avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS singleton_pct,
    (SELECT max(depth) FROM d JOIN n USING (id) WHERE type = 'attribute') AS max_depth, (SELECT round(avg(depth), 4) FROM d JOIN n USING (id) WHERE type = 'attribute') AS avg_leaf_depth, (SELECT count(*) FROM n WHERE type = 'attribute') AS leaves FROM f""")
def structural_stats(spark, sf_dir):
    return tree.structural_stats(geo_tree(spark, sf_dir))


@query(GEO + """SELECT "desc" AS id, parent, depth FROM (SELECT "desc", dist AS depth FROM c WHERE anc = 0) JOIN e ON e.child = "desc" """)
def single_parent(spark, sf_dir):
    """Customers hang below both region and nation; the deeper parent stays."""
    t = geo_tree(spark, sf_dir)
    region_of = t.edges.where("parent BETWEEN 1 AND 99").select(F.col("child").alias("nation"), F.col("parent").alias("up"))
    twice = t.edges.join(region_of, F.col("parent") == F.col("nation")).select(F.col("up").alias("parent"), "child")
    fixed = tree.single_parent(tree.Tree(t.nodes, tree.ordered(t.edges.select("parent", "child").union(twice))))
    return fixed.edges.select(F.col("child").alias("id"), "parent").join(tree.depths(fixed), "id")


@query(GEO + "SELECT id, name FROM n WHERE id NOT IN (SELECT n_nationkey + 100 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)) AND (type <> 'attribute' OR id IN (SELECT c_custkey + 1000 FROM customer WHERE c_acctbal < 0)) AND (id NOT BETWEEN 1 AND 99 OR id IN (SELECT n_regionkey + 1 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)))")
def prune_empty(spark, sf_dir):
    """Only customers in debt stay; aggregations without any go."""
    t = geo_tree(spark, sf_dir)
    debt = table(spark, sf_dir, "customer").where("c_acctbal < 0").select((F.col("c_custkey") + 1000).cast("long").alias("id"))
    nodes = t.nodes.where("type <> 'attribute'").union(t.nodes.where("type = 'attribute'").join(debt, "id", "left_semi"))
    return tree.pruned(tree.Tree(nodes, t.edges)).nodes.select("id", "name")


@query("SELECT n_nationkey + 100::BIGINT AS id, r_name || ' / ' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE false UNION ALL SELECT 1 + r_regionkey, r_name || ' / all' FROM region")
def compress_chains(spark, sf_dir):
    """A region with one node `all` below it is one node."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    ids = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"))
    nodes = spark.range(1).select("id", F.lit("World").alias("name"), F.lit("root").alias("type")).union(ids.select("id", "name", F.lit("aggregation"))).union(ids.select(F.col("id") + 10, F.lit("all"), F.lit("aggregation"))).union(nation.select((F.col("n_nationkey") + 100).cast("long"), "n_name", F.lit("attribute")))
    edges = ids.select(F.lit(0).cast("long").alias("parent"), F.col("id").alias("child")).union(ids.select("id", F.col("id") + 10)).union(nation.select((F.col("n_regionkey") + 11).cast("long"), (F.col("n_nationkey") + 100).cast("long")))
    return tree.compressed(tree.Tree(nodes, tree.ordered(edges))).nodes.where("type = 'aggregation'").select("id", "name")


@query(GEO + "SELECT id, name, type FROM n WHERE contains(lower(name || ' ' || type), 'customer#00000001') OR contains(lower(name), 'ia')")
def search_nodes(spark, sf_dir):
    t = geo_tree(spark, sf_dir)
    return tree.search(t, "customer#00000001").union(tree.search(t, "IA", columns=("name",))).distinct()


# --- terms

DOC_TERMS = "WITH t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), u AS (SELECT doc, term, count(*) AS tf FROM t WHERE length(term) >= 3 GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents)\n"


def doc_terms(spark, sf_dir) -> DataFrame:
    return tfidf.terms(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), pattern="[a-z]+").where("length(term) >= 3")


@query(DOC_TERMS + "SELECT term, count(*) AS df FROM u GROUP BY 1")
def doc_freq(spark, sf_dir):
    return tfidf.doc_freq(doc_terms(spark, sf_dir))


@query(DOC_TERMS + "SELECT term, count(*) AS df, round(ln((max(n.n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM u, n GROUP BY 1")
def corpus_idf(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return tfidf.corpus_idf(doc_terms(spark, sf_dir), n).withColumn("idf", F.round("idf", 6))


TFIDF = DOC_TERMS + """, i AS (SELECT term, ln((max(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM u, n GROUP BY 1), w AS (SELECT doc, term, tf * idf AS w FROM u JOIN i USING (term)),
x AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS tfidf FROM w)
"""


@query(TFIDF + ", m AS (SELECT term, sum(tfidf) / max(n.n) AS mean_tfidf, count(*) AS df FROM x, n GROUP BY 1) SELECT term, round(mean_tfidf, 6) AS mean_tfidf, df FROM m ORDER BY round(m.mean_tfidf, 9) DESC, term LIMIT 50")
def tfidf_top_terms(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return tfidf.top_terms(tfidf.tfidf(doc_terms(spark, sf_dir), n), n, 50).withColumn("mean_tfidf", F.round("mean_tfidf", 6))


@query(TFIDF + """, g AS (SELECT source AS grp, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT source AS grp, term, round(sum(tfidf) / max(g.n), 6) AS score FROM x JOIN documents ON doc = doc_id JOIN g ON g.grp = source GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term)::INT AS rank FROM s) WHERE rank <= 5""")
def top_terms_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = tfidf.tfidf(doc_terms(spark, sf_dir), docs.count())
    return tfidf.top_terms_per_group(scores, docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("grp")), 5)


@query(DOC_TERMS + """, g AS (SELECT source AS grp, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT source AS grp, term, count(*) AS f FROM u JOIN documents ON doc = doc_id GROUP BY 1, 2),
tt AS (SELECT term, sum(f) AS f_all FROM a GROUP BY 1),
s AS (SELECT a.grp, a.term, round(f / g.n - (f_all - f) / greatest((SELECT n FROM n) - g.n, 1), 9) AS score FROM a JOIN g USING (grp) JOIN tt USING (term) WHERE f >= 2 OR f / g.n >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS k FROM s WHERE score > 0)
SELECT g.grp, coalesce(string_agg(upper(term[1]) || term[2:], ' / ' ORDER BY k), 'Group') AS label FROM g LEFT JOIN r ON r.grp = g.grp AND k <= 2 GROUP BY 1""")
def contrastive_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("grp"))
    return tfidf.contrastive_labels(doc_terms(spark, sf_dir).select("doc", "term"), docs)


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), g AS (
    SELECT p_partkey, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM w, range(1, 5) a(n), range(1, 12) b(i) WHERE i + n - 1 <= len(w))
SELECT phrase, count(DISTINCT p_partkey) AS n_rows FROM g GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2
""")
def ngram_phrases(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(text.ngrams(F.split("p_name", " "), 1, 4))).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("n_rows")).where("n_rows >= 2")


@query("SELECT p_partkey, p_name AS label, CASE WHEN ends_with(p_name, 's') AND NOT ends_with(p_name, 'ss') AND length(p_name) > 3 THEN p_name[:-2] ELSE p_name END AS single, len(string_split(p_name, ' '))::INT AS n_words FROM part")
def name_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), text.singular(F.col("p_name")).alias("single"), F.size(text.spaced(F.col("p_name"))).alias("n_words"))


_STOP_SQL = ", ".join(f"'{w}'" for w in text.EVAL_STOP)


@query(f"SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z][a-z]+'), lambda w: w NOT IN ({_STOP_SQL})))) AS tokens FROM benchmark")
def eval_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(text.eval_tokens(F.col("text"))).alias("tokens"))


# --- codes

CODES_SQL = "WITH s AS (SELECT s_suppkey AS id, upper(replace(s_name, '#', '')) AS code FROM supplier), a AS (SELECT id, regexp_extract(code, '^([A-Z]+)', 1) AS alpha FROM s), p AS (SELECT id, alpha[1:n] AS prefix, n FROM a, range(3, 60) r(n) WHERE n <= length(alpha)), c AS (SELECT prefix FROM p GROUP BY 1 HAVING count(*) >= 2)\n"


@query(CODES_SQL + "SELECT s.id, coalesce(arg_max(p.prefix, p.n), '') AS family FROM s LEFT JOIN (p JOIN c USING (prefix)) p ON s.id = p.id GROUP BY 1")
def code_families(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.upper(F.regexp_replace("s_name", "#", "")).alias("code"))
    return codes.families(rows, "id", "code")


@query(r"SELECT p_partkey, list_filter(regexp_extract_all(p_brand, '\d+'), lambda d: regexp_matches(p_name || ' ' || p_size, '\b' || d || '\b'))[1] AS digit, regexp_extract(p_brand, '(\d+)', 1) AS raw_digit FROM part")
def condition_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", codes.condition_digit(F.col("p_brand"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("digit"), facets.condition(F.col("p_brand")).alias("raw_digit"))


# --- vectors

UNIT = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v), p AS (SELECT vec_id, label, unnest(u) AS c, generate_subscripts(u, 1) - 1 AS pos FROM u), m AS (SELECT label AS grp, pos, avg(c) AS c FROM p GROUP BY 1, 2), n AS (SELECT grp, pos, c / sqrt(sum(c * c) OVER (PARTITION BY grp)) AS c FROM m)\n"


@query(UNIT + "SELECT grp, pos::INT AS pos, round(c, 6) AS c FROM n")
def centroids(spark, sf_dir):
    return evaluate.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("c", F.round("c", 6))


@query(UNIT + ", s AS (SELECT vec_id, p.label, n.grp, round(sum(p.c * n.c), 9) AS sim FROM p JOIN n USING (pos) GROUP BY ALL), b AS (SELECT vec_id AS id, any_value(label) AS current, arg_max(grp, {'s': sim, 'g': -grp}) AS best, max(sim) AS top, max(sim) FILTER (grp = label) AS own FROM s GROUP BY 1) SELECT id, current, best, best <> current AND top > own + 0.02 AS moves FROM b")
def nearest_centroid_moves(spark, sf_dir):
    return evaluate.nearest_centroids(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


@query(UNIT + ", q AS (SELECT label AS grp, pos, sum(c) AS s, count(*) AS n FROM p GROUP BY 1, 2) SELECT grp, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END, 6) AS coherence FROM q GROUP BY 1")
def sibling_coherence(spark, sf_dir):
    return evaluate.coherence(table(spark, sf_dir, "embeddings"), "label", "embedding")


# --- partitions

CELLS_SQL = "WITH t AS (SELECT lang AS a, quality || '/' || toxic AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), a AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), b AS (SELECT b, sum(n) AS n FROM t GROUP BY 1), s AS (SELECT sum(n) AS n FROM t)\n"


def cells(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.contingency(rows.withColumn("kind", F.concat_ws("/", "quality", "toxic")), "lang", "kind")


@query(CELLS_SQL + "SELECT round(sum(m) / sum(n), 4) AS purity FROM (SELECT max(n) AS m, sum(n) AS n FROM t GROUP BY a)")
def purity(spark, sf_dir):
    return evaluate.purity(cells(spark, sf_dir))


@query(CELLS_SQL + ", x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2) FROM a) AS i, (SELECT sum(n * (n - 1) / 2) FROM b) AS j, (SELECT n * (n - 1) / 2 FROM s) AS p) SELECT round(CASE WHEN (i + j) / 2 = i * j / p THEN 1 ELSE (ij - i * j / p) / ((i + j) / 2 - i * j / p) END, 4) AS ari FROM x")
def ari(spark, sf_dir):
    return evaluate.ari(cells(spark, sf_dir))


MI_SQL = CELLS_SQL + ", h AS (SELECT (SELECT sum(t.n / s.n * ln(t.n * s.n / (a.n * b.n))) FROM t JOIN a USING (a) JOIN b USING (b), s) AS mi, (SELECT -sum(a.n / s.n * ln(a.n / s.n)) FROM a, s) AS ha, (SELECT -sum(b.n / s.n * ln(b.n / s.n)) FROM b, s) AS hb)\n"


@query(MI_SQL + "SELECT round(CASE WHEN ha + hb = 0 THEN 1 ELSE mi / ((ha + hb) / 2) END, 4) AS nmi FROM h")
def nmi(spark, sf_dir):
    return evaluate.nmi(cells(spark, sf_dir))


@query(MI_SQL + """, k AS (SELECT a.n::BIGINT AS x, b.n::BIGINT AS y, s.n::BIGINT AS t, unnest(range(greatest(1, (a.n + b.n - s.n)::BIGINT), least(a.n, b.n)::BIGINT + 1)) AS k FROM a, b, s),
em AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS emi FROM k)
SELECT round(CASE WHEN abs((ha + hb) / 2 - emi) < 1e-15 THEN 1 ELSE (mi - emi) / ((ha + hb) / 2 - emi) END, 4) AS ami FROM h, em""")
def ami(spark, sf_dir):
    return evaluate.ami(cells(spark, sf_dir))


# --- tree metrics

def customer_paths(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The system has all customers by region and nation; gold those with orders, builders by region alone and others by segment and nation."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    ordered = c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    gold = F.when(F.col("c_mktsegment") == "BUILDING", F.array("r_name")).otherwise(F.array("c_mktsegment", "n_name"))
    return c.select(F.col("c_name").alias("leaf"), F.array("r_name", "n_name").alias("path")), ordered.select(F.col("c_name").alias("leaf"), gold.alias("path"))


PATHS_SQL = """
WITH c AS (SELECT c_name AS leaf, r_name AS s1, r_name || ' > ' || n_name AS s2, CASE WHEN c_mktsegment = 'BUILDING' THEN r_name ELSE c_mktsegment END AS g1,
    CASE WHEN c_mktsegment = 'BUILDING' THEN r_name ELSE c_mktsegment || ' > ' || n_name END AS g2
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (SELECT o_custkey FROM orders)),
p AS (SELECT a.s2 = b.s2 AS ss, a.s1 = b.s1 AS sc, a.g2 = b.g2 AS gs, a.g1 = b.g1 AS gc FROM c a JOIN c b ON a.leaf < b.leaf)"""


def _pairs_sql(name: str, s: str, g: str) -> str:
    return f"""{PATHS_SQL}, x AS (SELECT (SELECT count(*) FROM c) AS m, count(*) FILTER ({s}) AS s, count(*) FILTER ({g}) AS g, count(*) FILTER ({s} AND {g}) AS t FROM p)
SELECT m AS n_matched_leaves, round(t / s, 4) AS {name}_p, round(t / g, 4) AS {name}_r, round(2 * t / s * t / g / (t / s + t / g), 4) AS {name}_f1 FROM x"""


@query(_pairs_sql("edge", "ss", "gs"))
def edge_f1(spark, sf_dir):
    return evaluate.edge_f1(*customer_paths(spark, sf_dir))


@query(_pairs_sql("ancestor", "sc", "gc"))
def ancestor_f1(spark, sf_dir):
    return evaluate.ancestor_f1(*customer_paths(spark, sf_dir))


@query(PATHS_SQL + """, x AS (SELECT (SELECT count(*) FROM c) AS n_matched_leaves, count(*) FILTER (ss) AS n_system, count(*) FILTER (gs) AS n_gold, count(*) FILTER (ss AND NOT gc) AS wrong_merge, count(*) FILTER (gs AND sc AND NOT ss) AS refined, count(*) FILTER (gs AND NOT sc) AS missed FROM p)
SELECT *, round(wrong_merge / n_system, 4) AS wrong_merge_rate, round(refined / n_gold, 4) AS refinement_rate, round(missed / n_gold, 4) AS missed_rate FROM x""")
def refinement(spark, sf_dir):
    return evaluate.refinement(*customer_paths(spark, sf_dir))


@query(PATHS_SQL + """, a AS (SELECT leaf, unnest([s1, s2]) AS i FROM c), b AS (SELECT DISTINCT leaf, unnest([g1, g2]) AS j FROM c), na AS (SELECT i, count(*) AS ni FROM a GROUP BY 1 HAVING count(*) >= 2), nb AS (SELECT j, count(*) AS nj FROM b GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT i, j, count(*) AS k, any_value(ni) AS ni, any_value(nj) AS nj FROM a JOIN na USING (i) JOIN b USING (leaf) JOIN nb USING (j) GROUP BY 1, 2), y AS (SELECT i, j, k / (ni + nj - k) AS jac FROM x),
z AS (SELECT (SELECT avg(m) FROM (SELECT max(jac) AS m FROM y GROUP BY i)) AS p, (SELECT avg(m) FROM (SELECT max(jac) AS m FROM y GROUP BY j)) AS r)
SELECT round(p, 4) AS overlap_p, round(r, 4) AS overlap_r, round(2 * p * r / (p + r), 4) AS overlap_f1 FROM z""")
def set_overlap(spark, sf_dir):
    return evaluate.set_overlap(*customer_paths(spark, sf_dir))


@query(GEO + """, l AS (SELECT id, name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM n WHERE type = 'aggregation'),
k AS (SELECT parent, count(*) AS n, count(DISTINCT array_to_string(w, ' ')) AS d FROM e JOIN l ON child = l.id GROUP BY 1)
SELECT round(100 * avg((NOT contains(name, '/') AND len(w) BETWEEN 1 AND 3 AND length(w[-1]) > 2)::INT), 1) AS concept_label_pct, round(avg(len(w)), 2) AS avg_label_words, round(100 * (SELECT sum(n - d) FROM k) / count(*), 1) AS redundancy_pct FROM l""")
def label_quality(spark, sf_dir):
    return evaluate.label_quality(geo_tree(spark, sf_dir))


# --- slots, builds, views

PHRASES_SQL = """
WITH w AS (SELECT p_partkey AS row, p_type AS grp, string_split(p_name, ' ') AS w FROM part),
g AS (SELECT DISTINCT grp, row, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM w, range(1, 5) a(n), range(1, 12) b(i) WHERE i + n - 1 <= len(w)),
f AS (SELECT grp, phrase FROM g WHERE length(phrase) >= 3 GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT g.* FROM g JOIN f USING (grp, phrase)),
m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.grp = k.grp AND q.row = k.row AND q.phrase <> k.phrase AND contains(q.phrase, k.phrase))),
c AS (SELECT grp, phrase, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 2), p AS (SELECT m.grp, m.row, m.phrase, c.n FROM m JOIN c USING (grp, phrase))
"""


def part_phrases(spark, sf_dir) -> DataFrame:
    return slots.phrases(table(spark, sf_dir, "part"), "p_type", "p_partkey", F.col("p_name"))


@query(PHRASES_SQL + "SELECT * FROM p")
def maximal_phrases(spark, sf_dir):
    return part_phrases(spark, sf_dir)


@query(PHRASES_SQL + "SELECT a.grp, a.phrase AS a, b.phrase AS b, round(1 - count(*) / least(any_value(a.n), any_value(b.n)), 6) AS m FROM p a JOIN p b ON a.grp = b.grp AND a.row = b.row AND a.phrase < b.phrase GROUP BY 1, 2, 3")
def mutual_exclusion(spark, sf_dir):
    return slots.exclusion(part_phrases(spark, sf_dir))


@query()
def slot_assignment(spark, sf_dir):
    """Greedy slots depend on the order of phrases; held against properties in tests."""
    return part_slots(spark, sf_dir)[1]


def part_slots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All rows of part by type, and their slots."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("row"))
    own = written(part_phrases(spark, sf_dir), "part-phrases")
    found = slots.gated(own, slots.assigned(own, slots.slots(own)), rows.groupBy("grp").agg(F.count("*").alias("total")))
    return rows, written(found, "part-slots")


@query()
def slot_hierarchy_part(spark, sf_dir):
    """R7 on R4's slots; held against a recursive version in tests."""
    found = build.slot_hierarchy(*part_slots(spark, sf_dir))
    return found.select("grp", "row", F.array_join("path", " > ").alias("path"))


@query("""
WITH a AS (SELECT c_nationkey AS grp, c_custkey AS row, c_mktsegment AS s, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS b FROM customer),
m AS (SELECT *, count(*) OVER (PARTITION BY grp, s) AS n, min(s) OVER (PARTITION BY grp) <> max(s) OVER (PARTITION BY grp) AS split FROM a),
x AS (SELECT *, split AND n > 1 AS one, NOT split OR n > 1 AS going FROM m),
k AS (SELECT *, CASE WHEN one THEN s ELSE '' END AS p FROM x),
y AS (SELECT *, count(*) OVER (PARTITION BY grp, p, b, going) AS nb, min(b) OVER (PARTITION BY grp, p, going) <> max(b) OVER (PARTITION BY grp, p, going) AS split_b FROM k),
z AS (SELECT grp, row, p, CASE WHEN going AND split_b AND nb > 1 THEN b ELSE '' END AS q FROM y),
c AS (SELECT grp, count(DISTINCT nullif(p, '')) + count(DISTINCT CASE WHEN q <> '' THEN p || '/' || q END) AS nodes FROM z GROUP BY 1)
SELECT z.grp, z.row, CASE WHEN nodes < 2 THEN '' ELSE p || CASE WHEN p <> '' AND q <> '' THEN ' > ' ELSE '' END || q END AS path FROM z JOIN c USING (grp)
""")
def role_hierarchy_customer(spark, sf_dir):
    """Segments as measures, debt or credit as conditions, within nations."""
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("row"), "c_mktsegment", F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("side"))
    roles = own.select("grp", "row", F.lit("measure").alias("role"), F.col("c_mktsegment").alias("value")).union(own.select("grp", "row", F.lit("condition"), "side"))
    found = build.role_hierarchy(own.select("grp", "row"), roles)
    return found.select("grp", "row", F.array_join("path", " > ").alias("path"))


@query()
def cluster_tree_part(spark, sf_dir):
    """H1 with labels over all parts, on TF-IDF vectors of their names; held against brute force in tests."""
    rows = part_rows(spark, sf_dir).select("row", F.col("label").alias("name"), "semantic_text", name_tokens(F.col("semantic_text")).alias("words"))
    vectors = build.text_vectors(rows, "row", F.col("semantic_text")).withColumnRenamed("id", "row")
    t = build.cluster_tree(rows.join(vectors, "row").drop("semantic_text"), "vector")
    return t.nodes.join(t.edges.select(F.col("child").alias("id"), "parent"), "id", "left").select("id", "name", "type", "parent")


@query(GEO + ", k AS (SELECT anc AS id, count(*) AS v FROM c JOIN n ON c.\"desc\" = n.id WHERE n.type = 'attribute' GROUP BY 1) SELECT n.id, n.name[1:40] AS label, e.parent, coalesce(k.v, 1) AS value FROM n LEFT JOIN e ON n.id = e.child LEFT JOIN k ON n.id = k.id")
def viz_table(spark, sf_dir):
    return viz.viz_table(geo_tree(spark, sf_dir))


@query(GEO + ", k AS (SELECT anc, count(*) AS v FROM c WHERE anc BETWEEN 100 AND 999 GROUP BY 1) SELECT id, name, type FROM n WHERE type <> 'attribute' UNION ALL SELECT anc + 1000000000, '+' || v || ' nodes', 'collapsed' FROM k")
def collapsed_graph(spark, sf_dir):
    return viz.collapsed_graph(geo_tree(spark, sf_dir), 2).nodes


@query("SELECT event_type, k AS key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def events_dictionary(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query()
def ward_tree_embeddings(spark, sf_dir):
    """H1 without cluster labels: paths of clusters within each label."""
    found = ward.paths(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return found.select(F.col("id").alias("vec_id"), F.col("grp").alias("label"), F.array_join(F.transform("path", lambda c: c.cast("string")), " > ").alias("path"))


@query(f"""
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z][a-z]+'), lambda w: w NOT IN ({_STOP_SQL}))) AS t FROM documents), d AS (SELECT * FROM t WHERE len(t) > 0), n AS (SELECT count(*) AS n FROM d),
l AS (SELECT grp, unnest(list_distinct(list_filter(regexp_extract_all(lower(label), '[a-z][a-z][a-z]+'), lambda w: w NOT IN ({_STOP_SQL})))) AS term FROM ({{LABELS}})),
p AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM l)), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
c AS (SELECT grp, term, df FROM l JOIN f USING (term) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY df DESC, term) <= 5),
w AS (SELECT a.grp, a.term AS x, b.term AS y, a.df AS dx, b.df AS dy FROM c a JOIN c b ON a.grp = b.grp AND a.term < b.term),
o AS (SELECT a.term AS x, b.term AS y, count(*) AS c FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2),
s AS (SELECT grp, (coalesce(c, 0) + 1e-12) / n AS pxy, dx / n * (dy / n) AS pp FROM w LEFT JOIN o USING (x, y), n),
m AS (SELECT grp, avg(ln(pxy / (pp + 1e-12) + 1e-12) / -ln(pxy + 1e-12)) AS m FROM s GROUP BY 1)
SELECT round(coalesce(avg(m), 0), 4) AS npmi FROM m
""".replace("{LABELS}", ORACLES["contrastive_labels"]))
def npmi_sources(spark, sf_dir):
    """V2 of the contrastive labels of sources over all documents."""
    docs = table(spark, sf_dir, "documents")
    labels = written(contrastive_labels(spark, sf_dir), "source-labels")
    nodes = labels.select(F.xxhash64("grp").alias("id"), F.col("label").alias("name"), F.lit("aggregation").alias("type"))
    return evaluate.npmi(nodes, docs, "doc_id", "text")


# --- groups of rows and nodes

@query("SELECT p_type AS top, count(*) AS n, min(p_partkey) - 1 AS first, row_number() OVER (ORDER BY min(p_partkey), p_type) AS place FROM part GROUP BY 1")
def top_groups_part(spark, sf_dir):
    return groups.top_groups(part_rows(spark, sf_dir), "group_path", "row")


@query("SELECT p_type || ' > ' || p_brand AS path, 2 AS depth, count(*) AS n FROM part GROUP BY 1")
def terminal_groups_part(spark, sf_dir):
    return groups.terminal_groups(part_rows(spark, sf_dir), "group_path")


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def value_counts_orders(spark, sf_dir):
    return groups.value_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority, o_orderstatus) AS place FROM orders GROUP BY 1, 2")
def ordered_distinct_orders(spark, sf_dir):
    return groups.ordered_distinct(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("SELECT p_type AS top, count(DISTINCT p_brand) AS n_paths, count(DISTINCT p_brand) <= 1 AS skip FROM part GROUP BY 1")
def unary_groups_part(spark, sf_dir):
    return groups.unary_groups(part_rows(spark, sf_dir), "group_path")


@query("SELECT c_mktsegment AS family, count(*) AS members, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM customer GROUP BY 1")
def family_pairs_customer(spark, sf_dir):
    return groups.family_pairs(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query(GEO + ", k AS (SELECT anc AS id, count(*) AS v FROM c JOIN n ON c.\"desc\" = n.id WHERE n.type = 'attribute' GROUP BY 1) SELECT e.parent, e.child, row_number() OVER (PARTITION BY e.parent ORDER BY coalesce(k.v, 1) DESC, e.child) - 1 AS ord FROM e LEFT JOIN k ON e.child = k.id")
def children_by_size_geo(spark, sf_dir):
    own = geo_tree(spark, sf_dir)
    return groups.children_by_size(own.edges, tree.leaf_counts(own))


@query(UNIT + ", w AS (SELECT pos, avg(c) AS c FROM p GROUP BY 1) SELECT grp, pos::INT AS pos, round(c, 6) AS c FROM n UNION ALL SELECT NULL, pos::INT, round(c / sqrt(sum(c * c) OVER ()), 6) FROM w")
def corpus_centroids(spark, sf_dir):
    return groups.corpus_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("c", F.round("c", 6))


@query(UNIT + ", q AS (SELECT label AS grp, pos, sum(c) AS s, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT grp, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END, 6) AS coherence FROM q GROUP BY 1) SELECT row_number() OVER (ORDER BY coherence, grp) AS place, grp, n, coherence, coherence < 0.25 AS incoherent FROM r")
def incoherent_labels(spark, sf_dir):
    return groups.incoherent(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("SELECT count(*) AS n, count(*) FILTER (l_discount > 0 AND l_discount < 0.25) AS low, count(*) FILTER (l_discount > 0 AND l_discount <= 0.25) AS low_or_bound, count(*) FILTER (l_discount > 0.08) AS aligned, count(*) FILTER (l_discount = 0) AS fallback FROM lineitem")
def confidence_lineitem(spark, sf_dir):
    return groups.confidence(table(spark, sf_dir, "lineitem"), "l_discount")


@query("SELECT c_nationkey AS parent, count(*) AS clusters, max(n) <= 0.7 * sum(n) AND min(n) >= 2 AS balanced FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def balanced_nations(spark, sf_dir):
    return groups.balanced(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query(f"""
WITH o AS (SELECT p_partkey AS row, p_brand AS grp, p_type AS family, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z][a-z][a-z]+'), lambda w: w NOT IN ({_STOP_SQL}))) AS words FROM part),
g AS (SELECT family, grp AS other, list_distinct(flatten(list(words))) AS has FROM o GROUP BY 1, 2),
s AS (SELECT o.row, o.grp, g.other, CASE WHEN len(o.words) = 0 THEN 0 ELSE round(len(list_intersect(o.words, g.has)) / len(o.words), 3) END AS sim FROM o JOIN g USING (family)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY sim DESC, other) AS place FROM s WHERE other <> grp),
x AS (SELECT o.row, o.grp AS current, (SELECT sim FROM s WHERE s.row = o.row AND s.other = o.grp) AS current_sim, a.other AS alt_1, coalesce(a.sim, 0) AS sim_1, b.other AS alt_2, coalesce(b.sim, 0) AS sim_2 FROM o LEFT JOIN r a ON a.row = o.row AND a.place = 1 LEFT JOIN r b ON b.row = o.row AND b.place = 2)
SELECT *, CASE WHEN round(sim_1 - current_sim, 6) > 0.10 THEN 'move' WHEN round(sim_1 - current_sim, 6) > 0 THEN 'review' ELSE 'keep' END AS decision FROM x
""")
def conflicts_part(spark, sf_dir):
    return groups.conflicts(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), "p_brand", "p_type")


PRESERVED_SQL = CELLS_SQL.replace("SELECT lang AS a, quality || '/' || toxic AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2", "SELECT n_regionkey AS a, c_mktsegment AS b, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")


PRESERVATION_SQL = MI_SQL.replace(CELLS_SQL, PRESERVED_SQL) + """, k AS (SELECT a.n::BIGINT AS x, b.n::BIGINT AS y, s.n::BIGINT AS t, unnest(range(greatest(1, (a.n + b.n - s.n)::BIGINT), least(a.n, b.n)::BIGINT + 1)) AS k FROM a, b, s),
em AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS emi FROM k),
z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2) FROM a) AS i, (SELECT sum(n * (n - 1) / 2) FROM b) AS j, (SELECT n * (n - 1) / 2 FROM s) AS p)
SELECT (SELECT round(sum(m) / sum(n), 4) FROM (SELECT max(n) AS m, sum(n) AS n FROM t GROUP BY a)) AS purity, round((ij - i * j / p) / ((i + j) / 2 - i * j / p), 4) AS ari, round(mi / ((ha + hb) / 2), 4) AS nmi, round((mi - emi) / ((ha + hb) / 2 - emi), 4) AS ami FROM h, em, z"""


@query(PRESERVATION_SQL)
def group_preservation_geo(spark, sf_dir):
    """customers' segments against the regions right below the root."""
    return evaluate.group_preservation(geo_tree(spark, sf_dir), table(spark, sf_dir, "customer"), "c_name", "c_mktsegment")


@query(PRESERVATION_SQL.replace(PRESERVED_SQL, CELLS_SQL.replace("SELECT lang AS a, quality || '/' || toxic AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2", "SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2")))
def group_preservation_part(spark, sf_dir):
    """V4, J1 by leaf ids: parts' types against the brands right below the root; many leaves share a name."""
    part = table(spark, sf_dir, "part").withColumn("row", F.col("p_partkey") - 1).withColumn("leaf_id", F.concat_ws(".", "p_type", F.col("p_partkey").cast("string")))
    return evaluate.group_preservation(tree.from_paths(part, F.array("p_brand"), F.col("p_name"), payload=["leaf_id"]), part, "leaf_id", "p_type", by="leaf_id")


@query("""
SELECT p_partkey::VARCHAR AS name, 'attribute' AS type, 'determine' AS dtype, true AS is_shown, 'p_type: ' || p_type || ' | p_brand: ' || p_brand || ' | p_partkey: ' || p_partkey || ' | p_name: ' || p_name || ' | p_size: ' || p_size AS "desc", p_type || ' > ' || p_brand || '.' || p_partkey AS leaf_id, p_type || ' > ' || p_brand AS group_path FROM part
UNION ALL SELECT DISTINCT p_type, 'aggregation', 'aggregation', true, 'Group: ' || p_type, NULL, NULL FROM part UNION ALL SELECT 'type', 'root', 'root', true, 'Root node', NULL, NULL
""")
def described_nodes_part(spark, sf_dir):
    """Nodes of the facet tree of part, as viewers read them."""
    return tree.described(part_tree(spark, sf_dir)).nodes.select("name", "type", "dtype", "is_shown", "desc", "metadata.leaf_id", "metadata.group_path")



@query(GEO + ", r AS (SELECT parent, list(child ORDER BY child) AS related FROM e GROUP BY 1), x AS (SELECT id, name, type, coalesce(related, []::BIGINT[]) AS related FROM n LEFT JOIN r ON id = parent) SELECT to_json(list({'id': id, 'name': name, 'type': type, 'related': related} ORDER BY id))::VARCHAR AS json FROM x")
def tree_list_geo(spark, sf_dir):
    """K1."""
    return sinks.tree_list(geo_tree(spark, sf_dir))


# --- concept candidates and labels from titles

_LABEL_STOP_SQL = ", ".join(f"'{w}'" for w in text.LABEL_STOP)
_STATES_SQL = ", ".join(f"'{w}'" for w in concepts.VALUE_STATES)
_NO_STATE = f"NOT (len(list_filter(regexp_extract_all(lower(label), '\\b[a-z]{{2,}}\\b'), lambda w: w NOT IN ({_LABEL_STOP_SQL}))) > 0 AND len(list_filter(regexp_extract_all(lower(label), '\\b[a-z]{{2,}}\\b'), lambda w: w NOT IN ({_LABEL_STOP_SQL}) AND w NOT IN ({_STATES_SQL}))) = 0)"
_PART_TEXT_SQL = "WITH b AS (SELECT p_partkey AS row, p_type AS top, p_type || ' > ' || p_brand AS path, p_type || ' ' || p_name || ': a part of size ' || p_size || ' as ' || lower(p_brand) AS text FROM part)"
_TITLES_SQL = f"""z AS (SELECT string_agg(DISTINCT top, '|') AS tops FROM b), h AS (SELECT regexp_replace(trim(split_part(text, ':', 1)), '^(' || tops || ')\\s+', '', 'i') AS label FROM b, z WHERE length(trim(split_part(text, ':', 1))) < 0.8 * length(text)),
ti AS (SELECT label, count(*) AS n FROM h WHERE length(label) >= 3 AND len(string_split(label, ' ')) <= 4 AND label NOT LIKE '%\\_%' ESCAPE '\\' AND {_NO_STATE} GROUP BY 1 HAVING count(*) >= 2)"""
_PHRASES_SQL = f"""ph AS (SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{concepts.PHRASE}', 1)) AS label FROM b) WHERE length(label) >= 5 AND len(list_filter(string_split_regex(label, '\\s+'), lambda w: w NOT IN ({_LABEL_STOP_SQL}) AND length(w) >= 3)) > 0 AND {_NO_STATE} GROUP BY 1 HAVING count(*) >= 2)"""


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lit(": a part of size "), F.col("p_size").cast("string"), F.lit(" as "), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.concat_ws(" > ", "p_type", "p_brand").alias("path"), F.concat(F.concat_ws(" ", "p_type", "p_name"), size).alias("text"))


@query(f"{_PART_TEXT_SQL}, {_TITLES_SQL} SELECT label, n FROM ti")
def title_candidates_part(spark, sf_dir):
    """F2, F3."""
    return concepts.titles(part_texts(spark, sf_dir), F.col("text"), F.col("path"))


@query(f"{_PART_TEXT_SQL}, {_PHRASES_SQL} SELECT label, n FROM ph")
def phrase_candidates_part(spark, sf_dir):
    return concepts.phrases(part_texts(spark, sf_dir), F.col("text"))


@query(f"""
{_PART_TEXT_SQL}, {_TITLES_SQL}, {_PHRASES_SQL},
gp AS (SELECT trim(label) AS label, count(*) AS n FROM (SELECT unnest(string_split(path, ' > ')) AS label FROM (SELECT DISTINCT path FROM b)) WHERE length(trim(label)) >= 3 GROUP BY 1),
t AS (SELECT row, list_filter(regexp_extract_all(lower(text), '\\b\\w\\w+\\b'), lambda w: w NOT IN ({_LABEL_STOP_SQL})) AS w FROM b),
g AS (SELECT row, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS term FROM t),
f AS (SELECT row, term, count(*) AS tf FROM g GROUP BY 1, 2), k AS (SELECT term, count(*) AS df FROM f GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 600), s AS (SELECT count(*) AS n FROM b),
w AS (SELECT row, term, df, n, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM f JOIN k USING (term), s), u AS (SELECT term, df, n, w / sqrt(sum(w * w) OVER (PARTITION BY row)) AS u FROM w),
m AS (SELECT term AS label, any_value(df) AS n, sum(u) / any_value(n) AS m FROM u GROUP BY 1 ORDER BY round(m, 9) DESC, label LIMIT 150),
ng AS (SELECT label, n, m * CASE WHEN label LIKE '% %' THEN 1.0 ELSE 0.5 END AS tfidf FROM m WHERE length(label) >= 4 AND regexp_matches(label, '[a-z]') AND {_NO_STATE}),
a AS (SELECT lower(label) AS key, 'description_title' AS source, 0 AS place, min(label) AS label, max(n) AS n, 0.95 AS tfidf FROM ti GROUP BY 1 UNION ALL SELECT lower(label), 'group_path', 1, min(label), sum(n), 1.0 FROM gp GROUP BY 1
    UNION ALL SELECT label, 'metadata_tfidf', 2, label, n, tfidf FROM ng UNION ALL SELECT label, 'noun_phrase', 3, label, n, 0.0 FROM ph),
c AS (SELECT arg_min(label, place) AS label, arg_min(source, place) AS source, arg_min(n, place) + CASE WHEN min(place) = 0 THEN coalesce(sum(n) FILTER (place = 1), 0) ELSE 0 END AS frequency, arg_min(tfidf, place) AS tfidf FROM a GROUP BY key),
o AS (SELECT * FROM c ORDER BY CASE source WHEN 'group_path' THEN 0 WHEN 'description_title' THEN 1 ELSE 2 END, round(tfidf, 9) DESC, frequency DESC, label LIMIT 150),
x AS (SELECT lower(top) AS top, string_agg(lower(text), ' ') AS all_text FROM b GROUP BY 1),
d AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(label), '\\b[a-z]{{3,}}\\b'), lambda w: w NOT IN ({_LABEL_STOP_SQL}))) AS own FROM o)
SELECT label, source, frequency::BIGINT AS frequency, round(tfidf, 6) AS tfidf, CASE WHEN len(own) = 0 THEN 0 ELSE (SELECT count(*) FROM x WHERE len(list_filter(own, lambda w: contains(all_text, w))) = len(own)) END AS cross_group_count FROM d
""")
def concept_candidates_part(spark, sf_dir):
    """E1, J12, W3."""
    return concepts.candidates(part_texts(spark, sf_dir), "row", F.col("text"), F.col("path")).withColumn("tfidf", F.round("tfidf", 6))


_TITLE_COUNTS_SQL = f"""
WITH t AS (SELECT p_partkey AS row, p_type AS parent, p_brand AS cluster, list_filter(regexp_extract_all(lower(p_name), '[a-z][a-z\\-]+'), lambda w: w NOT IN ({_LABEL_STOP_SQL}) AND w NOT IN ({", ".join(f"'{w}'" for w in text.LABEL_BOILERPLATE)})) AS w FROM part),
p AS (SELECT parent, cluster, phrase, count(DISTINCT row) AS inside FROM (SELECT row, parent, cluster, unnest(flatten([[array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)] for n in range(1, 5)])) AS phrase FROM t) GROUP BY ALL),
s AS (SELECT parent, cluster, count(*) AS members FROM t GROUP BY 1, 2), c AS (SELECT p.*, members, coalesce((SELECT sum(q.inside) FROM p q WHERE q.parent = p.parent AND q.phrase = p.phrase AND q.cluster <> p.cluster), 0)::BIGINT AS outside,
    coalesce((SELECT sum(r.members) FROM s r WHERE r.parent = p.parent AND r.cluster <> p.cluster), 0)::BIGINT AS siblings FROM p JOIN s USING (parent, cluster))
"""


def part_title_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.phrase_contrast(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), "p_type", "p_brand")


@query(_TITLE_COUNTS_SQL + "SELECT * FROM c")
def title_phrase_counts_part(spark, sf_dir):
    """A-4."""
    return part_title_counts(spark, sf_dir)


@query(_TITLE_COUNTS_SQL + """, r AS (SELECT parent, cluster, phrase, round((inside / members - outside / greatest(siblings, 1)) * (1 + 0.25 * (len(string_split(phrase, ' ')) - 1)), 9) AS score FROM c WHERE inside >= 2)
SELECT parent, cluster, array_to_string([upper(w[1]) || w[2:] for w in string_split(phrase, ' ')], ' ') AS label, score FROM r WHERE score > -1 QUALIFY row_number() OVER (PARTITION BY parent, cluster ORDER BY score DESC, phrase) = 1""")
def title_labels_part(spark, sf_dir):
    """L2."""
    return concepts.title_labels(part_title_counts(spark, sf_dir))


@query()
def accepted_labels_part(spark, sf_dir):
    """Brands of a type, by name, take their commonest phrase that no earlier brand has."""
    offers = part_title_counts(spark, sf_dir).select("parent", "cluster", F.col("cluster").alias("ord"), F.col("phrase").alias("label"), F.col("inside").alias("score"))
    return concepts.accepted(offers)


@query("""
WITH t AS (SELECT p_size AS cluster, string_split('Size class ' || p_size // 10 || ' ' || p_type, ' ') AS w FROM part), f AS (SELECT cluster, k, array_to_string(w[1:k], ' ') AS prefix, count(*) AS n FROM (SELECT cluster, w, unnest(range(2, len(w) + 1)) AS k FROM t) GROUP BY ALL),
l AS (SELECT cluster, greatest(1, floor(0.6 * count(*))) AS least FROM t GROUP BY 1)
SELECT cluster, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(prefix, ' ')], ' ') AS prefix, n FROM f JOIN l USING (cluster) WHERE n >= least QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY k DESC, n DESC, prefix) = 1
""")
def common_prefixes_part(spark, sf_dir):
    """T19."""
    said = F.concat(F.lit("name: "), F.col("p_name"), F.lit(" | description: Size class "), F.floor(F.col("p_size") / 10).cast("string"), F.lit(" "), F.col("p_type"), F.lit(": as sold | size: 1"))
    return concepts.common_prefixes(table(spark, sf_dir, "part").withColumn("said", said), "p_size", F.col("said"))


# --- roles, metrics of a build, word vectors, head nouns

@query("""SELECT c_custkey + 1000 AS id, c_mktsegment AS grp, c_name AS label, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE r_name END AS measure, '' AS statistic, '' AS condition, '' AS subtype, '' AS outcome, '' AS modifier, 'origin: ' || n_name AS other
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def role_table_geo(spark, sf_dir):
    """Regions tell a measure, which customers in debt have of their own; nations tell another role."""
    own, customer = geo_tree(spark, sf_dir), table(spark, sf_dir, "customer")
    rows = customer.select((F.col("c_custkey") + 1000).alias("id"), F.col("c_mktsegment").alias("grp"), F.col("c_name").alias("label"))
    of_nodes = own.nodes.where("type = 'aggregation'").select("id", F.when(F.col("id") < 100, "measure").otherwise("origin").alias("role"))
    audit = customer.select((F.col("c_custkey") + 1000).alias("id"), F.lit("measure").alias("role"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("").alias("value"))
    return roles.role_table(own, rows, of_nodes, audit)


@query("""SELECT count(*) AS variables, round(100 * count(*) FILTER (l_discount > 0.08) / count(*), 1) AS coverage_pct, round(avg(l_discount), 3) AS avg_confidence, count(*) FILTER (l_discount = 0) AS fallbacks, round(100 * count(*) FILTER (l_discount = 0) / count(*), 1) AS fallback_pct,
    count(*) FILTER (l_discount > 0 AND l_discount <= 0.25) AS low_confidence, count(*) FILTER (l_returnflag <> 'N') AS with_family, round(100 * count(*) FILTER (l_returnflag <> 'N') / count(*), 1) AS family_pct,
    (SELECT count(*) FROM part) AS concepts, (SELECT count(*) FROM part WHERE p_type = 'PROMO') AS wikidata, (SELECT count(*) FROM part WHERE p_type <> 'PROMO') AS pubmed FROM lineitem""")
def build_metrics_lineitem(spark, sf_dir):
    """A-17."""
    rows = table(spark, sf_dir, "lineitem").select("l_discount", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("family"))
    found = table(spark, sf_dir, "part").select(F.when(F.col("p_type") == "PROMO", "wikidata").otherwise("pubmed").alias("source"))
    return roles.build_metrics(rows, "l_discount", "family", found)


@query(f"""
WITH t AS (SELECT p_partkey AS row, list_filter(string_split(lower(regexp_replace(p_name, '[^a-zA-Z]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in text.NAME_STOP)})) AS w FROM part),
v AS (SELECT DISTINCT word, [length(word), ascii(word) - 100, ascii(right(word, 1)) - 100]::DOUBLE[] AS vec FROM (SELECT unnest(w) AS word FROM t) WHERE word > 'c'),
m AS (SELECT row, pos, avg(vec[pos + 1]) AS x FROM (SELECT row, unnest(w) AS word FROM t) JOIN v USING (word), (SELECT unnest([0, 1, 2]) AS pos) GROUP BY 1, 2), n AS (SELECT row, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
SELECT row, pos, round(x / CASE WHEN norm > 0 THEN norm ELSE 1 END, 6) AS c FROM m JOIN n USING (row) UNION ALL SELECT row, unnest([0, 1, 2]), 0.0 FROM t WHERE row NOT IN (SELECT row FROM n)
""")
def averaged_vectors_part(spark, sf_dir):
    """M1, with vectors made from a word's length and letters; words up to ``c`` have none."""
    part = table(spark, sf_dir, "part")
    word, number = F.col("word"), lambda c: c.cast("double")
    vectors = part.select(F.explode(name_tokens(F.col("p_name"))).alias("word")).where("word > 'c'").distinct().select("word", F.array(number(F.length(word)), number(F.ascii(word) - 100), number(F.ascii(F.right(word, F.lit(1))) - 100)).alias("vec"))
    return roles.averaged_vectors(part, "p_partkey", F.col("p_name"), vectors).withColumn("c", F.round("c", 6))


@query("""
WITH k AS (SELECT p_type, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS h FROM part GROUP BY ALL), g AS (SELECT p_type, h FROM k GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT p_type FROM k GROUP BY 1 HAVING count(*) >= 3)
SELECT p_type || ' > ' || CASE WHEN g.h IS NOT NULL AND t.p_type IS NOT NULL THEN upper(k.h[1]) || k.h[2:] || ' > ' || upper(a[1]) || a[2:] ELSE k.p_name END || ' > ' || p_partkey AS path, 3 + (g.h IS NOT NULL AND t.p_type IS NOT NULL)::INT AS depth
FROM part JOIN k USING (p_type, p_name) LEFT JOIN g USING (p_type, h) LEFT JOIN t USING (p_type)
""")
def nested_by_head_part(spark, sf_dir):
    """H7: paths of parts below their types and names."""
    rows = table(spark, sf_dir, "part").withColumn("row", F.col("p_partkey") - 1)
    nested = tree.nested_by_head(tree.from_paths(rows, F.array("p_type", "p_name"), F.col("p_partkey").cast("string")))
    leaves = nested.nodes.where("type = 'attribute'").select("id")
    return tree.path_rows(nested).join(leaves, "id", "left_semi").select("path", "depth")
