"""Queries on text vectors, aspects and clusters of average linkage, and the oracle SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import callbacks, concept_tree, expand, linkage, lod, lowrank, nesting, slots, tree
from thicket.plans.catalog import DOC_TERMS, part_rows, query, table
from thicket.storage import written


def part_texts(spark, sf_dir) -> DataFrame:
    """grp, row, text of parts: names with sizes, within their types."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("row"), F.concat_ws(" ", "p_name", F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("text"), F.col("p_brand").alias("brand"))


def rounded(vector) -> F.Column:
    return F.transform(vector, lambda x: F.round(x, 6) + 0.0)


@query()
def text_vectors_documents(spark, sf_dir):
    """Unit vectors of all documents by truncated SVD of their TF-IDF weights."""
    docs = table(spark, sf_dir, "documents")
    found = lowrank.encoded(docs, "doc_id", F.col("text"))
    return found.select(F.col("key").alias("doc_id"), rounded("vector").alias("vector"))


@query(DOC_TERMS.replace("[a-z]+", "[a-z]{2,}").replace("length(term) >= 3", f"term NOT IN ({', '.join(repr(w) for w in lowrank.STOP)})") + """, v AS (SELECT term FROM u GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 300),
w AS (SELECT doc, term, tf * (ln((1 + n.n) / (1 + df)) + 1) AS w FROM u JOIN v USING (term) JOIN (SELECT term, count(*) AS df FROM u GROUP BY 1) USING (term), n)
SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w
""")
def packed_weights_documents(spark, sf_dir):
    """A-7 with the 300 commonest terms, as packed rows have them."""
    docs = table(spark, sf_dir, "documents").withColumn("plain", F.concat_ws(" ", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))))
    words = lowrank.vocabulary(docs, F.col("plain"), 300, 1, 1)
    names = spark.createDataFrame(list(enumerate(words.terms)), "t int, term string")
    spread = lowrank.packed(docs, "doc_id", F.col("plain"), words).select(F.col("key").alias("doc"), F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    return spread.join(F.broadcast(names), F.col("x.terms") == F.col("t")).select("doc", "term", F.round("x.weights", 6).alias("weight"))


@query()
def eval_vectors_part(spark, sf_dir):
    """S16."""
    return lowrank.eval_vectors(part_texts(spark, sf_dir), "row", F.col("text")).select(F.col("key").alias("row"), rounded("vector").alias("vector"))


@query()
def semantic_map_part(spark, sf_dir):
    """Two coordinates of each part's canonical text."""
    found = lowrank.semantic_map(part_rows(spark, sf_dir), "row", F.col("text"))
    return found.select(F.col("key").alias("row"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
WITH e AS (SELECT l_returnflag || l_linestatus AS grp, l_linenumber AS k, round(avg(l_extendedprice), 6) AS error FROM lineitem GROUP BY 1, 2),
s AS (SELECT grp, k, lead(k) OVER w AS next, lead(error, 2) OVER w - 2 * lead(error) OVER w + error AS bend FROM e WINDOW w AS (PARTITION BY grp ORDER BY k))
SELECT grp, (CASE WHEN count(*) <= 2 THEN min(k) WHEN max(bend) - min(bend) < 1e-8 THEN greatest(2, floor(sqrt(count(*)))) ELSE arg_max(next, bend) END)::INT AS k FROM s GROUP BY grp
""")
def elbow_lineitem(spark, sf_dir):
    """Where mean prices by line number bend most, as errors by number of aspects do."""
    errors = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("grp"), F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_extendedprice"), 6).alias("error"))
    return lowrank.elbow(errors)


def part_aspects(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return lowrank.aspects(part_texts(spark, sf_dir), "grp", "row", F.col("text"), most=6)


@query()
def aspects_part(spark, sf_dir):
    """M7: aspects of the names of each type's parts."""
    return part_aspects(spark, sf_dir)[0].select("grp", "k", "aspect", "label")


@query()
def aspect_vectors_part(spark, sf_dir):
    """M9: how many terms of each part every aspect of its type has, and the greatest weight."""
    found = written(part_aspects(spark, sf_dir)[0], "aspects")
    own = lowrank.aspect_vectors(part_texts(spark, sf_dir), "grp", "row", F.col("text"), found)
    return own.select("grp", "row", "aspect", F.size("terms").alias("terms"), F.round(F.array_max("weights"), 6).alias("greatest"))


@query()
def family_clusters_embeddings(spark, sf_dir):
    """M5: clusters of each label's vectors, those of one tenth of ids a family."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.concat(F.lit("f"), (F.col("vec_id") % 10).cast("string")).alias("family"))
    return linkage.family_clusters(rows, "label", "vec_id", "embedding", F.col("family"))


@query()
def phrase_clusters_embeddings(spark, sf_dir):
    """Clusters of each label's vectors by the best silhouette."""
    found = linkage.best_clusters(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return found.select("grp", "id", "cluster", "k", F.round("score", 6).alias("score"))


@query()
def text_clusters_part(spark, sf_dir):
    """M6: clusters of the names within each type and brand, with labels."""
    rows = part_texts(spark, sf_dir).withColumn("place", F.concat_ws(" > ", "grp", "brand"))
    return linkage.text_clusters(rows, "place", "row", F.col("text"))


@query()
def phrase_roles_part(spark, sf_dir):
    """Roles of the phrases of each type's part names, by vectors of the phrases themselves."""
    rows = part_texts(spark, sf_dir)
    own = written(slots.phrases(rows, "grp", "row", F.col("text")), "part-phrases")
    kinds = own.select("phrase").distinct()
    vectors = lowrank.encoder(kinds, "phrase", F.col("phrase"), dims=16, stop=[]).encode(kinds, "phrase", F.col("phrase")).withColumnRenamed("key", "phrase")
    return linkage.phrase_roles(rows.select("grp", "row"), own, vectors)[1]


@query("""
WITH c AS (SELECT p_type AS grp, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
SELECT grp, count(*) > 1 AND max(n) <= 0.85 * sum(n) AND 2 * count(*) FILTER (n = 1) <= count(*) AS fine FROM c GROUP BY 1
""")
def split_gate_part(spark, sf_dir):
    """whether brands are a good split of each type."""
    return lod.split_gate(table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")))


@query("""
WITH k AS (SELECT DISTINCT p_type, p_name, p_brand FROM part), g AS (SELECT p_type, p_name FROM k GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT p_type || ' > ' || p_name || CASE WHEN g.p_name IS NULL THEN ' ' ELSE ' > ' END || p_brand || ' > ' || p_partkey AS path, 3 + (g.p_name IS NOT NULL)::INT AS depth FROM part LEFT JOIN g USING (p_type, p_name)
""")
def factored_prefixes_part(spark, sf_dir):
    """Paths of parts below their types and nodes of names with brands, whose names are factored out."""
    rows = table(spark, sf_dir, "part").withColumn("row", F.col("p_partkey") - 1)
    found = tree.factored_prefixes(tree.from_paths(rows, F.array("p_type", F.concat_ws(" ", "p_name", "p_brand")), F.col("p_partkey").cast("string")))
    leaves = found.nodes.where("type = 'attribute'").select("id")
    return tree.path_rows(found).join(leaves, "id", "left_semi").select("path", "depth")


@query()
def lod_tree_part(spark, sf_dir):
    """Every part's path in the tree built from types and brands, slots and aspects of names and sizes; with the routes of the nodes above it."""
    rows = part_texts(spark, sf_dir).select("row", F.col("row").cast("string").alias("label"), F.concat_ws(" > ", "grp", "brand").alias("grp"), "text")
    built = lod.build(rows, "parts")
    leaves = built.nodes.where("type = 'attribute'").select("id", "row")
    routes = built.edges.select("parent", F.col("child").alias("id")).join(built.nodes.select(F.col("id").alias("parent"), "route", "source"), "parent").select("id", "route", "source")
    return tree.path_rows(built).join(leaves, "id").join(routes, "id").select("row", "path", "depth", "route", "source")


def leaf_rows(found: tree.Tree) -> DataFrame:
    """path, depth of all leaves."""
    return tree.path_rows(found).join(found.nodes.where("type = 'attribute'").select("id"), "id", "left_semi").select("path", "depth")


@query()
def concept_tree_part(spark, sf_dir):
    """H2, H3: every part's path in the tree of concepts within types, named from names and sizes."""
    rows = part_texts(spark, sf_dir).select("row", F.col("row").cast("string").alias("label"), F.col("grp").alias("group_path"), F.concat_ws(": ", F.element_at(F.split("text", " size"), 1), "text").alias("desc"))
    return leaf_rows(concept_tree.build(rows, "parts")[0])


@query()
def nested_by_measure_part(spark, sf_dir):
    """H6: paths of parts below their types and nodes of names with the word set, whose shared phrases are nested."""
    rows = table(spark, sf_dir, "part").withColumn("row", F.col("p_partkey") - 1)
    return leaf_rows(nesting.nested_by_measure(tree.from_paths(rows, F.array("p_type", F.concat_ws(" ", "p_name", F.lit("set"))), F.col("p_partkey").cast("string"))))


@query()
def split_by_title_part(spark, sf_dir):
    """H9: paths of parts below their types and brands, split by the words of their names."""
    rows = table(spark, sf_dir, "part").withColumn("row", F.col("p_partkey") - 1)
    given = tree.from_paths(rows, F.array("p_type", "p_brand"), F.col("p_partkey").cast("string"))
    titles = given.nodes.where("type = 'attribute'").select("id", "name").join(rows.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("title")), "name").select("id", "title")
    return leaf_rows(nesting.split_by_title(given, titles))


def embedding_tree(spark: SparkSession, sf_dir: str) -> tuple[tree.Tree, DataFrame]:
    """The vectors as leaves below their labels, and (id, vector)."""
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").withColumn("row", F.col("vec_id"))
    given = tree.from_paths(rows, F.array(F.col("label").cast("string")), F.col("vec_id").cast("string"), payload=["row"])
    ids = given.nodes.where("row IS NOT NULL").select("id", F.col("row").alias("vec_id"))
    return given, ids.join(rows.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("id", "vector")


@query()
def width_expansion_embeddings(spark, sf_dir):
    """The label each vector ends with, after it has moved to the nearest group pass after pass."""
    found = expand.expanded(*embedding_tree(spark, sf_dir)).tree
    leaves = found.nodes.where("row IS NOT NULL").select(F.col("id").alias("child"), F.col("row").alias("vec_id"))
    groups = found.nodes.where("type = 'aggregation'").select(F.col("id").alias("parent"), F.col("name").alias("label"))
    return found.edges.join(leaves, "child").join(groups, "parent").select("vec_id", "label")


@query()
def expansion_report_embeddings(spark, sf_dir):
    """Coherence of each group before and after."""
    given, vectors = embedding_tree(spark, sf_dir)
    return expand.expanded(given, vectors).coherence.join(given.nodes.select(F.col("id").alias("node"), "name"), "node").drop("node")


@query("""
WITH a AS (SELECT p_type AS grp, p_partkey AS row, unnest(['measure', 'subtype']) AS role, unnest([split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)]) AS value FROM part),
k AS (SELECT grp, role FROM a GROUP BY 1, 2 HAVING count(DISTINCT value) >= 2), g AS (SELECT grp FROM a JOIN k USING (grp, role) GROUP BY grp HAVING count(DISTINCT role) >= 2 AND count(DISTINCT row) >= 4)
SELECT grp, row, role, value FROM a JOIN k USING (grp, role) JOIN g USING (grp) WHERE value <> ''
""")
def row_roles_part(spark, sf_dir):
    """R2, with a plain function in a model's place: a name's last word is its measure, its first one a subtype, and its type's name is made up."""

    def say(names, fulls, samples):
        return [{"measure": (n.split() + ["", ""])[1], "subtype": (n.split() + [""])[0], "condition": "nowhere to be found"} for n in names]

    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("row"), F.col("p_name").alias("text"))
    return callbacks.row_roles(rows, say)[0]
