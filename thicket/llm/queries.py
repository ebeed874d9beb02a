"""The queries of this subpackage on the driver's tables, and the oracle SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.llm import kmeans_tree, mixing, ngram_join, ogg, ranked_search, secret_scan, simhash, token_counts, token_files, toxicity, unigram, url_cascade, word_runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), words=4, threshold=85).select("doc_id", "n_shingles", "component_id")


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).drop("ids")


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"))


def op7_url_cascade_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7_url_cascade, with all keys listed that have a blocked word; the SQL of that query holds its short list."""
    return url_cascade.judge(table(spark, sf_dir, "pages"), blocked=url_cascade.worded)


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.stored(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest(word_runs.find(table(spark, sf_dir, "documents"), alter=word_runs.planted))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_scan": op2_secret_scan,
    "op3_kmeans_tree": op3_kmeans_tree,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_unigram": op6_unigram,
    "op7_url_cascade": op7_url_cascade,
    "op7_url_cascade_words": op7_url_cascade_words,
    "op8_ogg": op8_ogg,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_word_runs": op11_word_runs,
    "op12_simhash": op12_simhash,
    "op13_ranked_search": op13_ranked_search,
}

HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LISTED = ", ".join(f"'{h}'" for h in url_cascade.BLOCKED_HOSTS)

OP7_SQL = f"""
WITH p AS (
    SELECT page_id, coalesce({HOST}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
hit AS (SELECT DISTINCT host FROM hosts, (SELECT unnest([{LISTED}]) AS k) WHERE host = k OR ends_with(host, '.' || k)),
fit AS (
    SELECT page_id, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
    FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN hit.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict, hit.host IS NOT NULL AS listed
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN hit ON p.host = hit.host
"""

BLOCKED = ", ".join(f"'{w}'" for w in url_cascade.BLOCKED_WORDS)
OP7_WORDS_SQL = OP7_SQL.replace(f"hosts, (SELECT unnest([{LISTED}]) AS k) WHERE host = k OR ends_with(host, '.' || k)", f"hosts WHERE list_has_any(regexp_split_to_array(host, '[.-]'), [{BLOCKED}])")

OP10_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT >> 2) AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source
), l AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS n FROM s
), v AS (
    SELECT *, (least(1.5::DOUBLE * sum(source_size) OVER (), sum(cap) OVER ()) - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l
), a AS (SELECT *, (SELECT arg_min(level, n) FROM v WHERE w * level < cap) AS lv FROM v
), t AS (SELECT source, source_size, CASE WHEN lv IS NULL OR w * lv >= cap THEN cap ELSE w * lv END AS target FROM a
), k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM t
), c AS (
    SELECT d.doc_id, d.size, d.h, k.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS words, count(*) OVER (PARTITION BY d.source, d.h) AS tied, row_number() OVER (PARTITION BY d.source, d.h ORDER BY d.doc_id) - 1 AS nth, target - whole * source_size AS rest
    FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN upto <= rest OR (upto - words <= rest AND words > 0 AND nth < ceil((rest - (upto - words)) / (words / tied) - 0.5)) THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM c
"""

ORACLES: dict[str, str] = {"op7_url_cascade": OP7_SQL, "op7_url_cascade_words": OP7_WORDS_SQL, "op10_mixing": OP10_SQL}
