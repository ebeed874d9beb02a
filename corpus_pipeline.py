"""Corpus pipeline: toxic documents go, one document of each group of near copies stays, secrets are masked, sources are mixed, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir) that gives a DataFrame; run()
writes each result as Parquet in the shared folder and reads it for the next.
All stages but the last keep the columns of ``documents`` as they are.

Defined cases: null texts are clean, unlike any other text, without secrets, of
size 0 and encode to no ids; the near-copy stage decides by id and text: rows
that repeat both are one document, rows that share an id or have none are told
apart by their texts, and rows without either all stay; empty tables pass through; other columns ride along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm import mixing, ngram_join, secret_scan, toxicity, unigram
from thicket.llm.queries import table, tokenizer
from thicket.storage import small, written

#: Near copies here are texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
WORDS, THRESHOLD = 5, 80
#: Tables of up to so many keys of two longs are broadcast; longer ones are joined by shuffle.
MOST_KEYS = 1_000_000
#: Texts are long, so Arrow batches of documents have at most so many rows; that bounds a worker's memory and changes no result.
BATCH_ROWS = 1000


def _batched(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the ordinal model rejects; it is fitted on the labelled ones."""
    _batched(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.rejecter(docs, model)(F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id, and of those the one with the smallest hash."""
    _batched(spark)
    # A document is an id and a text: 128 bits of both tell documents of one id, or of none, apart. Known ids come first.
    keys = ["\u0000h1", "\u0000h2"]
    for seed, key in enumerate(keys):
        docs = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *[F.col(k).alias(k[1:]) for k in keys]).alias("doc_id"), "text")
    found = ngram_join.join(named, words=WORDS, threshold=THRESHOLD)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*[F.col(f"doc_id.{k[1:]}").alias(k) for k in keys]).distinct()
    # Whole documents are moved only where rows repeat an id and a text: of these one stays.
    known = docs.where(F.col("doc_id").isNotNull() | F.col("text").isNotNull())
    again = known.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)
    again, gone = written(again.join(gone, keys, "left_anti"), "repeated-rows"), written(gone, "near-copies")
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("text", *keys) and not kind.startswith("map")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*rest)))
    once = docs.join(small(again, MOST_KEYS), keys, "left_semi").withColumn("\u0000n", first).where(F.col("\u0000n") == 1).drop("\u0000n")
    return docs.join(small(again.union(gone), MOST_KEYS), keys, "left_anti").union(once).drop(*keys)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret's span replaced by a mark, and n_chars the new length."""
    _batched(spark)
    out = docs.withColumn("text", secret_scan.redactor(docs)(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, n_byte_pieces, restored of each document."""
    _batched(spark)
    return unigram.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("encoding", encode)]

#: Trained models and hashed order have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
