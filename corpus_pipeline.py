"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes all documents that the stage before it kept, written as Parquet in
between. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.llm import bpe, decontaminate, lines, ngram_join, toxicity
from hitmill.llm.scratch import stage
from hitmill.llm.shipping import ship
from hitmill.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Lines on more than this share of a source's documents are boilerplate.
LINE_RATIO = 0.05


def _hashed(docs: DataFrame) -> DataFrame:
    """The columns of documents, others left out, and the text's ``hash``."""
    return docs.select(*COLUMNS, F.xxhash64("text").alias("hash"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents without rejected ones; both have ``doc_id`` and the text's ``hash``."""
    gone = rejected.select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct()
    return _hashed(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic; the labels outside the held-out fold teach."""
    ship(prepare(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.toxicity(_hashed(docs), labels, keep=("hash",))
    return _without(docs, scored.where(F.col("score") >= toxicity.THRESHOLD))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many distinct texts of their source hold; a text of
    nothing but such lines stays whole, for the next stage to keep one of its copies."""
    ship(prepare(spark))
    clean = lines.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), "text", LINE_RATIO, copies_once=True)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 Jaccard similarity of five-word shingles, the one
    of the smallest doc_id; documents without a word are groups of their own."""
    ship(prepare(spark))
    docs = docs.select(*COLUMNS)
    groups = ngram_join.ngram_join(docs, 5, (4, 5))
    copies = groups.where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    left = docs.select(*COLUMNS).join(copies, F.col("doc_id") == F.col("gone_id"), "left_anti")
    # Rows that repeat an id are copies too, if their texts are equal; few rows, if any, move.
    several = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("several")).count().where("count > 1").select("several")
    same = F.col("doc_id") == F.col("several")
    return left.join(several, same, "left_anti").unionByName(left.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(prepare(spark))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.leaks(_hashed(docs), benchmark, keep=("doc_id", "hash")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, decoded again to see that nothing is lost."""
    ship(prepare(spark))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, path, keep=("doc_id", "lang", "source", "n_chars"))
    both = bpe.decode(ids.withColumn("coded", F.col("ids")), path, ids="coded")
    return both.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", encode),
]

# Learned scores, similarity joins and BPE are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs, _ = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
