"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.llm import bpe, decontaminate, licenses, lines, paragraphs, periods, quality, simhash, sql, token_counts, token_files, toxicity, whitening
from hitmill.llm.ngram_join import ngram_join
from hitmill.llm.scratch import stage
from hitmill.llm.shipping import ship
from hitmill.session import prepare
from hitmill.staging import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by at least 0.9 Jaccard similarity of three-word shingles."""
    return ngram_join(_table(spark, sf_dir, "documents"), 3, (90, 100), by_parts=True)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by merge replay, decoded again; digests of both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path)
    both = bpe.decode(ids.withColumn("ids_sha256", F.sha2("ids", 256)), path)
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text counts of every document, and whether tokenizers find it ordinary for its language."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")]
    out = quality.quality(_table(spark, sf_dir, "documents"), *paths)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *(c for c in out.columns if c not in first))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to token files and read back."""
    path = new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return token_files.read_token_files(spark, path, token_files.crc32s, "ids_crc32 long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after inserts, deletes, revised counts and repeated batches.

    All documents are inserted with the counts of one tokenizer, then of another; all but
    the first of equal texts are deleted; the second tokenizer's counts are revised to hold an
    end token; and two batches are sent again.
    """
    paths = {name: public_tokenizers.path(f"{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = _table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    counted, _ = stage(token_counts.count_tokens(docs, paths, ("doc_id", "source", "lang", "digest")), "token-counts")

    def changes(op: str, tokenizer: str, rows: DataFrame = counted, more: int = 0) -> DataFrame:
        return rows.select("doc_id", "source", "lang", F.lit(op).alias("op"), F.lit(tokenizer).alias("tokenizer"), (F.col(tokenizer) + more).alias("n_tokens"))

    one, two = paths
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = first.withColumnRenamed("digest", "same")
    # Null texts are copies of each other.
    pairs = counted.join(first, F.col("digest").eqNullSafe(F.col("same")))
    copies, kept = pairs.where("doc_id > first"), pairs.where("doc_id = first")
    totals = token_counts.TokenTotals(spark, new_path(spark, "token-totals"))
    totals.commit("load-1", changes("insert", one))
    totals.commit("load-2", changes("insert", two))
    totals.commit("copies", changes("delete", one, copies).unionByName(changes("delete", two, copies)))
    totals.commit("end-token", changes("revise", two, kept, 1))
    totals.commit("load-2", changes("insert", two))
    totals.commit("end-token", changes("revise", two, kept, 1))
    return totals.totals()


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat across documents."""
    return paragraphs.repeats(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    held_out = toxicity.held_out(F.col("doc_id"))
    labels = _table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text lines of every page without its host's boilerplate."""
    pages = _table(spark, sf_dir, "pages").select("page_id", lines.host(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("text"))
    # HTML is cut once for both readings.
    pages, _ = stage(pages, "page-lines")
    clean = lines.drop_boilerplate(pages.withColumn("all_lines", F.size(F.split("text", "\n", -1))), F.col("host"), "text")
    return clean.select("page_id", "host", F.col("all_lines").cast("long").alias("n_lines"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_kept"), "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by fingerprints of three-word shingles that differ in two bits at most."""
    return simhash.near_copies(_table(spark, sf_dir, "documents"), 3, 2)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat with a period, once a part of one document in ten is repeated."""
    return periods.periodic_runs(_table(spark, sf_dir, "documents"), repeat=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_paragraphs": op6_paragraphs,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_licenses": op10_licenses,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {"op1_ngram_join": sql.NGRAM_JOIN, "op9_line_dedup": sql.LINE_DEDUP, "op10_licenses": sql.LICENSES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries; each sets up the session it is given."""
    return {name: (lambda spark, sf_dir, query=query: query(ship(prepare(spark)), sf_dir)) for name, query in QUERIES.items()}
