"""Which files of a Parquet directory may hold a text, by the three-character pieces of a column.

A side table has one bitmap per file. A substring filter first asks it for files with all pieces
of the wanted text; only these are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.sources.hits import load_hits

# Bits of a file's signature: one bucket of Spark's bitmap functions.
BITS = 32768
PIECE = 3


def _positions(text: Column) -> Column:
    """Where the pieces of a text stand in a signature; none for shorter texts."""
    starts = F.when(F.length(text) >= PIECE, F.sequence(F.lit(1), F.length(text) - PIECE + 1))
    places = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, PIECE)), F.lit(BITS)))
    return F.array_distinct(F.coalesce(places, F.array().cast("array<bigint>")))


def file_signatures(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``file`` and ``bits`` of every file below ``path``; a file without a piece has empty bits.

    The bits of a file combine before the shuffle, so a large file is read by many tasks.
    """
    rows = spark.read.parquet(path)
    pieces = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.explode_outer(_positions(F.col(column).cast("string"))).alias("place"),
    )
    return pieces.groupBy("file").agg(F.bitmap_construct_agg("place").alias("bits"))


def files_with(signatures: DataFrame, needle: str) -> DataFrame:
    """The files that may hold ``needle``: all for texts shorter than a piece."""

    def held(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        moved = F.call_function("shiftright", byte.cast("int"), (place % 8).cast("int"))
        return moved.bitwiseAND(F.lit(1)) == 1

    return signatures.where(F.forall(_positions(F.lit(needle)), held)).select("file")


def load_hits_with(spark: SparkSession, path: str, signatures: DataFrame, needle: str) -> DataFrame:
    """The hits of files that may hold ``needle`` in the signatures' column; the filter itself
    stays with the query. File names reach the driver, as those of any scan do."""
    files = sorted(r.file for r in files_with(signatures, needle).collect())
    schema = spark.read.parquet(path).schema
    if not files:
        return load_hits(spark, path, schema).where(F.lit(False))
    return load_hits(spark, path, schema, files)
