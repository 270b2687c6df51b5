"""Token totals kept up to date by batches of changes.

A batch is a set of changes to documents: inserted, deleted, or counted anew by some version
of a tokenizer. Against the ledger (what each document counts for now) every change
becomes signed rows, minus the old count and plus the new one, and their sums by
source, language and tokenizer are the batch's delta. Totals are the sum of all deltas. Delta and
ledger entries of a batch are written to a folder that one rename publishes; a batch that was
published before changes nothing.

Entries are sorted by document, so that a batch reads of the ledger what lies between its
own first and last document. Every so many batches all folders are merged into one, so the
number of files and the entries that newer ones replaced stay small.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hitmill.llm import bpe

GROUP = ("source", "lang", "tokenizer")
_CHANGES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, present boolean"
_ENTRIES = f"{_CHANGES}, number int"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_IDS = "number int, id string"
# Folders of batches from which they are merged.
MERGE_AT = 16


def count_tokens(df: DataFrame, paths: dict[str, str], keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` and a column of token counts (long) for each named vocabulary.

    ``paths`` name files of base64 strings and ranks; a null text counts as empty.
    """
    names = [f"k{i}" for i in range(len(keep))]
    schema = t.StructType([t.StructField(n, df.schema[k].dataType) for n, k in zip(names, keep)] + [t.StructField(f"n{i}", t.LongType()) for i in range(len(paths))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [bpe.Vocabulary.from_ranks(p) for p in paths.values()]
        for block in bpe.blocks(batches, "text"):
            sizes = [np.diff(block.encode(v)[1]) for v in vocabularies]
            for rows, numbers, counts in zip(block.rows, block.numbers, block.counts):
                ends = np.concatenate([[0], np.cumsum(counts)])
                sums = [np.concatenate([[0], np.cumsum(size[numbers])])[ends] for size in sizes]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(np.diff(s)) for s in sums)], names=schema.names)

    picked = df.select(*(df[k].alias(n) for n, k in zip(names, keep)), df[text].alias("text"))
    return picked.mapInArrow(run, schema).toDF(*keep, *paths)


def _by_document(entries: DataFrame) -> DataFrame:
    return entries.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tokenizer")


class TokenTotals:
    """Totals by source, language and tokenizer in a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[tuple[int, int, str]]:
        """First and last batch and name of the published folders that no merged one covers, in order."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.path))]
        single = [(int(n[:8]), int(n[:8]), n) for n in names if re.match(r"\d{8}-", n)]
        merged = [(int(n[7:15]), int(n[16:24]), n) for n in names if re.fullmatch(r"merged-\d{8}-\d{8}", n)]
        last = max(merged, key=lambda x: x[1], default=None)
        return ([last] if last else []) + sorted(x for x in single if not last or x[0] > last[1])

    def _ids(self) -> dict[str, int]:
        """Numbers of the published batches by id."""
        out = {}
        for low, high, name in self._folders():
            if name.startswith("merged-"):
                out |= {r.id: r.number for r in self.spark.read.schema(_IDS).parquet(f"{self.path}/{name}/ids").collect()}
            else:
                out[name[9:]] = low
        return out

    def batches(self) -> list[str]:
        """Ids of the published batches, in order."""
        ids = self._ids()
        return sorted(ids, key=ids.__getitem__)

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/{kind}" for _, _, name in self._folders()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, entries: DataFrame) -> DataFrame:
        entry = F.struct("source", "lang", "n_tokens", "present", "number")
        return entries.groupBy("doc_id", "tokenizer").agg(F.max_by(entry, "number").alias("e")).where("e.present")

    def ledger(self) -> DataFrame:
        """What every document counts for now: the newest entry of each doc_id and tokenizer."""
        return self._newest(self._read("changes", _ENTRIES)).select("doc_id", "tokenizer", "e.source", "e.lang", "e.n_tokens")

    def merge(self) -> None:
        """Put all published folders into one, without entries that newer ones replaced.

        One rename publishes it; the folders it covers stay until ``vacuum``, for readers that began before.
        """
        folders = self._folders()
        if len(folders) < 2:
            return
        last = folders[-1][1]
        folder = f"{self.path}/_writing-merged"
        self._files.delete(self._path(folder), True)
        newest = self._newest(self._read("changes", _ENTRIES)).select("doc_id", "tokenizer", "e.*")
        _by_document(newest.select(*(f.split()[0] for f in _ENTRIES.split(", ")))).write.parquet(f"{folder}/changes")
        self.totals().write.parquet(f"{folder}/delta")
        self.spark.createDataFrame([(n, i) for i, n in self._ids().items()], _IDS).coalesce(1).write.parquet(f"{folder}/ids")
        if not self._files.rename(self._path(folder), self._path(f"{self.path}/merged-{1:08d}-{last:08d}")):
            raise RuntimeError("merged batches could not be published")

    def vacuum(self) -> None:
        """Remove the folders that a merged one covers."""
        live = {name for _, _, name in self._folders()}
        for status in self._files.listStatus(self._path(self.path)):
            if status.getPath().getName() not in live:
                self._files.delete(status.getPath(), True)

    def totals(self) -> DataFrame:
        """``n_docs`` and ``n_tokens`` (long) of every source, language and tokenizer that has documents."""
        sums = self._read("delta", _DELTA).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was published before.

        ``changes``: doc_id, tokenizer, op (``insert``, ``revise`` or ``delete``), source, lang,
        n_tokens. Insert and revise set what the document counts for; delete takes it
        out, and needs no other columns. Changes of documents that count for the same
        already, and deletes of unknown ones, add nothing. Of several changes of one document
        and tokenizer a delete wins, else the largest (n_tokens, source, lang). Rows without
        doc_id or tokenizer, or with another op, are left out; a null count is 0; null sources and
        languages are groups of their own. Other columns are not read. An empty batch counts as
        published.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self._ids():
            return False
        if len(self._folders()) >= MERGE_AT:
            self.merge()
        folders = self._folders()
        number = folders[-1][1] + 1 if folders else 1
        folder = f"{self.path}/_writing-{batch_id}"
        self._files.delete(self._path(folder), True)

        rows = changes.select("doc_id", "tokenizer", "op", *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        rows = rows.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('insert', 'revise', 'delete')")
        # A maximum of sortable values combines before the shuffle; a null sorts below all.
        pick = F.struct((F.col("op") == "delete").alias("gone"), "n_tokens", "source", "lang")
        new = rows.groupBy("doc_id", "tokenizer").agg(F.max(pick).alias("c")).select("doc_id", "tokenizer", F.col("c.source").alias("source"), F.col("c.lang").alias("lang"), F.col("c.n_tokens").alias("n_tokens"), (~F.col("c.gone")).alias("present"))
        new.write.parquet(f"{folder}/new")
        new = self.spark.read.schema(new.schema).parquet(f"{folder}/new")
        low, high = new.agg(F.min("doc_id"), F.max("doc_id")).first()
        entries = self._read("changes", _ENTRIES).where(F.lit(False) if low is None else F.col("doc_id").between(low, high))
        old = self._newest(entries).select("doc_id", "tokenizer", F.struct("e.source", "e.lang", "e.n_tokens").alias("old"))
        both = new.join(old, ["doc_id", "tokenizer"], "left")
        same = F.col("old").isNotNull() & F.col("present") & F.col("old").eqNullSafe(F.struct("source", "lang", "n_tokens"))
        changed = both.where(~same & (F.col("present") | F.col("old").isNotNull()))
        changed.write.parquet(f"{folder}/both")
        changed = self.spark.read.schema(changed.schema).parquet(f"{folder}/both")
        plain = changed.select("doc_id", "tokenizer", "source", "lang", "n_tokens", "present")
        _by_document(plain.withColumn("number", F.lit(number))).write.parquet(f"{folder}/changes")
        signed = plain.where("present").select(*GROUP, F.lit(1).alias("sign"), "n_tokens").unionByName(
            changed.where("old IS NOT NULL").select("old.source", "old.lang", "tokenizer", F.lit(-1).alias("sign"), "old.n_tokens")
        )
        delta = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.where("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{folder}/delta")
        for done in ("new", "both"):
            self._files.delete(self._path(f"{folder}/{done}"), True)
        # The rename publishes the batch; before it, readers see nothing of it.
        if not self._files.rename(self._path(folder), self._path(f"{self.path}/{number:08d}-{batch_id}")):
            raise RuntimeError(f"batch {batch_id} could not be published")
        return True
