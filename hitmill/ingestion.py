"""Appending runs to the stored results, each revision once.

An append is a folder of files and an entry in a manifest. The files come first; one
rename then publishes the entry, and with it all of the batch. An append that broke
left no entry: its files are never read, and the batch can be sent again. Of two appends
at the same time one publishes its number first; the other looks again at what is stored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from hitmill.operators.ingest import new_revisions
from hitmill.sources.results import RESULTS_SCHEMA, append_results, strict_csv

# Entries of the manifest, by number; a leading underscore hides the folder from readers.
MANIFEST = "_batches"


class _Files:
    """The few operations on the store that an append needs, by the store's own client."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self.store = self._path(path).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.store.getUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        if not self.store.exists(place):
            return []
        return sorted(status.getPath().getName() for status in self.store.listStatus(place))

    def read(self, path: str) -> str:
        stream = self.store.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file under another name and rename it; False if ``path`` is taken."""
        folder, _, name = path.rpartition("/")
        draft = self._path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = self.store.create(draft, False)
        stream.write(text.encode())
        stream.close()
        try:
            self.context.rename(draft, self._path(path), self.no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.store.delete(draft, False)
            return False
        return True


def _entries(files: _Files, path: str) -> list[dict]:
    names = [name for name in files.names(f"{path}/{MANIFEST}") if not name.startswith(".")]
    return [json.loads(files.read(f"{path}/{MANIFEST}/{name}")) for name in names]


def stored_results(spark: SparkSession, path: str, form: str = "csv") -> DataFrame | None:
    """The rows of all published batches, or None before the first append."""
    return _stored(spark, path, form, _entries(_Files(spark, path), path))


def _stored(spark: SparkSession, path: str, form: str, entries: list[dict]) -> DataFrame | None:
    folders = [f"{path}/{entry['folder']}" for entry in entries if entry["folder"]]
    if not folders:
        return spark.createDataFrame([], RESULTS_SCHEMA) if entries else None
    return _read(spark, folders, form)


def _read(spark: SparkSession, folders: list[str], form: str) -> DataFrame:
    reader = strict_csv(spark) if form == "csv" else spark.read
    return reader.schema(RESULTS_SCHEMA).format(form).load(folders)


def append_new_revisions(batch: DataFrame, path: str, form: str = "csv") -> bool:
    """Append the rows of revisions that ``path`` does not hold yet, as one step.

    Running it again with the same batch adds nothing, also if it broke half way.
    True if something was published.
    """
    spark = batch.sparkSession
    files = _Files(spark, path)
    while True:
        entries = _entries(files, path)
        stored = _stored(spark, path, form, entries)
        rows = batch if stored is None else new_revisions(batch, stored)
        folder = f"batch-{uuid.uuid4().hex}"
        append_results(rows, f"{path}/{folder}", form)
        if stored is not None and _read(spark, [f"{path}/{folder}"], form).isEmpty():
            return False
        if files.publish(f"{path}/{MANIFEST}/{len(entries):010d}", json.dumps({"folder": folder})):
            return True
