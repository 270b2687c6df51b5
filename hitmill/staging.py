"""Intermediate tables in the shared folder of the cluster.

A staged table cuts the lineage, survives the loss of executors, and gives
Catalyst the real size of an intermediate result: a join against a staged table
is broadcast when its files are below ``spark.sql.autoBroadcastJoinThreshold``
and a shuffled join otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, below this application's id."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: intermediate tables need a folder "
                "that every executor can reach"
            )
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="hitmill-staging-")
        folder = _local_folders[app]
    return f"{folder.rstrip('/')}/hitmill/{app}"


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path for one staged table."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (runs one job)."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
