"""Comment triage as a streaming job, with the operators of the batch job.

Every micro-batch is routed as a batch: against the users, jobs and replies as they
are at that moment, and against what the stream itself decided before. Nothing
waits for a watermark, so a comment of any age is routed when it arrives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hitmill.operators.triage import RepoRules, job_rows, route
from hitmill.staging import new_path, remove

# Reads a side table anew.
Reader = Callable[[SparkSession], DataFrame]
KEYS = ["repo", "id"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_versions(comments: DataFrame) -> DataFrame:
    """One row per comment, the one updated last; equal times are ordered by the other columns."""
    others = [name for name in comments.columns if name not in (*KEYS, "updated_at")]
    sortable = [name for name in others if not comments.schema[name].dataType.simpleString().startswith("map")]
    newest = F.max(F.struct("updated_at", *sortable)).alias("_newest")
    return comments.groupBy(*KEYS).agg(newest).select(*KEYS, "_newest.*").select(*comments.columns)


def decided(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All stored decisions, or those of the batches before one; None if there are none yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return stored if before is None else stored.where(F.col("batch") < before)


def dispositions(spark: SparkSession, path: str) -> DataFrame:
    """The decision on the newest version of every comment."""
    return newest_versions(decided(spark, path).drop("batch"))


def fresh_versions(stream: DataFrame) -> DataFrame:
    """Per micro-batch, the newest version of every comment that arrived in this batch for the first time.

    The state of a comment is its newest version with the time of the batch that brought
    it. Repeats and outdated versions leave the state as it is, so they do not come out.
    ``edited`` tells that an earlier batch brought another version. Nothing is forgotten:
    there is no watermark, and the state grows with the number of comments.
    """
    others = [name for name in stream.columns if name not in (*KEYS, "updated_at")]
    now = F.unix_micros(F.current_timestamp())
    # Of equal versions the one that came first counts.
    version = F.struct("updated_at", (-F.col("_arrived")).alias("_first"), *others)
    state = (
        stream.withColumn("_arrived", now)
        .groupBy(*KEYS)
        .agg(F.max(version).alias("_newest"), F.min("_arrived").alias("_since"))
    )
    fresh = state.where(F.col("_newest._first") == -now)
    return fresh.select(*[F.col(name) if name in KEYS else F.col(f"_newest.{name}") for name in stream.columns], (F.col("_since") < now).alias("edited"))


def _own_jobs(earlier: DataFrame) -> DataFrame:
    scheduled = earlier.where(F.col("disposition") == "schedule")
    return scheduled.select("repo", "pr", F.col("id").alias("comment_id"))


def route_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    rules: Sequence[RepoRules],
    users: Reader,
    jobs: Reader | None = None,
    replies: Reader | None = None,
) -> StreamingQuery:
    """Store a decision for every new comment and every edit, then stop.

    Which versions are new is kept as keyed state of the stream, in RocksDB, so a micro-batch
    costs the same however many came before. Stored decisions are read only in batches that
    hold an edit, which is a duplicate once the comment has a job. The rows of a micro-batch go to a
    folder of its own, which a repeated batch overwrites, so no decision is stored
    twice. The clock that stamps batches must not be set back.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Written once: the state is not computed again for each use.
        fresh, seen = new_path(spark, "fresh"), Observation()
        batch.observe(seen, F.count_if("edited").alias("edits")).write.parquet(fresh)
        batch = spark.read.schema(batch.schema).parquet(fresh)
        known = None if jobs is None else jobs(spark).select("repo", "pr", "comment_id")
        earlier = decided(spark, path, number) if seen.get["edits"] else None
        if earlier is not None:
            own = _own_jobs(earlier)
            known = own if known is None else known.unionByName(own)
        answers = None if replies is None else replies(spark)
        routed = route(batch.drop("edited"), rules, users(spark), known, answers)
        routed.write.mode("overwrite").parquet(f"{path}/batch={number}")
        remove(spark, fresh)

    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return (
            fresh_versions(stream)
            .writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def scheduled_jobs(routed: DataFrame, rules: Sequence[RepoRules]) -> DataFrame:
    """Command rows of the comments that start a job."""
    return job_rows(routed.where(routed["disposition"] == "schedule"), rules)
