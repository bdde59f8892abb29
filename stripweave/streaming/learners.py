"""Streams: learning by key with kept state, live job status, and arriving files. Each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from stripweave.operators.dialogue import MENTION
from stripweave.streaming.state import ArmLearner, AttemptLearner, ChapterMemory, IdentityStream, keeps_state


def attempt_learner(attempts: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Preferred method of each domain after every batch of a stream of ``domain, ts, attempt_id, method, success, blocked``; within a
    batch attempts count in their order."""
    rows = attempts.select("domain", "ts", "attempt_id", "method", "success", "blocked")
    return keeps_state(rows, "domain", AttemptLearner(methods), AttemptLearner.SCHEMA)


def arm_learner(
    attempts: DataFrame, *, blocked_s: int = 3600, failing_s: int = 600, forget_s: int = 90 * 86_400
) -> DataFrame:
    """Per arm after every batch of ``arm, ts, attempt_id, success, blocked, duration``: requests, successes, moving average of latency,
    the end of its last cooldown, and whether that lasts; when it ends, a timer in processing time says so."""
    rows = attempts.select("arm", "ts", "attempt_id", "success", "blocked", "duration")
    return keeps_state(rows, "arm", ArmLearner(blocked_s, failing_s, forget_s), ArmLearner.SCHEMA, time="ProcessingTime")


def identity_stream(mentions: DataFrame) -> DataFrame:
    """The profile of every mention of a stream of ``series, chapter, block, name_hint, signature``, as ``identity_fold`` gives it for all
    at once, however chapters are spread over batches in their order."""
    rows = mentions.select("series", "chapter", "block", "name_hint", "signature")
    return keeps_state(rows, "series", IdentityStream(), MENTION, mode="Append")


def status_feed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Latest status and furthest progress per job and day; a watermark drops the state of past days."""
    day = F.window("ts", "1 day").alias("day")
    return events.withWatermark("ts", late).groupBy("job_id", day).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("progress").alias("progress"))


def series_memory(names: DataFrame) -> DataFrame:
    """Appearances, first and last chapter of every name in a stream of ``series, chapter, name``."""
    return names.groupBy("series", "name").agg(F.count("*").alias("appearances"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_seen"))


def chapter_memory(chapters: DataFrame, *, most: int = 30, recent: int = 20, older: int = 10) -> DataFrame:
    """The changes that a stream of chapters (``series, chapter, sent, names, dialogue_count, has_action``) makes to the memory of their
    series; ``sent`` rises with each sending of a chapter. ``keep_changes`` writes them, ``kept_chapters`` and ``kept_characters``
    read what holds. Other columns are ignored."""
    rows = chapters.filter(F.col("chapter").isNotNull()).select(
        F.col("series").cast("string").alias("series"), F.col("chapter").cast("long").alias("chapter"),
        F.coalesce(F.col("sent").cast("long"), F.lit(0)).alias("sent"), F.coalesce("names", F.array().cast("array<string>")).alias("names"),
        F.coalesce(F.col("dialogue_count").cast("long"), F.lit(0)).alias("dialogue_count"),
        F.coalesce("has_action", F.lit(False)).alias("has_action"),
    )
    return keeps_state(rows, "series", ChapterMemory(most, recent, older), ChapterMemory.SCHEMA)


def keep_changes(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes each batch of changes to a folder of its number: a batch that is done again after a failure takes its own place."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest_changes(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Of the changes at ``path`` the last of each key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_at", last).filter("_at = 1").drop("_at", "batch")


def kept_chapters(spark: SparkSession, path: str) -> DataFrame:
    rows = latest_changes(spark, path, ["series", "kind", "chapter", "name"]).filter("kind = 'chapter' AND kept")
    return rows.select("series", "chapter", "characters", "dialogue_count", "has_action")


def kept_characters(spark: SparkSession, path: str) -> DataFrame:
    rows = latest_changes(spark, path, ["series", "kind", "chapter", "name"]).filter("kind = 'character' AND kept")
    return rows.select("series", "name", "appearances", "first_chapter", "last_seen")


def page_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataStreamWriter:
    """New files of a folder, each path once, appended to a table as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", "length").dropDuplicates(["path"]).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append")


def missing_pages(wanted: DataFrame, arrived: DataFrame, keys: Sequence[str] = ("chapter", "seq"), valid: Column | None = None) -> DataFrame:
    """The batch twin: what has not arrived yet. Arrived files of which ``valid`` is not true do not count, so that their pages are asked for again."""
    if valid is not None:
        arrived = arrived.filter(valid)
    return wanted.join(arrived.select(*keys), list(keys), "left_anti")
