"""Structured Streaming over an event log. An extension: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "session string, seq long, ts timestamp, step string, status string, reason string"


def read_journal(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of JSON lines from a folder of logs; broken lines are left out."""
    raw = spark.readStream.schema(SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken")
    raw = raw.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).json(path)
    return raw.filter("_broken is null").drop("_broken")


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, stage, ran, skipped)`` by event-time window; events later than the watermark are dropped."""
    skipped = F.col("status") == "skipped"
    e = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("step").alias("stage"))
    out = e.agg(F.count_if(~skipped).alias("ran"), F.count_if(skipped).alias("skipped"))
    return out.select(F.col("w.start").alias("start"), "stage", "ran", "skipped")


def run_batches(events: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``each``, until all files that are there have been read."""
    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
