"""Attempt counts over a stream: windows with a watermark, and running counts per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examforge.functions import grading


def windowed_counts(attempts: DataFrame, late: str = "3 days", window: str = "1 day") -> DataFrame:
    """By user and window of answering: answered and correct attempts. Repeats of (session_id, pos) within the watermark
    count once; attempts logged later than that are left out."""
    once = attempts.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["session_id", "pos"])
    answered = once.where(grading.answered(F.col("user_answer")))
    w = answered.groupBy(F.window("answered_at", window).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct")).select(F.col("w.start").alias("start"), "user_id", "n", "n_correct")


def run_once(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drives a bounded stream to its end into a table of the session; for tests and small backfills."""
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return counts.sparkSession.table(name)
