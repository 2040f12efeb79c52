"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark, with a checkpoint folder of its own; on a cluster the submitter makes
    the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("examforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="examforge-checkpoints-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder named in spark.checkpoint.dir; a folder of our own only in a single process where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[[^\]]*\])?$", context.master):  # local-cluster is a cluster
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "examforge-checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes the rows to the checkpoint folder and goes on from there: no lineage, and nothing is computed twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Marks a join side for broadcast if it has few rows (counted, up to the limit); else leaves it to be shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
