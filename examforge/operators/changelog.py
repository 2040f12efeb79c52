"""Changelog: entries per day in encounter order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_day(entries: DataFrame, day: str, order: list[str], text: str) -> DataFrame:
    """(day, n, items): the day's entries in order."""
    g = entries.groupBy(day).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("l"))
    return g.select(day, F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x[text]), "\n").alias("items"))
