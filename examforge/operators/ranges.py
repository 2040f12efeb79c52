"""Range joins, as equi-joins: integer ranges by explosion, rectangles by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_by_range(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of ranges met with the points they cover (ends included). Ranges are expanded into their numbers; reversed
    or null ranges cover nothing."""
    r = ranges.where(F.col(first) <= F.col(last)).withColumn(point, F.explode(F.sequence(F.col(first), F.col(last))))
    return points.join(r, [*(keys or []), point])


def intersecting(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id) of open rectangles (x0, y0, x1, y1) that overlap. Both sides are put into the grid cells they touch;
    a pair is reported in the first cell it shares, so nothing has to be deduplicated."""

    def celled(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("bigint"), F.floor(F.col(hi) / cell).cast("bigint"))
        df = df.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
        df = df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
        return df.select("cx", "cy", F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")])

    met = celled(a, "a").join(celled(b, "b"), ["cx", "cy"])
    overlap = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    here = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    return met.where(overlap & here).select("a_id", "b_id")


def union_boxes(rects: DataFrame, by: str) -> DataFrame:
    """Bounding box of each group, and its largest member (ties by id)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rects.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max_by("id", F.struct(area, -F.col("id"))).alias("largest"))
