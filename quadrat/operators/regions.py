"""Counts of boxes by region of the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import boxes as B


def region_counts(boxes: DataFrame, inside: Column, group: list[str]) -> DataFrame:
    """``n_boxes``, ``n_inside`` and ``fraction`` per group (of all rows, if ``group`` is empty)."""
    out = boxes.groupBy(*group).agg(F.count("*").alias("n_boxes"), F.count_if(inside).alias("n_inside"))
    return out.withColumn("fraction", F.col("n_inside") / F.when(F.col("n_boxes") > 0, F.col("n_boxes")))


def occupancy(points: DataFrame, x: str, y: str, bins: tuple[int, int]) -> DataFrame:
    """A 2-D histogram from the least to the greatest coordinates: ``(bin_x, bin_y, n)`` of bins with points.

    Points with a null or NaN coordinate don't count.
    """
    have = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(x, y)
    edge = have.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))  # one row
    placed = have.join(F.broadcast(edge), F.lit(True)).select(
        B.bin_number(F.col(x), F.col("x0"), F.col("x1"), bins[0]).alias("bin_x"),
        B.bin_number(F.col(y), F.col("y0"), F.col("y1"), bins[1]).alias("bin_y"),
    )
    return placed.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))
