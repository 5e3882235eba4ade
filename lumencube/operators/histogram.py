"""Fixed-width histograms in float32 arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, float_bin


def auto_bins(width: int, height: int) -> int:
    return int(max(math.sqrt(width * height), 2))


def bounds(cube: DataFrame) -> tuple[float, float] | None:
    """Least and largest finite pixel: one small job."""
    lo, hi = cube.where(finite(F.col("v"))).agg(F.min("v"), F.max("v")).first()
    return None if lo is None else (lo, hi)


def histogram(cube: DataFrame, bins: int, limits: tuple[float, float] | None, *by: str) -> DataFrame:
    """bin, lower, center, count for every bin, empty ones too (per group, if `by` is given).

    A value counts if it lies within the limits, both included; the last bin holds the upper limit. Limits that hold
    nothing give one bin that counts zeros.
    """
    if limits is None or not limits[0] < limits[1]:
        limits, bins, width = (0.0, 0.0), 1, np.float32(0)
    else:
        width = np.float32((float(limits[1]) - float(limits[0])) / bins)
    low = np.float32(limits[0])
    as_float = lambda x: F.lit(float(x)).cast("float")
    inside = (F.col("v") >= as_float(low)) & (F.col("v") <= as_float(limits[1])) & finite(F.col("v"))
    at = float_bin(F.col("v"), as_float(low), as_float(width), bins) if width else F.lit(0)
    counts = cube.where(inside).withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = cube.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        groups = cube.select(*by).distinct()
        every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, [*by, "bin"], "left")
    lower = F.lit(float(low)) + F.col("bin") * F.lit(float(width))
    return out.select(*by, "bin", lower.alias("lower"), (lower + F.lit(float(width) / 2)).alias("center"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def merge_histograms(parts: DataFrame, *by: str) -> DataFrame:
    """Sum of histograms; refused unless all have the same bins."""
    grids = parts.groupBy("bin").agg(F.min("lower").alias("a"), F.max("lower").alias("b")).where("a <> b").limit(1).count()
    if grids:
        raise ValueError("histograms with different bins cannot be merged")
    return parts.groupBy(*by, "bin", "lower", "center").agg(F.sum("count").alias("count"))


def image_histogram(plane: DataFrame, width: int, height: int, bins: int | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """Histogram of one plane, with bins from its size and limits from its pixels unless given."""
    return histogram(plane, bins or auto_bins(width, height), limits or bounds(plane))


def cube_histogram(cube: DataFrame, width: int, height: int) -> DataFrame:
    """Histogram over all channels with the cube's own limits: one pass for these and one for the bins."""
    return histogram(cube, auto_bins(width, height), bounds(cube))
