"""Moment maps: a cube collapsed along its spectral axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import NAN, finite

KINDS = ("average", "integrated", "weighted_coordinate", "weighted_dispersion", "median", "median_coordinate", "standard_deviation", "rms", "abs_mean_deviation", "maximum", "maximum_coordinate", "minimum", "minimum_coordinate")


def coordinate(z: Column, start: float, step: float) -> Column:
    """World coordinate of a channel on a linear axis."""
    return F.lit(float(start)) + z * F.lit(float(step))


def selected(cube: DataFrame, include: tuple[float, float] | None = None, exclude: tuple[float, float] | None = None, channels: tuple[int, int] | None = None) -> DataFrame:
    """Finite pixels within the channel range and the pixel range to include, or outside that to exclude; ranges may be reversed."""
    v = F.col("v")
    out = cube.where(finite(v))
    if channels:
        out = out.where(F.col("z").between(*channels))
    if include:
        out = out.where(v.between(min(include), max(include)))
    if exclude:
        out = out.where(~v.between(min(exclude), max(exclude)))
    return out


def allowed(kinds: list[str], include: tuple[float, float] | None) -> list[str]:
    """The median coordinate needs a range to include that does not span zero."""
    ok = include is not None and min(include) * max(include) >= 0
    return [k for k in kinds if k != "median_coordinate" or ok]


def moments(cube: DataFrame, start: float = 0.0, step: float = 1.0, include: tuple[float, float] | None = None, exclude: tuple[float, float] | None = None, channels: tuple[int, int] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The moments asked for (of 13) per (stokes, y, x) with a selected pixel; the median coordinate only where it is allowed.

    The pixels of a line of sight are summed in one aggregate; those moments that need the mean or the running sum come
    from windows over the line of sight, which is as long as the cube is deep.
    """
    p = selected(cube, include, exclude, channels).select("stokes", "y", "x", "z", F.col("v").cast("double").alias("i"), coordinate(F.col("z"), start, step).alias("c"))
    line = Window.partitionBy("stokes", "y", "x")
    upto = line.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("i").over(line)
    p = p.withColumn("mean", F.avg("i").over(line)).withColumn("m1", F.sum(F.col("i") * F.col("c")).over(line) / F.when(whole != 0, whole)).withColumn("half", F.sum("i").over(upto) * 2 >= whole)
    i, c, n = F.col("i"), F.col("c"), F.count("*")
    s, q = F.sum("i"), F.sum(i * i)
    weight = F.when(s != 0, s)
    spread = F.sum(i * (c - F.col("m1")) * (c - F.col("m1"))) / weight
    out = p.groupBy("stokes", "y", "x").agg(
        (s / n).alias("average"),
        (s * abs(step)).alias("integrated"),
        (F.sum(i * c) / weight).alias("weighted_coordinate"),
        F.when(spread >= 0, F.sqrt(F.abs(spread))).alias("weighted_dispersion"),
        F.median("i").alias("median"),
        F.min(F.when(F.col("half"), c)).alias("median_coordinate"),
        F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))).alias("standard_deviation"),
        F.sqrt(q / n).alias("rms"),
        (F.sum(F.abs(i - F.col("mean"))) / n).alias("abs_mean_deviation"),
        F.max("i").alias("maximum"),
        F.min(F.struct((-i).alias("k"), c.alias("c")))["c"].alias("maximum_coordinate"),
        F.min("i").alias("minimum"),
        F.min(F.struct(i.alias("k"), c.alias("c")))["c"].alias("minimum_coordinate"),
    )
    return out.select("stokes", "y", "x", *[F.coalesce(k, F.lit(NAN)).alias(k) for k in allowed(list(kinds), include)])
