"""Slices, spatial and spectral profiles, line profiles and position-velocity images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import NAN, finite, only_finite


def plane(cube: DataFrame, z: int = 0, stokes: int = 0) -> DataFrame:
    return cube.where((F.col("z") == z) & (F.col("stokes") == stokes))


def box(cube: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Pixels of an inclusive box, with its corner as origin."""
    part = cube.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return part.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def point_value(image: DataFrame, x: float, y: float) -> DataFrame:
    """Value at the rounded position (half away from zero); no row outside the image."""
    at = lambda c: int(math.copysign(math.floor(abs(c) + 0.5), c))
    return image.where((F.col("x") == at(x)) & (F.col("y") == at(y)))


def x_profile(image: DataFrame, y: int, start: int = 0, end: int = 0) -> DataFrame:
    """A row of pixels; end 0 means to the last."""
    p = image.where((F.col("y") == y) & (F.col("x") >= start))
    return (p.where(F.col("x") < end) if end else p).select("x", "v")


def y_profile(image: DataFrame, x: int, start: int = 0, end: int = 0) -> DataFrame:
    p = image.where((F.col("x") == x) & (F.col("y") >= start))
    return (p.where(F.col("y") < end) if end else p).select("y", "v")


def z_profile(cube: DataFrame, x: int, y: int, stokes: int = 0) -> DataFrame:
    return cube.where((F.col("x") == x) & (F.col("y") == y) & (F.col("stokes") == stokes)).select("z", "v")


def decimate(profile: DataFrame, position: str, mip: int) -> DataFrame:
    """Two values per window of 2 * mip samples: its least and its largest finite value, in the order in which they stand."""
    w = profile.withColumn("window", F.floor(F.col(position) / (2 * mip)).cast("int"))
    v = only_finite(F.col("v"))
    lo = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(position).alias("p"))))
    hi = F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col(position).alias("p"))))
    g = w.groupBy("window").agg(lo.alias("lo"), hi.alias("hi"))
    nan = F.lit(NAN).cast("float")
    a, b = F.coalesce("lo.v", nan), F.coalesce(-F.col("hi.v"), nan)
    forward = F.coalesce(F.col("lo.p") <= F.col("hi.p"), F.lit(True))
    pair = F.array(F.when(forward, a).otherwise(b), F.when(forward, b).otherwise(a))
    return g.select("window", F.posexplode(pair).alias("k", "v")).select((F.col("window") * 2 + F.col("k")).alias("i"), "v")


def line_boxes(points: list[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """(x, y, angle) of boxes one pixel apart along a line or polyline.

    A line has its middle box at its centre and as many on either side; a polyline starts at its first vertex, and the
    first box of a segment is left out when it lies nearer than half a pixel to the last of the segment before.
    """
    out: list[tuple[float, float, float]] = []
    if len(points) == 2:
        (ax, ay), (bx, by) = points
        length = math.hypot(bx - ax, by - ay)
        angle = math.atan2(by - ay, bx - ax)
        n = max(math.floor((length - 1) / 2 + 0.5), 0)
        cx, cy = (ax + bx) / 2, (ay + by) / 2
        return [(cx + k * math.cos(angle), cy + k * math.sin(angle), angle) for k in range(-n, n + 1)]
    for (ax, ay), (bx, by) in zip(points[:-1], points[1:], strict=True):
        angle = math.atan2(by - ay, bx - ax)
        for k in range(math.floor(math.hypot(bx - ax, by - ay) + 0.5) + 1):
            x, y = ax + k * math.cos(angle), ay + k * math.sin(angle)
            if k == 0 and out and math.hypot(x - out[-1][0], y - out[-1][1]) < 0.5:
                continue
            out.append((x, y, angle))
    return out


def is_linear(separations: list[float], pixel: float) -> bool:
    """Whether steps along a line differ by at most a hundredth of a pixel's size, so that pixel spacing will do."""
    return not separations or max(separations) - min(separations) <= 0.01 * pixel


def box_pixels(spark: SparkSession, points: list[tuple[float, float]], width: int) -> DataFrame:
    """(box, x, y) of the pixels whose centres lie in the boxes of a line: `width` across, 1 along (3 if oblique).

    The table grows with the length of a line drawn on an image, not with the data.
    """
    rows = []
    for i, (cx, cy, angle) in enumerate(line_boxes(points)):
        straight = abs(math.sin(angle)) < 1e-9 or abs(math.cos(angle)) < 1e-9
        along = 0.5 if straight else 1.5
        reach = math.ceil(width / 2 + 2)
        for x in range(math.floor(cx) - reach, math.ceil(cx) + reach + 1):
            for y in range(math.floor(cy) - reach, math.ceil(cy) + reach + 1):
                u = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle)
                w = (y - cy) * math.cos(angle) - (x - cx) * math.sin(angle)
                if -along - 1e-9 <= u < along - 1e-9 and -width / 2 - 1e-9 <= w < width / 2 - 1e-9:
                    rows.append((i, x, y))
    return spark.createDataFrame(rows, "box int, x int, y int")


def pv_image(cube: DataFrame, points: list[tuple[float, float]], width: int = 1, reverse: bool = False) -> DataFrame:
    """Position-velocity image: mean of the finite pixels per box along the line and channel, as (x, y, v)."""
    boxes = box_pixels(cube.sparkSession, points, width)
    lo = boxes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    near = cube.where(F.col("x").between(lo[0], lo[1]) & F.col("y").between(lo[2], lo[3]))
    got = near.join(F.broadcast(boxes), ["x", "y"]).groupBy("box", "z").agg(F.avg(only_finite(F.col("v")).cast("double")).alias("m"))
    a, b = ("z", "box") if reverse else ("box", "z")
    return got.select(F.col(a).alias("x"), F.col(b).alias("y"), F.coalesce("m", F.lit(NAN)).alias("v"))


def line_profile(image: DataFrame, points: list[tuple[float, float]], width: int = 1) -> DataFrame:
    """Mean per box along a line or polyline: (box, v)."""
    return pv_image(image.withColumn("z", F.lit(0)), points, width).select(F.col("x").alias("box"), "v")


def preview_cube(cube: DataFrame, depth: int, rebin_xy: int, rebin_z: int) -> DataFrame:
    """Block means in the plane, then plain means over groups of channels.

    Over channels NaN spreads, and an incomplete last group is left NaN.
    """
    xy = cube.groupBy("stokes", "z", F.floor(F.col("y") / rebin_xy).cast("int").alias("y"), F.floor(F.col("x") / rebin_xy).cast("int").alias("x")).agg(F.avg(only_finite(F.col("v")).cast("double")).alias("m"))
    nan = F.lit(NAN)
    whole = (F.col("z") + 1) * rebin_z <= depth
    z = xy.withColumn("z", F.floor(F.col("z") / rebin_z).cast("int")).groupBy("stokes", "z", "y", "x").agg(F.avg(F.coalesce("m", nan)).alias("m"))
    return z.select("stokes", "z", "y", "x", F.when(whole, F.col("m")).otherwise(nan).alias("v"))


def finite_pixels(cube: DataFrame) -> DataFrame:
    return cube.where(finite(F.col("v")))
