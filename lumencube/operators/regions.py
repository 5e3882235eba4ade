"""Regions: validated shapes that compile to a predicate on pixel coordinates.

A pixel belongs to a closed region if its centre lies inside or on the edge. The predicate carries the bounding box, so
Parquet statistics can skip what lies outside, and needs no mask table and no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .histogram import auto_bins, bounds, histogram

CLOSED = ("rectangle", "ellipse", "polygon")
LINES = ("line", "polyline")
EDGE = 1e-9


@dataclass(frozen=True)
class Region:
    """kind: point, line, polyline, rectangle, ellipse, polygon, or an annotation (ann_...).

    Points: rectangle centre and (width, height); ellipse centre and semi-axes (the first lies along y); otherwise
    vertices. Rotation in degrees, counter-clockwise.
    """

    kind: str
    points: tuple[tuple[float, float], ...]
    rotation: float = 0.0

    def check(self) -> None:
        if self.kind.startswith("ann_"):
            raise ValueError("annotations have no analytics")
        need = {"point": (1, 1), "line": (2, 2), "polyline": (2, 10**6), "rectangle": (2, 2), "ellipse": (2, 2), "polygon": (3, 10**6)}
        if self.kind not in need:
            raise ValueError(f"unknown region {self.kind}")
        lo, hi = need[self.kind]
        if not lo <= len(self.points) <= hi:
            raise ValueError(f"{self.kind} has {len(self.points)} points")
        if not all(math.isfinite(c) for p in self.points for c in p):
            raise ValueError("points must be finite")
        if self.kind in ("rectangle", "ellipse") and not all(c > 0 for c in self.points[1]):
            raise ValueError("sizes must be positive")

    def corners(self) -> list[tuple[float, float]]:
        """Vertices of a rectangle or polygon."""
        if self.kind == "polygon":
            return list(self.points)
        (cx, cy), (w, h) = self.points
        a = math.radians(self.rotation)
        ca, sa = math.cos(a), math.sin(a)
        return [(cx + ca * dx - sa * dy, cy + sa * dx + ca * dy) for dx, dy in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]

    def box(self) -> tuple[int, int, int, int]:
        """Inclusive pixel box x0, y0, x1, y1 that holds the region."""
        if self.kind == "point":
            x, y = (math.floor(c + 0.5) for c in self.points[0])
            return x, y, x, y
        if self.kind == "ellipse":
            (cx, cy), (a, b) = self.points
            r = math.radians(self.rotation)
            dx, dy = math.hypot(a * math.sin(r), b * math.cos(r)), math.hypot(a * math.cos(r), b * math.sin(r))
            xs, ys = (cx - dx, cx + dx), (cy - dy, cy + dy)
        else:
            xs, ys = zip(*self.corners(), strict=True)
        return math.ceil(min(xs) - EDGE), math.ceil(min(ys) - EDGE), math.floor(max(xs) + EDGE), math.floor(max(ys) + EDGE)

    def predicate(self, x: Column | None = None, y: Column | None = None) -> Column:
        self.check()
        if self.kind in LINES:
            raise ValueError("lines have no mask; use profiles")
        x, y = x if x is not None else F.col("x"), y if y is not None else F.col("y")
        x0, y0, x1, y1 = self.box()
        inside = x.between(x0, x1) & y.between(y0, y1)
        if self.kind == "ellipse":
            (cx, cy), (a, b) = self.points
            r = math.radians(self.rotation)
            u = (x - cx) * math.cos(r) + (y - cy) * math.sin(r)
            w = (y - cy) * math.cos(r) - (x - cx) * math.sin(r)
            return inside & ((u / b) * (u / b) + (w / a) * (w / a) <= 1 + EDGE)
        if self.kind == "point" or (self.kind == "rectangle" and self.rotation == 0):
            return inside
        return inside & _in_polygon(self.corners(), x, y)


def _in_polygon(vertices: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Odd number of edges to the right of the centre, or the centre on an edge."""
    crossings, on_edge = [], []
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        length = math.hypot(bx - ax, by - ay)
        near = (F.abs(cross) <= EDGE * max(1.0, length)) & x.between(min(ax, bx) - EDGE, max(ax, bx) + EDGE) & y.between(min(ay, by) - EDGE, max(ay, by) + EDGE)
        on_edge.append(near)
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings.append(F.when(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0))
    odd = reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1
    return odd | reduce(lambda a, b: a | b, on_edge)


def masked(cube: DataFrame, region: Region) -> DataFrame:
    return cube.where(region.predicate())


def region_stats(cube: DataFrame, region: Region, *by: str) -> DataFrame:
    """Basic statistics within a region; no pixels: NaN and a count of 0."""
    return stats.basic_stats(masked(cube, region), *by)


def region_histogram(plane: DataFrame, region: Region, bins: int | None = None) -> DataFrame:
    """Histogram within a region; automatic bins from its bounding box."""
    x0, y0, x1, y1 = region.box()
    part = masked(plane, region)
    return histogram(part, bins or auto_bins(x1 - x0 + 1, y1 - y0 + 1), bounds(part))


def spectral_profile(cube: DataFrame, region: Region, depth: int) -> DataFrame:
    """Statistics per channel within a region, channels without pixels included."""
    got = stats.partial_stats(masked(cube, region), "z")
    z = cube.sparkSession.range(depth).select(F.col("id").cast("int").alias("z"))
    return stats.derived(z.join(got, "z", "left").withColumn("num_pixels", F.coalesce("num_pixels", F.lit(0))))


def record(region: Region) -> tuple[str, list[tuple[float, float]]]:
    """(shape, points) as analysis code takes a region: points and rectangles as boxes and polygons, ellipses as ellipsoids.

    An ellipsoid's first axis is the longer one; where that swaps the axes, the angle turns by 90 degrees. Its points are
    centre, axes and (angle, 0).
    """
    region.check()
    if region.kind == "point":
        return "box", [region.points[0], region.points[0]]
    if region.kind in ("rectangle", "polygon"):
        return "polygon", region.corners()
    if region.kind == "ellipse":
        centre, (a, b) = region.points
        swap = b > a
        return "ellipsoid", [centre, (max(a, b), min(a, b)), ((region.rotation + 90 * (not swap)) % 360, 0.0)]
    return region.kind, list(region.points)


# Tables of regions: rows of (kind, points array<struct<x double, y double>>, rotation double), worked on as columns.


def accepted(kind: Column, points: Column) -> Column:
    """Whether a region of a table is one that Region.check() accepts; null kinds and points are not."""
    n = F.size(points)
    sizes = F.try_element_at(points, F.lit(2))
    right = F.when(kind == "point", n == 1).when(kind == "line", n == 2).when(kind == "polyline", n.between(2, 10**6)).when(kind == "polygon", n.between(3, 10**6)).when(kind.isin("rectangle", "ellipse"), (n == 2) & (sizes["x"] > 0) & (sizes["y"] > 0)).otherwise(False)
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(right & F.forall(points, lambda p: number(p["x"]) & number(p["y"])), F.lit(False))


def corner_points(kind: Column, points: Column, rotation: Column) -> Column:
    """The vertices of rectangles and polygons of a table, null for other regions."""
    a, c, s = F.radians(rotation), F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(2))
    turned = lambda i, j: F.struct((c["x"] + F.cos(a) * s["x"] * i / 2 - F.sin(a) * s["y"] * j / 2).alias("x"), (c["y"] + F.sin(a) * s["x"] * i / 2 + F.cos(a) * s["y"] * j / 2).alias("y"))
    return F.when(kind == "rectangle", F.array(*[turned(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])).when(kind == "polygon", points)


def records(kind: Column, points: Column, rotation: Column) -> Column:
    """struct(shape, points) as record() gives it, for the accepted regions of a table; null for others."""
    c, s = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(2))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    turn = F.pmod(rotation + F.when(s["y"] > s["x"], 0.0).otherwise(90.0), F.lit(360.0))
    shape = F.when(kind == "point", "box").when(kind.isin("rectangle", "polygon"), "polygon").when(kind == "ellipse", "ellipsoid").otherwise(kind)
    held = F.when(kind == "point", F.array(c, c)).when(kind.isin("rectangle", "polygon"), corner_points(kind, points, rotation)).when(kind == "ellipse", F.array(c, pair(F.greatest(s["x"], s["y"]), F.least(s["x"], s["y"])), pair(turn, F.lit(0.0)))).otherwise(points)
    return F.when(accepted(kind, points), F.struct(shape.alias("shape"), held.alias("points")))
