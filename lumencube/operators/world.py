"""World coordinates: linear axes and the gnomonic (TAN) projection, as column expressions and for single points."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regions import Region

#: Vertices of the polygon that stands for an ellipse or rectangle mapped to another image.
VERTICES = 1000


@dataclass(frozen=True)
class Grid:
    """Two axes of an image: reference pixel (0-based), its world coordinates and increments in degrees; kind: linear or TAN."""

    pixel: tuple[float, float]
    value: tuple[float, float]
    step: tuple[float, float]
    kind: str = "TAN"

    def _to_world(self, x, y, f):
        u, v = (x - self.pixel[0]) * self.step[0], (y - self.pixel[1]) * self.step[1]
        if self.kind == "linear":
            return u + self.value[0], v + self.value[1]
        xi, eta = u * (math.pi / 180), v * (math.pi / 180)
        d0 = math.radians(self.value[1])
        along = math.cos(d0) - eta * math.sin(d0)
        turn = f.atan2(xi, along) * (180 / math.pi) + self.value[0]
        return turn, f.atan2(eta * math.cos(d0) + math.sin(d0), f.hypot(xi, along)) * (180 / math.pi)

    def _to_pixel(self, a, d, f):
        if self.kind == "linear":
            return (a - self.value[0]) / self.step[0] + self.pixel[0], (d - self.value[1]) / self.step[1] + self.pixel[1]
        turn, d, d0 = (a - self.value[0]) * (math.pi / 180), d * (math.pi / 180), math.radians(self.value[1])
        near = f.sin(d) * math.sin(d0) + f.cos(d) * f.cos(turn) * math.cos(d0)
        xi, eta = f.cos(d) * f.sin(turn) / near, (f.sin(d) * math.cos(d0) - f.cos(d) * f.cos(turn) * math.sin(d0)) / near
        return xi * (180 / math.pi) / self.step[0] + self.pixel[0], eta * (180 / math.pi) / self.step[1] + self.pixel[1]

    def world(self, x: Column, y: Column) -> tuple[Column, Column]:
        """World coordinates of pixels, in degrees."""
        return self._to_world(x.cast("double"), y.cast("double"), F)

    def pixels(self, a: Column, d: Column) -> tuple[Column, Column]:
        return self._to_pixel(a.cast("double"), d.cast("double"), F)

    def world_of(self, point: tuple[float, float]) -> tuple[float, float]:
        return self._to_world(*point, math)

    def pixel_of(self, point: tuple[float, float]) -> tuple[float, float]:
        return self._to_pixel(*point, math)


def separation(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Degrees between two directions."""
    (ra, da), (rb, db) = ((math.radians(c) for c in p) for p in (a, b))
    h = math.sin((db - da) / 2) ** 2 + math.cos(da) * math.cos(db) * math.sin((rb - ra) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


def outline(region: Region, vertices: int = VERTICES) -> list[tuple[float, float]]:
    """Points along the edge of a closed region."""
    if region.kind == "ellipse":
        (cx, cy), (a, b) = region.points
        r = math.radians(region.rotation)
        turns = (2 * math.pi * k / vertices for k in range(vertices))
        return [(cx + b * math.cos(t) * math.cos(r) - a * math.sin(t) * math.sin(r), cy + b * math.cos(t) * math.sin(r) + a * math.sin(t) * math.cos(r)) for t in turns]
    corners = region.corners()
    each = max(1, vertices // len(corners))
    pairs = zip(corners, corners[1:] + corners[:1], strict=True)
    return [(ax + (bx - ax) * k / each, ay + (by - ay) * k / each) for (ax, ay), (bx, by) in pairs for k in range(each)]


def matched(region: Region, own: Grid, other: Grid) -> Region:
    """A region of one image as a region of another that shows the same sky.

    Points, lines and polygons keep their vertices; between linear axes so do rectangles. All else becomes a polygon of
    about VERTICES points along the edge, which a projection bends.
    """
    region.check()
    move = lambda points: tuple(other.pixel_of(own.world_of(p)) for p in points)
    if region.kind in ("point", "line", "polyline", "polygon"):
        return Region(region.kind, move(region.points))
    if region.kind == "rectangle" and own.kind == other.kind == "linear":
        return Region("polygon", move(region.corners()))
    return Region("polygon", move(outline(region)))


def angular_steps(points: tuple[tuple[float, float], tuple[float, float]], grid: Grid, step: float) -> list[tuple[float, float]]:
    """Pixel positions along a line at equal angular distances, each found by halving, to a hundredth of a step."""
    (ax, ay), (bx, by) = points
    at = lambda t: (ax + (bx - ax) * t, ay + (by - ay) * t)
    out, t = [points[0]], 0.0
    while True:
        here = grid.world_of(at(t))
        if separation(here, grid.world_of(at(1.0))) < step * 0.99:
            return out
        low, high = t, 1.0
        while high - low > 1e-12:
            middle = (low + high) / 2
            apart = separation(here, grid.world_of(at(middle)))
            if abs(apart - step) <= 0.01 * step:
                break
            low, high = (middle, high) if apart < step else (low, middle)
        t = (low + high) / 2
        out.append(at(t))
