"""Contours: crossings of a level as relations, and whole ordered lines of images of any size.

An image is cut into pieces, and a task traces one piece: every cell of four pixels gives directed segments between its
crossed sides, what lies above the level on their left, and segments that follow each other form fragments. A line runs
on in the next piece from the very side at which a fragment ends. So fragments are joined at their ends, and a list
ranking by pointer jumping gives each one its place in its line: the number of joins is the logarithm of the number of
fragments of the longest line, and no task ever holds a whole one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import finite
from ..scratch import stored

#: Pixels along the side of a piece that one task traces.
PIECE = 512
FRAGMENT = "level double, first long, last long, n int, low long, low_at int, x array<double>, y array<double>, end_x double, end_y double"


def crossings(image: DataFrame, level: float) -> DataFrame:
    """side, x, y, at: where a level lies between a finite pixel and its finite neighbour to the right (x) or above (y)."""
    p = image.where(finite(F.col("v"))).select("x", "y", F.col("v").cast("double").alias("v"))
    out = []
    for side, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(other).orderBy(side)
        near = p.withColumn("next", F.when(F.lead(side).over(w) == F.col(side) + 1, F.lead("v").over(w)))
        cut = near.where((F.col("v") >= level) != (F.col("next") >= level))
        out.append(cut.select(F.lit(side).alias("side"), "x", "y", (F.col(side) + (level - F.col("v")) / (F.col("next") - F.col("v"))).alias("at")))
    return out[0].unionByName(out[1])


def side_id(kind, x, y):
    """A number for the side from pixel (x, y) to its right (kind 0) or upper (kind 1) neighbour; order by y, x, kind."""
    return (y << 33) | (x << 1) | kind


def segments(data: np.ndarray, level: float, x0: int = 0, y0: int = 0):
    """Directed segments of a level through a block of pixels whose first one is (x0, y0): start and end sides, start and end points.

    NaN lies below every level; saddles are decided by the mean of the four pixels. Every side starts at most one segment and
    ends at most one.
    """
    a = np.where(np.isfinite(data), data, -np.finfo(np.float32).max).astype(np.float64)
    above = a >= level
    code = above[:-1, :-1] + above[:-1, 1:] * 2 + above[1:, 1:] * 4 + above[1:, :-1] * 8
    y, x = np.nonzero((code > 0) & (code < 15))
    code = code[y, x]
    joined = (a[y, x] + a[y, x + 1] + a[y + 1, x] + a[y + 1, x + 1]) / 4 >= level
    # Round a cell against the clock the sides are bottom, right, top and left; a segment starts where that way goes down.
    corner = np.stack([code & 1, code >> 1 & 1, code >> 2 & 1, code >> 3 & 1], axis=1).astype(bool)
    following = np.roll(corner, -1, axis=1)
    starts, ends = corner & ~following, ~corner & following
    cell, start = np.nonzero(starts)
    # In a saddle, the end is the next side where the high corners are joined, else the side before.
    saddle = starts.sum(1)[cell] == 2
    step = np.where(joined[cell], 1, 3)
    end = np.where(saddle, (start + step) % 4, np.argmax(ends[cell], axis=1))

    def places(side):
        kind, cx, cy = side % 2, x[cell] + (side == 1), y[cell] + (side == 2)
        low, high = a[cy, cx], a[cy + (kind == 1), cx + (kind == 0)]
        t = (level - low) / (high - low)
        return side_id(kind, (cx + x0).astype(np.int64), (cy + y0).astype(np.int64)), cx + x0 + t * (kind == 0), cy + y0 + t * (kind == 1)

    return places(start), places(end)


def rank_lists(first: np.ndarray, last: np.ndarray):
    """For links first -> last (each value at most once on either side): number of the list's head link, place in the list.

    The head of a ring is the link with the smallest first value. Pointer jumping, as _ranked() does with joins.
    """
    n = len(first)
    order = np.argsort(last)
    at = np.minimum(np.searchsorted(last[order], first), n - 1)
    before = np.where(last[order][at] == first, order[at], np.arange(n))
    # The least first value within reach; links that never reach the start of a list lie on rings.
    jump, least = before.copy(), first.copy()
    for _ in range(n.bit_length()):
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    ring = before[jump] != jump
    before = np.where(ring & (first == least), np.arange(n), before)
    jump, place = before.copy(), (before != np.arange(n)).astype(np.int64)
    for _ in range(n.bit_length()):
        place += place[jump]
        jump = jump[jump]
    return jump, place


def trace(data: np.ndarray, level: float, x0: int = 0, y0: int = 0) -> list[tuple]:
    """Fragments of a level in a block: first and last side, links, smallest side and its place, x and y of the vertices, end point."""
    if min(data.shape) < 2:
        return []
    (first, x, y), (last, end_x, end_y) = segments(data, level, x0, y0)
    if not len(first):
        return []
    head, place = rank_lists(first, last)
    order = np.lexsort((place, first[head]))
    first, last, x, y, end_x, end_y, head = (c[order] for c in (first, last, x, y, end_x, end_y, head))
    edge = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True])
    out = []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        low = int(np.argmin(first[lo:hi]))
        out.append((int(first[lo]), int(last[hi - 1]), int(hi - lo), int(first[lo + low]), low, x[lo:hi], y[lo:hi], float(end_x[hi - 1]), float(end_y[hi - 1])))
    return out


def fragments(image: DataFrame, levels: list[float], piece: int = PIECE) -> DataFrame:
    """What each piece holds of the lines, one row per fragment; pieces share the pixels of their borders, but no cell."""
    corner = lambda c, k: F.floor((F.col(c) - k) / piece).cast("int")
    mine = F.array_distinct(F.array(*[F.struct(corner("x", dx).alias("px"), corner("y", dy).alias("py")) for dx in (0, 1) for dy in (0, 1)]))
    pieces = image.select("x", "y", "v", F.explode(mine).alias("p")).where("p.px >= 0 and p.py >= 0").select("x", "y", "v", "p.px", "p.py")

    def run(t: pa.Table) -> pa.Table:
        ox, oy = t.column("px")[0].as_py() * piece, t.column("py")[0].as_py() * piece
        x, y = t.column("x").to_numpy() - ox, t.column("y").to_numpy() - oy
        data = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        data[y, x] = t.column("v").to_numpy()
        rows = [(lv, *f) for lv in levels for f in trace(data, lv, ox, oy)]
        kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64())
        return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(("level", "first", "last", "n", "low", "low_at", "x", "y", "end_x", "end_y"))})

    return pieces.groupBy("px", "py").applyInArrow(run, FRAGMENT)


def _jumped(rows: DataFrame, out: Column, **more: Column) -> DataFrame:
    """rows with to replaced by what the row it points to points to (null: the end), and columns made from both rows; other: that row."""
    other = rows.select(F.col("level").alias("level_"), F.struct(*rows.columns).alias("other"))
    met = rows.join(other, (F.col("to") == F.col("other.id")) & (F.col("level") == F.col("level_")), "left")
    return met.select(*[more.get(c, out if c == "to" else F.col(c)).alias(c) for c in rows.columns])


def _ranked(links: DataFrame) -> DataFrame:
    """level, first, head, place, ring: the list that each fragment is in, the links before it, and whether the list is closed.

    links: level, first, last, n (links of the fragment). Fragments of one list are found by doubling: each round joins what
    a row points to with what that one points to. Rings are those rows whose pointers never come to an end; they are cut
    at their smallest side.
    """
    before = links.select(F.col("level").alias("level_"), F.col("last").alias("meets"), F.col("first").alias("to"), F.col("n").alias("step"))
    rows = links.select("level", F.col("first").alias("id")).join(before, (F.col("id") == F.col("meets")) & (F.col("level") == F.col("level_")), "left").select("level", "id", "to", F.coalesce("step", F.lit(0)).cast("long").alias("step"))
    rows = stored(rows, "links")
    least = stored(rows.select("level", "id", "to", F.col("id").alias("least")), "rings")
    open_rows, changed = -1, 1
    while True:
        after = least.withColumn("was", F.col("least"))
        after = stored(_jumped(after, F.col("other.to"), least=F.least("least", "other.least")), "rings")
        left, moved = after.where("to is not null").agg(F.count("*"), F.count_if(F.col("least") != F.col("was"))).first()
        least = after.drop("was")
        if left == open_rows and not (changed or moved):
            break
        if not left:
            break
        open_rows, changed = left, moved
    rings = least.where("to is not null").select(F.col("level").alias("level_"), F.col("id").alias("id_"), "least")
    rows = rows.join(rings, (F.col("id") == F.col("id_")) & (F.col("level") == F.col("level_")), "left")
    head = F.col("to").isNull() | F.col("least").eqNullSafe(F.col("id"))
    rows = rows.select("level", "id", F.when(~head, F.col("to")).otherwise(F.col("id")).alias("to"), F.when(~head, F.col("step")).otherwise(F.lit(0)).alias("step"), F.col("least").isNotNull().alias("ring"))
    rows = stored(rows, "ranks")
    while True:
        after = rows.withColumn("was", F.col("to"))
        after = stored(_jumped(after, F.col("other.to"), step=F.col("step") + F.col("other.step")), "ranks")
        rows = after.drop("was")
        if after.where("to != was").isEmpty():
            return rows.select("level", F.col("id").alias("first"), F.col("to").alias("head"), F.col("step").alias("place"), "ring")


def contours(image: DataFrame, levels: list[float], scale: float = 1.0, offset: float = 0.0, piece: int = PIECE) -> DataFrame:
    """level, line, i, x, y: ordered vertices of whole lines, scaled and shifted.

    line: the number of the side at which a line starts (side_id). A closed line starts and ends at its smallest side, an open
    one runs from border to border; what lies above the level is on the left of either. The result is the same for every
    size of piece.
    """
    found = stored(fragments(image, levels, piece), "fragments")
    slim = found.select("level", "first", "last", "n", "low", "low_at")
    alone = slim.where("first = last").select("level", "first", F.col("first").alias("head"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("ring"))
    ranked = stored(alone.unionByName(_ranked(slim.where("first != last"))), "ranked")
    start = F.min(F.struct("low", (F.col("place") + F.col("low_at")).alias("at")))
    lines = slim.join(ranked, ["level", "first"]).groupBy("level", "head").agg(F.sum("n").alias("total"), start.alias("start"))
    rows = found.join(ranked, ["level", "first"]).join(lines, ["level", "head"])
    line = F.when(F.col("ring"), F.col("start.low")).otherwise(F.col("head"))
    at = F.col("place") + F.col("k")
    turned = F.pmod(at - F.col("start.at"), F.col("total"))
    last = ~F.col("ring") & (F.col("place") + F.col("n") == F.col("total"))
    xs, ys = (F.when(last, F.concat(c, F.array(f"end_{c}"))).otherwise(F.col(c)).alias(c) for c in "xy")
    points = rows.select("level", line.alias("line"), "ring", "place", "total", "start", F.posexplode(F.arrays_zip(xs, ys)).alias("k", "p"))
    index = F.when(~F.col("ring"), F.array(at)).when(turned == 0, F.array(turned, F.col("total"))).otherwise(F.array(turned))
    return points.select("level", "line", F.explode(index).alias("i"), *[(F.col(f"p.{c}") * scale + offset).alias(c) for c in "xy"])
