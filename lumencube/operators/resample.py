"""Down-sampling, tiles, smoothing and encodings of images."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import NAN, join_same, only_finite
from .tiles import SIDE, by_tiles

TILE = 256
#: Places of an order that one task scans.
BLOCK = 1 << 16


def block_mean(image: DataFrame, mip: int, *by: str) -> DataFrame:
    """Mean of the finite pixels of each mip x mip block, partial blocks at the edges; NaN where there are none."""
    got = image.groupBy(*by, F.floor(F.col("y") / mip).cast("int").alias("y"), F.floor(F.col("x") / mip).cast("int").alias("x")).agg(F.avg(only_finite(F.col("v")).cast("double")).alias("v"))
    return got.withColumn("v", F.coalesce("v", F.lit(NAN)))


def nearest(image: DataFrame, mip: int) -> DataFrame:
    """Every mip-th pixel."""
    part = image.where((F.col("x") % mip == 0) & (F.col("y") % mip == 0))
    return part.withColumn("x", F.floor(F.col("x") / mip).cast("int")).withColumn("y", F.floor(F.col("y") / mip).cast("int"))


def mip_sums(image: DataFrame, mip: int, *by: str) -> DataFrame:
    """A materialisable mip: sums and counts, from which every multiple of it follows exactly."""
    v = only_finite(F.col("v")).cast("double")
    return image.groupBy(*by, F.floor(F.col("y") / mip).cast("int").alias("y"), F.floor(F.col("x") / mip).cast("int").alias("x")).agg(F.sum(v).alias("s"), F.count(v).alias("n"))


def from_mip(sums: DataFrame, stored: int, mip: int, *by: str) -> DataFrame:
    """Block means of a mip from stored sums of a divisor of it."""
    if mip % stored:
        raise ValueError("the stored mip must divide the one asked for")
    k = mip // stored
    got = sums.groupBy(*by, F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")).agg((F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("v"))
    return got.withColumn("v", F.coalesce("v", F.lit(NAN)))


def best_divisor(stored: list[int], mip: int) -> int:
    """The largest stored mip that divides the one asked for; 1 if none."""
    return max((m for m in stored if mip % m == 0), default=1)


def encode_tile(layer: Column, x: Column, y: Column) -> Column:
    """32-bit tile id of layer, x and y; -1 if out of range."""
    side = F.pow(F.lit(2), layer).cast("long")
    ok = layer.between(0, 12) & (x >= 0) & (y >= 0) & (x < side) & (y < side)
    return F.when(ok, layer * (1 << 24) + y * (1 << 12) + x).otherwise(F.lit(-1)).cast("int")


def decode_tile(code: Column) -> tuple[Column, Column, Column]:
    """layer, x, y of a tile id; all -1 for an id that none has."""
    ok = code >= 0
    part = lambda c: F.when(ok, c).otherwise(F.lit(-1)).cast("int")
    return part(F.floor(code / (1 << 24))), part(code % (1 << 12)), part(F.floor(code / (1 << 12)) % (1 << 12))


def layer_of_mip(mip: int, width: int, height: int, tile: int = TILE) -> int:
    """The layer whose tiles show the image at a mip: 0 is the coarsest, a single tile."""
    whole = math.ceil(math.log2(max(math.ceil(width / tile), math.ceil(height / tile), 1)))
    return max(0, whole - math.ceil(math.log2(mip)))


def tiles_of_image(spark, width: int, height: int, mip: int, tile: int = TILE) -> DataFrame:
    """layer, tx, ty, tile and pixel bounds of the tiles of an image at a mip."""
    step = mip * tile
    nx, ny = math.ceil(width / step), math.ceil(height / step)
    t = spark.range(nx * ny).select(F.lit(layer_of_mip(mip, width, height, tile)).alias("layer"), (F.col("id") % nx).cast("int").alias("tx"), F.floor(F.col("id") / nx).cast("int").alias("ty"))
    lo = {c: (F.col(f"t{c}") * step).cast("int") for c in "xy"}
    end = {"x": width, "y": height}
    return t.select("*", encode_tile(F.col("layer"), F.col("tx"), F.col("ty")).alias("tile"), *[lo[c].alias(f"{c}0") for c in "xy"], *[(F.least(lo[c] + step, F.lit(end[c])) - 1).cast("int").alias(f"{c}1") for c in "xy"])


def tile_rows(image: DataFrame, mip: int, tile: int = TILE) -> DataFrame:
    """One row per tile: (tx, ty, w, h, data), data the means at the mip row by row as float32, compressed.

    Groups are bounded by the tile's size.
    """
    small = block_mean(image, mip).withColumn("tx", F.floor(F.col("x") / tile).cast("int")).withColumn("ty", F.floor(F.col("y") / tile).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        tx, ty = t.column("tx")[0].as_py(), t.column("ty")[0].as_py()
        x, y = t.column("x").to_numpy() - tx * tile, t.column("y").to_numpy() - ty * tile
        w, h = int(x.max()) + 1, int(y.max()) + 1
        data = np.full((h, w), np.nan, np.float32)
        data[y, x] = t.column("v").to_numpy()
        return pa.table({"tx": pa.array([tx], pa.int32()), "ty": pa.array([ty], pa.int32()), "w": pa.array([w], pa.int32()), "h": pa.array([h], pa.int32()), "data": pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())})

    return small.groupBy("tx", "ty").applyInArrow(pack, "tx int, ty int, w int, h int, data binary")


def unpack_tile(data: bytes, w: int, h: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.float32).reshape(h, w)


def gaussian_kernel(factor: int) -> list[float]:
    """Weights at offsets -(factor-1) .. factor-1, sigma (factor-1)/2."""
    r, sigma = factor - 1, (factor - 1) / 2
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) if sigma else 1.0 for k in range(-r, r + 1)]
    total = sum(w)
    return [x / total for x in w]


def gaussian_smooth(image: DataFrame, factor: int, width: int, height: int, side: int = SIDE) -> DataFrame:
    """Separable Gaussian over the finite pixels, weights normalised over these; only where the kernel fits.

    Computed by tiles with an apron of a kernel's radius. Pixels that were not finite stay NaN.
    """
    kernel, r = gaussian_kernel(factor), factor - 1

    def one_pass(data: np.ndarray, axis: int) -> np.ndarray:
        ok, total, weight = np.isfinite(data), np.zeros(data.shape), np.zeros(data.shape)
        filled = np.where(ok, data, 0.0)
        n = data.shape[axis]
        for k, w in zip(range(-r, r + 1), kernel, strict=True):
            if abs(k) < n:
                to = [slice(None)] * 2
                of = [slice(None)] * 2
                to[axis], of[axis] = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
                total[tuple(to)] += w * filled[tuple(of)]
                weight[tuple(to)] += w * ok[tuple(of)]
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)

    def work(data: np.ndarray, _: dict) -> np.ndarray:
        return np.where(np.isfinite(data), one_pass(one_pass(data, 1), 0), np.nan)

    inside = F.col("x").between(r, width - 1 - r) & F.col("y").between(r, height - 1 - r)
    return by_tiles(image, r, work, side=side).where(inside).select((F.col("x") - r).alias("x"), (F.col("y") - r).alias("y"), "v")


def _in_blocks(rows: DataFrame, order: str, block: int) -> DataFrame:
    """rows with a column block: stretches of the order that one task puts in order."""
    return rows.withColumn("block", F.floor(F.col(order) / block))


def nan_runs(rows: DataFrame, order: str, *by: str, block: int = BLOCK) -> DataFrame:
    """Run lengths per group, in order, beginning with values (a first run may be empty) and changing with NaN.

    A scan of two levels: changes are counted within blocks of the (integer) order, and what is carried from block to block
    is its first and last kind and the number of changes, one row a block. No task needs a whole group.
    """
    bad = F.isnan("v")
    kinds = _in_blocks(rows.select(*by, order, bad.alias("bad")), order, block)
    inside = Window.partitionBy(*by, "block").orderBy(order)
    change = F.when(F.lag("bad").over(inside) != F.col("bad"), 1).otherwise(0)
    marked = kinds.withColumn("change", change).withColumn("local", F.sum("change").over(inside))
    blocks = marked.groupBy(*by, "block").agg(F.min_by("bad", order).alias("first"), F.max_by("bad", order).alias("last"), F.sum("change").alias("changes"))
    along = Window.partitionBy(*by).orderBy("block")
    border = F.when(F.lag("last").over(along) != F.col("first"), 1).otherwise(0)
    carried = blocks.withColumn("border", border).withColumn("starts_bad", F.first("first").over(along).cast("int"))
    before = F.sum(F.col("border") + F.col("changes")).over(along) - F.col("changes")
    carried = carried.select(*by, "block", "starts_bad", before.alias("before"))
    numbered = join_same(marked, carried, (*by, "block"))
    runs = numbered.groupBy(*by, (F.col("before") + F.col("local") + F.col("starts_bad")).cast("int").alias("i")).agg(F.count("*").alias("length"), F.max("starts_bad").alias("starts_bad"))
    lead = runs.where("i = 1 and starts_bad = 1").select(*by, F.lit(0).alias("i"), F.lit(0).cast("long").alias("length"))
    return runs.select(*by, "i", "length").unionByName(lead)


def fill_nan(rows: DataFrame, order: str, *by: str, block: int = BLOCK) -> DataFrame:
    """NaN replaced by the last value before it, at the start by the first value after.

    A scan of two levels: within blocks of the (integer) order, and the first and last value of every block carried over the
    others, one row a block.
    """
    v = F.when(~F.isnan("v"), F.col("v"))
    kept = rows.columns
    cut = _in_blocks(rows, order, block)
    inside = Window.partitionBy(*by, "block").orderBy(order)
    place = F.when(~F.isnan("v"), F.col(order))
    every = cut.groupBy(*by, "block").agg(F.min_by(v, place).alias("first"), F.max_by(v, place).alias("last"))
    along = Window.partitionBy(*by).orderBy("block")
    before = F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    carried = every.select(*by, "block", before.alias("before"), after.alias("after"))
    near = F.last(v, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    next_one = F.first(v, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    found = join_same(cut.withColumn("near", near).withColumn("next", next_one), carried, (*by, "block"))
    return found.withColumn("v", F.coalesce("near", "before", "next", "after", "v")).select(kept)


def fill_blocks(image: DataFrame, size: int = 4) -> DataFrame:
    """NaN in blocks that hold values too are replaced by the block's mean; blocks of NaN only stay."""
    blocks = image.groupBy(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")).agg(F.avg(only_finite(F.col("v")).cast("double")).alias("m"))
    there = image.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size)).join(blocks, ["bx", "by"])
    return there.select("x", "y", F.when(F.isnan("v"), F.coalesce("m", F.lit(NAN))).otherwise(F.col("v").cast("double")).alias("v"))


def delta(rows: DataFrame, column: str, order: str, stride: int, *by: str) -> DataFrame:
    """Differences to the value `stride` places before; the first ones as they are."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("delta", F.col(column) - F.coalesce(F.lag(column, stride).over(w), F.lit(0)))


def round_vertex(c: Column, parts: int) -> Column:
    """A coordinate to the nearest 1/parts of a pixel."""
    return F.round(c.cast("double") * parts) / parts + F.lit(0.0)
