"""A cube kept in a store: copies of its pixels for requests of different shapes, and stored aggregates that answer without them.

A store is a folder of Parquet tables:

* `planes`: the pixels in the order of (stokes, z, y, x), so a channel, or rows of it, is one range of the files;
* `spectra`: the same pixels in the order of (stokes, y, x, z), so the spectra of a few pixels are one range;
* `stats`: one mergeable row of statistics per plane; `histograms` and `percentiles` of each plane;
* `mips/<m>`: sums and counts of the m x m blocks of each plane, each made from the largest stored divisor;
* `shape`: one row, written last. A store without it was not completed and is refused.

Requests go to the smallest table that answers them. Ranges of coordinates reach the scan as pushed filters; as both copies
are sorted, row groups and pages outside the range are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import NAN, finite, float_bin, join_same
from . import resample, stats
from .histogram import auto_bins
from .profiles import decimate
from .regions import Region

PLANES, SPECTRA = ("stokes", "z", "y", "x"), ("stokes", "y", "x", "z")
RANKS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Row spans of a mask up to which they are broadcast (some 50 bytes each); more are joined by a shuffle on y.
BROADCAST_SPANS = 100_000


def write_store(cube: DataFrame, path: str, width: int, height: int, depth: int = 1, stokes: int = 1, mips: tuple[int, ...] = (2, 4, 8), bins: int | None = None, ranks: tuple[float, ...] = RANKS, row_group: int = 32 << 20) -> Store:
    """Writes a store of a cube of width x height x depth x stokes pixels; all but `planes` is made from `planes`.

    bins: of each plane's histogram, between the plane's own limits. row_group: bytes of a row group before compression,
    the unit in which a scan skips. The folder must not exist.
    """
    spark = cube.sparkSession
    sorted_copy = lambda df, order: df.select("stokes", "z", "y", "x", "v").repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group)
    sorted_copy(cube, PLANES).parquet(f"{path}/planes")
    pixels = spark.read.parquet(f"{path}/planes")
    sorted_copy(pixels, SPECTRA).parquet(f"{path}/spectra")
    by = ("stokes", "z")
    pixels.groupBy(*by).agg(F.count_if(F.isnan("v")).alias("nan_count"), F.count("*").alias("total"), *stats.partials()).write.parquet(f"{path}/stats")
    bins = bins or auto_bins(width, height)
    plane_histograms(pixels, spark.read.parquet(f"{path}/stats"), bins).write.parquet(f"{path}/histograms")
    stats.exact_percentiles(pixels, ranks, *by).write.parquet(f"{path}/percentiles")
    made: list[int] = []
    for m in sorted(set(mips)):
        d = resample.best_divisor(made, m)
        if d == 1:
            sums = resample.mip_sums(pixels, m, *by)
        else:
            at = lambda c, k=m // d: F.floor(F.col(c) / k).cast("int").alias(c)
            sums = spark.read.parquet(f"{path}/mips/{d}").groupBy(*by, at("y"), at("x")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        sums.repartitionByRange("stokes", "z", "y").sortWithinPartitions("stokes", "z", "y", "x").write.parquet(f"{path}/mips/{m}")
        made.append(m)
    row = [(width, height, depth, stokes, bins, made)]
    spark.createDataFrame(row, "width int, height int, depth int, stokes int, bins int, mips array<int>").coalesce(1).write.parquet(f"{path}/shape")
    return Store(spark, path)


def plane_histograms(pixels: DataFrame, partials: DataFrame, bins: int) -> DataFrame:
    """stokes, z, bin, lower, center, count: a histogram per plane between the plane's own limits, in float32 arithmetic.

    partials: rows of (stokes, z, min, max). Every bin has its row; a plane of one value or none has one bin that counts zeros.
    """
    some = F.col("min") < F.col("max")
    low, high = (F.when(some, F.col(c)).otherwise(F.lit(0.0).cast("float")) for c in ("min", "max"))
    wide = ((high.cast("double") - low.cast("double")) / bins).cast("float")
    limits = partials.select("stokes", "z", low.alias("low"), high.alias("high"), wide.alias("width"), F.when(some, bins).otherwise(1).alias("bins"))
    met = join_same(pixels, limits, ("stokes", "z")).where(finite(F.col("v")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    at = F.when(F.col("width") > 0, float_bin(F.col("v"), F.col("low"), F.col("width"), bins)).otherwise(0)
    counts = met.groupBy("stokes", "z", at.alias("bin")).agg(F.count("*").alias("n"))
    every = limits.select("stokes", "z", "low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    lower = F.col("low").cast("double") + F.col("bin") * F.col("width").cast("double")
    return every.join(counts, ["stokes", "z", "bin"], "left").select("stokes", "z", "bin", lower.alias("lower"), (lower + F.col("width").cast("double") / 2).alias("center"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def row_spans(spark: SparkSession, region: Region, width: int, height: int) -> DataFrame:
    """y, x0, x1: the mask of a region within an image as spans of pixels, both ends included.

    The region is tested once for each pixel of its bounding box, in parallel, whatever the number of channels.
    """
    x0, y0, x1, y1 = region.box()
    x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, width - 1), min(y1, height - 1)
    w, h = max(x1 - x0 + 1, 0), max(y1 - y0 + 1, 0)
    grid = spark.range(w * h).select((F.floor(F.col("id") / max(w, 1)) + y0).cast("int").alias("y"), (F.col("id") % max(w, 1) + x0).cast("int").alias("x"))
    run = F.col("x") - F.row_number().over(Window.partitionBy("y").orderBy("x"))
    return grid.where(region.predicate()).withColumn("run", run).groupBy("y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


class Store:
    """Requests to a store that write_store() has completed."""

    def __init__(self, spark: SparkSession, path: str):
        shape = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shape/_SUCCESS")
        if not shape.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(shape):
            raise ValueError(f"no complete store at {path}")
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/shape").first()
        self.width, self.height, self.depth, self.stokes, self.bins, self.mips = (row[c] for c in ("width", "height", "depth", "stokes", "bins", "mips"))

    def _table(self, name: str, stokes: int | None = None, z: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        for c, k in (("stokes", stokes), ("z", z)):
            df = df if k is None else df.where(F.col(c) == k)
        return df

    def plane_stats(self, stokes: int | None = None, z: int | None = None) -> DataFrame:
        """stokes, z, nan_count, total and the basic statistics of each plane, empty planes included; no pixel is read."""
        return stats.derived(self._table("stats", stokes, z))

    def cube_stats(self, *by: str) -> DataFrame:
        """Basic statistics of all planes together, or per Stokes parameter or channel; no pixel is read."""
        return stats.merge_stats(self._table("stats"), *by)

    def plane_histogram(self, stokes: int | None = None, z: int | None = None) -> DataFrame:
        return self._table("histograms", stokes, z)

    def plane_percentiles(self, stokes: int | None = None, z: int | None = None) -> DataFrame:
        """stokes, z, value, rank; planes without finite pixels have none."""
        return self._table("percentiles", stokes, z)

    def block_mean(self, mip: int, stokes: int | None = None, z: int | None = None) -> DataFrame:
        """stokes, z, y, x, v of the mip's blocks, from the largest stored divisor of the mip, else from the pixels."""
        m = resample.best_divisor(self.mips, mip)
        if m == 1:
            return resample.block_mean(self._table("planes", stokes, z), mip, "stokes", "z")
        return resample.from_mip(self._table(f"mips/{m}", stokes, z), m, mip, "stokes", "z")

    def profile(self, axis: str, at: int, mip: int = 1, stokes: int = 0, z: int = 0) -> DataFrame:
        """i, v along `axis` (x or y) through pixel `at` of the other one, at 1 / mip of the resolution.

        Where a stored mip divides the one asked for, the means of the row of blocks that holds the pixel; otherwise the least
        and the largest value of each two samples, in their order. Columns of a plane come from the copy of spectra if that
        reads less.
        """
        if axis not in ("x", "y"):
            raise ValueError("a profile runs along x or y")
        other = "y" if axis == "x" else "x"
        m = resample.best_divisor(self.mips, mip)
        if mip > 1 and m > 1:
            k, row = mip // m, at // mip
            part = self._table(f"mips/{m}", stokes, z).where(F.col(other).between(row * k, row * k + k - 1))
            return resample.from_mip(part, m, mip, "stokes", "z").select(F.col(axis).alias("i"), "v")
        box = (0, at, self.width - 1, at) if axis == "x" else (at, 0, at, self.height - 1)
        line = self.pixels(box, (z, z), stokes).select(axis, "v")
        return line.withColumnRenamed(axis, "i") if mip == 1 else decimate(line, axis, mip)

    def copy_for(self, box: tuple[int, int, int, int], channels: int) -> str:
        """The copy that reads fewer pixels for a box (x0, y0, x1, y1) in so many channels: whole rows of planes, or whole spectra."""
        x0, y0, x1, y1 = box
        rows = max(min(y1, self.height - 1) - max(y0, 0) + 1, 0)
        columns = max(min(x1, self.width - 1) - max(x0, 0) + 1, 0)
        return "planes" if channels * rows * self.width <= rows * columns * self.depth else "spectra"

    def pixels(self, box: tuple[int, int, int, int] | None = None, channels: tuple[int, int] | None = None, stokes: int | None = None) -> DataFrame:
        """The pixels of a box (x0, y0, x1, y1) and a range of channels, ends included, from the copy that suits their shape."""
        box = box or (0, 0, self.width - 1, self.height - 1)
        first, last = channels or (0, self.depth - 1)
        df = self._table(self.copy_for(box, last - first + 1), stokes)
        x0, y0, x1, y1 = box
        for c, lo, hi, whole in (("x", x0, x1, self.width), ("y", y0, y1, self.height), ("z", first, last, self.depth)):
            if lo > 0 or hi < whole - 1:
                df = df.where(F.col(c).between(lo, hi))
        return df

    def region_spectrum(self, region: Region, stokes: int = 0, channels: tuple[int, int] | None = None) -> DataFrame:
        """z and the basic statistics of the region's pixels in every channel of the range, channels without finite pixels included.

        The region is turned into row spans once; pixels of its box meet them by row, so that the price of a pixel does
        not depend on how many vertices the region has.
        """
        region.check()
        first, last = channels or (0, self.depth - 1)
        spans = row_spans(self.spark, region, self.width, self.height).withColumnRenamed("y", "row")
        box = region.box()
        rows = max(min(box[3], self.height - 1) - max(box[1], 0) + 1, 0)
        # A row has at most one span per two of its pixels in the box; in fact few, but this bound needs no job.
        most = rows * ((max(min(box[2], self.width - 1) - max(box[0], 0) + 1, 0) + 1) // 2)
        spans = F.broadcast(spans) if most <= BROADCAST_SPANS else spans
        inside = self.pixels(box, (first, last), stokes).join(spans, (F.col("y") == F.col("row")) & F.col("x").between(F.col("x0"), F.col("x1")))
        every = self.spark.range(first, last + 1).select(F.col("id").cast("int").alias("z"))
        got = every.join(stats.partial_stats(inside, "z"), "z", "left")
        return stats.derived(got.withColumn("num_pixels", F.coalesce("num_pixels", F.lit(0))))
