"""NaN-aware statistics of pixel cubes: one partial and one final aggregate, whatever the grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import NAN, finite, join_same, only_finite
from ..scratch import stored

#: Pixels that an aggregate sorts at most, bins of a round of selection, rows of a table that is broadcast.
BUFFER, BINS, BROADCAST_ROWS = 1 << 18, 1024, 100_000
BASIC = ("num_pixels", "sum", "sum_sq", "min", "max", "mean", "sigma", "rms")


def partials() -> list[Column]:
    """The aggregates of finite pixels from which all basic statistics follow, and which merge."""
    v = only_finite(F.col("v"))
    d = v.cast("double")
    return [F.count(v).alias("num_pixels"), F.sum(d).alias("sum"), F.sum(d * d).alias("sum_sq"), F.min(v).alias("min"), F.max(v).alias("max")]


def derived(df: DataFrame) -> DataFrame:
    """mean, sigma and rms from count, sum and sum of squares; NaN for what an empty or single sample cannot have."""
    n, s, q = F.col("num_pixels"), F.col("sum"), F.col("sum_sq")
    some = n > 0
    nan = F.lit(NAN)
    spread = (q - s * s / F.greatest(n, F.lit(1))) / F.greatest(n - 1, F.lit(1))
    return df.select(
        *[c for c in df.columns if c not in BASIC],
        n,
        F.when(some, s).otherwise(nan).alias("sum"),
        F.when(some, q).otherwise(nan).alias("sum_sq"),
        *[F.when(some, F.col(c).cast("double")).otherwise(nan).alias(c) for c in ("min", "max")],
        F.when(some, s / F.greatest(n, F.lit(1))).otherwise(nan).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(nan).alias("sigma"),
        F.when(some, F.sqrt(q / F.greatest(n, F.lit(1)))).otherwise(nan).alias("rms"),
    )


def basic_stats(cube: DataFrame, *by: str) -> DataFrame:
    """The eight basic statistics over finite pixels, per group."""
    return derived(cube.groupBy(*by).agg(*partials()))


def partial_stats(cube: DataFrame, *by: str) -> DataFrame:
    """Mergeable partial aggregates, to be kept in a table and merged later."""
    return cube.groupBy(*by).agg(*partials())


def merge_stats(partials: DataFrame, *by: str) -> DataFrame:
    """Statistics of the union of what the partial rows stand for; empty partials count for nothing."""
    p = partials.where("num_pixels > 0").groupBy(*by).agg(F.sum("num_pixels").alias("num_pixels"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"), F.min("min").alias("min"), F.max("max").alias("max"))
    return derived(p)


def extrema(df: DataFrame) -> DataFrame:
    """Adds extrema: the one of min and max that is larger in size."""
    return df.withColumn("extrema", F.when(F.abs("min") > F.abs("max"), F.col("min")).otherwise(F.col("max")))


def nan_count(cube: DataFrame, *by: str) -> DataFrame:
    return cube.groupBy(*by).agg(F.count_if(F.isnan("v")).alias("nan_count"), F.count("*").alias("total"))


def positions(cube: DataFrame, *by: str) -> DataFrame:
    """Positions of the least and the largest finite pixel (the first in order of z, y, x), and corners of the pixels present."""
    here = F.struct("z", "y", "x")
    v = F.col("v")
    first = lambda sign: F.min(F.struct((v * sign).alias("v"), *[F.col(c) for c in ("z", "y", "x")]))
    got = cube.where(finite(v)).groupBy(*by).agg(first(1).alias("lo"), first(-1).alias("hi"), F.min(here).alias("first"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("blc", F.min), ("trc", F.max))])
    return got.select(*by, *[F.col(f"{a}.{c}").alias(f"{n}_{c}") for a, n in (("lo", "minpos"), ("hi", "maxpos")) for c in "xyz"], "blc_x", "blc_y", "trc_x", "trc_y")


def flux_density(df: DataFrame, beam_pixels: float) -> DataFrame:
    """Adds the sum in units of one beam area; only a single beam has one."""
    return df.withColumn("flux_density", F.col("sum") / F.lit(float(beam_pixels)))


def percentiles(cube: DataFrame, ranks: tuple[float, ...], *by: str) -> DataFrame:
    """Approximate percentiles of the finite pixels, one row per rank."""
    v = only_finite(F.col("v")).cast("double")
    got = cube.groupBy(*by).agg(F.percentile_approx(v, list(ranks), 100_000).alias("p"))
    return got.select(*by, F.posexplode("p").alias("i", "value")).withColumn("rank", F.element_at(F.array(*[F.lit(r) for r in ranks]), F.col("i") + 1)).drop("i")


def exact_percentiles(cube: DataFrame, ranks: tuple[float, ...], *by: str, buffer: int = BUFFER) -> DataFrame:
    """Exact, interpolated percentiles of the finite pixels, one row per rank; none of a group without any.

    Groups of up to `buffer` pixels are sorted in an aggregate. In larger ones a percentile is selected by its rank: rounds of
    histograms narrow the interval that holds it until `buffer` pixels or a single value are left, so that buffers are
    bounded whatever the size of a group.
    """
    if not by:
        return exact_percentiles(cube.select(F.lit(0).alias("all_"), "v"), ranks, "all_", buffer=buffer).drop("all_")
    pixels = cube.select(*by, only_finite(F.col("v")).cast("double").alias("d"))
    sizes = stored(pixels.groupBy(*by).agg(F.count("d").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")), "sizes")
    ranked = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rank")) for r in ranks])).alias("r")
    groups = sizes.select("*", ranked).select(*by, "n", "lo", "hi", "r.rank")
    large = sizes.where(F.col("n") > buffer)
    n_large = large.count()
    if not n_large:
        got = pixels.groupBy(*by).agg(F.percentile("d", list(ranks)).alias("p"))
        return got.select(*by, F.posexplode("p").alias("i", "value")).withColumn("rank", F.element_at(F.array(*[F.lit(float(r)) for r in ranks]), F.col("i") + 1)).drop("i")
    place = F.col("rank") * (F.col("n") - 1)
    ends = groups.where("n > 0").select(*by, "rank", "n", "lo", "hi", F.explode(F.array(F.struct(F.floor(place).alias("k"), (1 - (place - F.floor(place))).alias("share")), F.struct(F.ceil(place).alias("k"), (place - F.floor(place)).alias("share")))).alias("e"))
    wanted = ends.select(*by, "rank", "lo", "hi", F.col("e.k").cast("long").alias("k"), F.col("e.share").alias("share"), F.col("n").alias("inside")).where("share > 0")
    selected = _select(pixels.where("d is not null"), wanted.select(*by, "k", "lo", "hi", "inside").distinct(), by, buffer)
    met = join_same(wanted.select(*by, "rank", "k", "share"), selected, (*by, "k"))
    return met.groupBy(*by, "rank").agg(F.sum(F.col("share") * F.col("value")).alias("value")).select(*by, "value", "rank")


def _select(pixels: DataFrame, targets: DataFrame, by: tuple[str, ...], buffer: int) -> DataFrame:
    """by, k, value: the pixel of rank k (from 0) of each group, from rows of (by, k, lo, hi, inside): an interval that holds it and its pixels."""
    state = stored(targets.withColumn("below", F.lit(0).cast("long")), "select")
    while not state.where((F.col("inside") > buffer) & (F.col("lo") < F.col("hi"))).isEmpty():
        wide = state.where((F.col("inside") > buffer) & (F.col("lo") < F.col("hi")))
        within = join_same(pixels, _small(wide), by).where("d between lo and hi")
        width, at = F.col("hi") / 2.0 - F.col("lo") / 2.0, F.col("d") / 2.0 - F.col("lo") / 2.0  # halves, as the difference may be too large
        bin_ = F.when(width > 0, F.least(F.floor(at / width * BINS), F.lit(BINS - 1))).otherwise((F.col("d") > F.col("lo")).cast("long"))
        bins = within.groupBy(*by, "k", "below", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*by, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        narrow = bins.withColumn("before", before).where("before <= k and k < before + c").select(*by, "k", "lo", "hi", F.col("c").alias("inside"), F.col("before").alias("below"))
        state = stored(narrow.unionByName(state.where((F.col("inside") <= buffer) | (F.col("lo") >= F.col("hi")))), "select")
    single = state.where("lo = hi").select(*by, "k", F.col("lo").alias("value"))
    left = join_same(pixels, _small(state.where("lo < hi")), by).where("d between lo and hi")
    sorted_ = left.groupBy(*by, "k", "below").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    return single.unionByName(sorted_.select(*by, "k", F.element_at("ds", (F.col("k") - F.col("below") + 1).cast("int")).alias("value")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mad(cube: DataFrame, *by: str, buffer: int = BUFFER) -> DataFrame:
    """Median absolute deviation of the finite pixels, scaled to a Gaussian's sigma; both medians as exact_percentiles() finds them."""
    if not by:
        return mad(cube.select(F.lit(0).alias("all_"), "v"), "all_", buffer=buffer).drop("all_")
    v = cube.where(finite(F.col("v"))).select(*by, F.col("v").cast("double").alias("v"))
    mid = exact_percentiles(v, (0.5,), *by, buffer=buffer).select(*by, F.col("value").alias("mid"))
    off = join_same(v, _small(stored(mid, "medians")), by).select(*by, F.abs(F.col("v") - F.col("mid")).alias("v"))
    return exact_percentiles(off, (0.5,), *by, buffer=buffer).select(*by, (1.4826 * F.col("value")).alias("mad"))


def noise(cube: DataFrame, bins: int = 100) -> DataFrame:
    """peak, noise: centre and sigma of the Gaussian through the fullest inner bin of a histogram and its two neighbours.

    The logarithm of a Gaussian is a parabola, which three bins determine; half a count is added to each.
    """
    d = cube.where(finite(F.col("v"))).select(F.col("v").cast("double").alias("d"))
    lo, hi = d.agg(F.min("d"), F.max("d")).first()
    width = (hi - lo) / bins if hi is not None and hi > lo else 1.0
    counted = d.groupBy(F.least(F.greatest(F.floor((F.col("d") - (lo or 0.0)) / width), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    every = cube.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left")
    table = every.agg(F.map_from_entries(F.collect_list(F.struct("bin", F.log(F.coalesce("c", F.lit(0)) + 0.5)))).alias("h"), F.min(F.when(F.col("bin").between(1, bins - 2), F.struct((-F.coalesce("c", F.lit(0))).alias("k"), "bin")))["bin"].alias("k"))
    left, mid, right = (F.element_at("h", F.col("k") + i) for i in (-1, 0, 1))
    bend = left - 2 * mid + right
    return table.select((F.lit(lo) + width * (F.col("k") + 0.5 + (left - right) / (2 * bend))).alias("peak"), F.when(bend < 0, width / F.sqrt(-bend)).otherwise(F.lit(NAN)).alias("noise"))
