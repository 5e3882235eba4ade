"""Queries of stored cubes: each writes a cube of the driver's tables into a store and answers from it, with DuckDB SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.regions import Region
from ..operators.store import Store, write_store
from ..scratch import shared_location
from ..sources.cubes import EV, LI, cube_of_events, cube_of_lineitem
from .registry import _NAN, CEV, CLI, EMPTY_SAFE, STATS, query, rounded

RANKS = (0.1, 0.5, 0.9)
TRIANGLE = Region("polygon", ((3, 2), (20, 5), (9, 27)))
#: The triangle's three half-planes.
INSIDE = "17 * (y - 2) - 3 * (x - 3) >= 0 AND -11 * (y - 5) - 22 * (x - 20) >= 0 AND -6 * (y - 27) + 25 * (x - 9) >= 0"


def _folder(spark) -> str:
    return f"{shared_location(spark)}/stored/cube-{uuid.uuid4().hex}"


def events_store(spark, d, **options) -> Store:
    return write_store(cube_of_events(spark, d), _folder(spark), *EV, **options)


def lineitem_store(spark, d, **options) -> Store:
    return write_store(cube_of_lineitem(spark, d), _folder(spark), *LI, **options)


def _stats(df):
    return rounded(df, "sum", "sum_sq", "mean", "sigma", "rms")


@query(
    "stored_plane_stats",
    f"""WITH {CEV}, t AS (SELECT stokes, z, {STATS} FROM ev WHERE NOT isnan(v) GROUP BY stokes, z), g AS (SELECT stokes, z, count(*) FILTER (isnan(v)) AS nan_count, count(*) AS total FROM ev GROUP BY stokes, z)
SELECT stokes, z, nan_count, total, {EMPTY_SAFE} FROM g LEFT JOIN t USING (stokes, z)""",
)
def stored_plane_stats(spark, d):
    return _stats(events_store(spark, d).plane_stats())


@query("stored_cube_stats", f"WITH {CEV}, t AS (SELECT stokes, {STATS} FROM ev WHERE NOT isnan(v) GROUP BY stokes) SELECT stokes, {EMPTY_SAFE} FROM t")
def stored_cube_stats(spark, d):
    return _stats(events_store(spark, d).cube_stats("stokes"))


@query(
    "stored_plane_histogram",
    f"""WITH {CLI}, f AS (SELECT * FROM li WHERE NOT isnan(v)), g AS (SELECT z, min(v) AS lo, max(v) AS hi, CAST((CAST(max(v) AS DOUBLE) - CAST(min(v) AS DOUBLE)) / 32 AS FLOAT) AS w FROM f GROUP BY z),
c AS (SELECT z, CASE WHEN w > 0 THEN CAST(least(greatest(floor(CAST(CAST(v - lo AS FLOAT) / w AS FLOAT)), 0), 31) AS INTEGER) ELSE 0 END AS bin FROM f JOIN g USING (z) WHERE lo < hi OR v = 0),
n AS (SELECT z, bin, count(*) AS k FROM c GROUP BY z, bin),
e AS (SELECT z, CASE WHEN lo < hi THEN CAST(lo AS DOUBLE) ELSE 0 END AS low, CAST(w AS DOUBLE) AS w, CAST(unnest(range(CASE WHEN lo < hi THEN 32 ELSE 1 END)) AS INTEGER) AS bin FROM g)
SELECT z, bin, round(low + bin * w, 6) AS lower, round(low + bin * w + w / 2, 6) AS center, coalesce(k, 0) AS count FROM e LEFT JOIN n USING (z, bin)""",
)
def stored_plane_histogram(spark, d):
    return rounded(lineitem_store(spark, d).plane_histogram(stokes=0).drop("stokes"), "lower", "center")


@query("stored_plane_percentiles", f"WITH {CLI} SELECT z, r AS rank, round(quantile_cont(CAST(v AS DOUBLE), r), 6) AS value FROM (SELECT z, v, 0.1::DOUBLE AS r FROM li UNION ALL SELECT z, v, 0.5 FROM li UNION ALL SELECT z, v, 0.9 FROM li) WHERE NOT isnan(v) GROUP BY z, r".replace("quantile_cont(CAST(v AS DOUBLE), r)", "CASE r WHEN 0.1 THEN quantile_cont(CAST(v AS DOUBLE), 0.1) WHEN 0.5 THEN quantile_cont(CAST(v AS DOUBLE), 0.5) ELSE quantile_cont(CAST(v AS DOUBLE), 0.9) END"))
def stored_plane_percentiles(spark, d):
    return rounded(lineitem_store(spark, d, ranks=RANKS).plane_percentiles(stokes=0).drop("stokes"), "value")


def _mips(m: int) -> str:
    return f"SELECT z, CAST(y // {m} AS INTEGER) AS y, CAST(x // {m} AS INTEGER) AS x, round(coalesce(avg(CAST(v AS DOUBLE)) FILTER (NOT isnan(v)), {_NAN}), 6) AS v FROM li GROUP BY 1, 2, 3"


@query("stored_mip_6", f"WITH {CLI} {_mips(6)}")
def stored_mip_6(spark, d):
    """From the stored mip of 3."""
    return rounded(lineitem_store(spark, d, mips=(2, 3)).block_mean(6, stokes=0).drop("stokes"), "v")


@query("stored_mip_8", f"WITH {CLI} {_mips(8)}")
def stored_mip_8(spark, d):
    """The stored mip of 8 itself, which was made from that of 4, and that from that of 2."""
    return rounded(lineitem_store(spark, d).block_mean(8, stokes=0).drop("stokes"), "v")


@query("stored_profile_mip_4", f"WITH {CLI}, m AS ({_mips(4)}) SELECT x AS i, v FROM m WHERE z = 3 AND y = 13 // 4")
def stored_profile_mip_4(spark, d):
    return rounded(lineitem_store(spark, d).profile("x", 13, 4, z=3), "v")


@query("stored_profile_y", f"WITH {CLI} SELECT y AS i, CAST(v AS DOUBLE) AS v FROM li WHERE z = 3 AND x = 13")
def stored_profile_y(spark, d):
    return lineitem_store(spark, d).profile("y", 13, z=3).withColumn("v", F.col("v").cast("double"))


@query(
    "stored_region_spectrum",
    f"""WITH {CEV}, t AS (SELECT z, {STATS} FROM ev WHERE stokes = 1 AND NOT isnan(v) AND {INSIDE} GROUP BY z)
SELECT z, {EMPTY_SAFE} FROM (SELECT CAST(k AS INTEGER) AS z FROM range(5) r(k)) LEFT JOIN t USING (z)""",
)
def stored_region_spectrum(spark, d):
    """All channels of a narrow region: from the copy of spectra."""
    return _stats(events_store(spark, d).region_spectrum(TRIANGLE, stokes=1))
