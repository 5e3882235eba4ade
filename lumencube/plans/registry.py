"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NAN, finite
from ..operators import catalog, histogram, moments, polarization, profiles, regions, resample, stats
from ..operators.catalog import Filter
from ..operators.regions import Region
from ..sources.cubes import EV, LI, cube_of_events, cube_of_lineitem, image_of_embeddings, table

QUERIES: dict = {}
ORACLES: dict = {}

# The cubes of sources/cubes.py as common table expressions.
EMB = """emb AS (SELECT CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS x, CAST(vec_id AS INTEGER) AS y, unnest(embedding) AS v FROM embeddings),
embf AS (SELECT * FROM emb WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))"""
CLI = """li0 AS (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, l_linenumber - 1 AS z, CAST(sum(l_quantity) AS FLOAT) AS v FROM lineitem GROUP BY ALL),
li AS (SELECT CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, CAST(gz AS INTEGER) AS z, coalesce(v, CAST('nan' AS FLOAT)) AS v
  FROM range(32) a(gx), range(32) b(gy), range(7) c(gz) LEFT JOIN li0 ON x = gx AND y = gy AND z = gz)"""
CEV = """ev0 AS (SELECT hour(ts) AS x, day(ts) - 1 AS y, user_id % 5 AS z, s, CAST(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS FLOAT) AS v
  FROM (SELECT *, unnest([0, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 END]) AS s FROM events) WHERE s IS NOT NULL GROUP BY ALL),
ev AS (SELECT CAST(gs AS INTEGER) AS stokes, CAST(gz AS INTEGER) AS z, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(v, CAST('nan' AS FLOAT)) AS v
  FROM range(24) a(gx), range(30) b(gy), range(5) c(gz), range(4) d(gs) LEFT JOIN ev0 ON x = gx AND y = gy AND z = gz AND s = gs)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles whose last digits depend on the order of a sum, rounded; NaN stays."""
    r = lambda c: F.when(F.isnan(c), F.lit(NAN)).otherwise(F.round(F.col(c).cast("double"), digits))
    return df.withColumns({c: r(c) for c in columns})


def _r(expr: str, alias: str, digits: int = 6) -> str:
    return f"CASE WHEN isnan({expr}) THEN CAST('nan' AS DOUBLE) ELSE round({expr}, {digits}) END AS {alias}"


STATS = """count(*) AS num_pixels, sum(CAST(v AS DOUBLE)) AS s, sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) AS q, min(v) AS lo, max(v) AS hi"""
_NAN = "CAST('nan' AS DOUBLE)"
DERIVED = f"""num_pixels, round(coalesce(s, {_NAN}), 6) AS sum, round(coalesce(q, {_NAN}), 6) AS sum_sq, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max,
round(s / num_pixels, 6) AS mean, CASE WHEN num_pixels > 1 THEN round(sqrt(greatest((q - s * s / num_pixels) / (num_pixels - 1), 0)), 6) ELSE {_NAN} END AS sigma, round(sqrt(q / num_pixels), 6) AS rms"""

#: The same of a group that may have no row.
EMPTY_SAFE = f"""coalesce(num_pixels, 0) AS num_pixels, coalesce(round(s, 6), {_NAN}) AS sum, coalesce(round(q, 6), {_NAN}) AS sum_sq, coalesce(CAST(lo AS DOUBLE), {_NAN}) AS min, coalesce(CAST(hi AS DOUBLE), {_NAN}) AS max,
coalesce(round(s / num_pixels, 6), {_NAN}) AS mean, CASE WHEN num_pixels > 1 THEN round(sqrt(greatest((q - s * s / num_pixels) / (num_pixels - 1), 0)), 6) ELSE {_NAN} END AS sigma, coalesce(round(sqrt(q / num_pixels), 6), {_NAN}) AS rms"""


def _stats(df: DataFrame) -> DataFrame:
    return rounded(df, "sum", "sum_sq", "mean", "sigma", "rms")


# --- statistics ---------------------------------------------------------------------------------------------------


@query("image_basic_stats", f"WITH {EMB}, t AS (SELECT {STATS} FROM embf) SELECT {DERIVED} FROM t")
def image_basic_stats(spark, d):
    return _stats(stats.basic_stats(image_of_embeddings(spark, d)))


@query("stats_per_channel", f"WITH {CLI}, t AS (SELECT z, {STATS} FROM li WHERE NOT isnan(v) GROUP BY z) SELECT z, {DERIVED} FROM t")
def stats_per_channel(spark, d):
    return _stats(stats.basic_stats(cube_of_lineitem(spark, d), "z"))


@query("stats_cube_merged", f"WITH {CLI}, t AS (SELECT {STATS} FROM li WHERE NOT isnan(v)) SELECT {DERIVED} FROM t")
def stats_cube_merged(spark, d):
    """Cube statistics merged from those of the channels."""
    return _stats(stats.merge_stats(stats.partial_stats(cube_of_lineitem(spark, d), "z")))


@query("stats_per_stokes", f"WITH {CEV}, t AS (SELECT stokes, {STATS} FROM ev WHERE NOT isnan(v) GROUP BY stokes) SELECT stokes, {DERIVED} FROM t")
def stats_per_stokes(spark, d):
    return _stats(stats.basic_stats(cube_of_events(spark, d), "stokes"))


@query("extrema", f"WITH {EMB} SELECT y, CAST(CASE WHEN abs(min(v)) > abs(max(v)) THEN min(v) ELSE max(v) END AS DOUBLE) AS extrema FROM embf GROUP BY y")
def extrema(spark, d):
    return stats.extrema(stats.basic_stats(image_of_embeddings(spark, d), "y")).select("y", "extrema")


@query("nan_count", f"WITH {CEV} SELECT stokes, z, count(*) FILTER (isnan(v)) AS nan_count, count(*) AS total FROM ev GROUP BY stokes, z")
def nan_count(spark, d):
    return stats.nan_count(cube_of_events(spark, d), "stokes", "z")


@query(
    "positions",
    f"""WITH {CLI}, f AS (SELECT * FROM li WHERE NOT isnan(v))
SELECT z0 AS z, arg_min(x, (v, y, x)) AS minpos_x, arg_min(y, (v, y, x)) AS minpos_y, z0 AS minpos_z, arg_min(x, (-v, y, x)) AS maxpos_x, arg_min(y, (-v, y, x)) AS maxpos_y, z0 AS maxpos_z,
min(x) AS blc_x, min(y) AS blc_y, max(x) AS trc_x, max(y) AS trc_y FROM (SELECT *, z AS z0 FROM f) GROUP BY z0""",
)
def positions(spark, d):
    return stats.positions(cube_of_lineitem(spark, d), "z")


@query("flux_density", f"WITH {CLI} SELECT z, round(sum(CAST(v AS DOUBLE)) / 9.0, 6) AS flux_density FROM li WHERE NOT isnan(v) GROUP BY z")
def flux_density(spark, d):
    return rounded(stats.flux_density(stats.basic_stats(cube_of_lineitem(spark, d), "z"), 9.0).select("z", "flux_density"), "flux_density")


@query("median_deviation", f"WITH {CLI}, m AS (SELECT z, median(CAST(v AS DOUBLE)) AS mid FROM li WHERE NOT isnan(v) GROUP BY z) SELECT z, round(1.4826 * median(abs(v - mid)), 6) AS mad FROM li JOIN m USING (z) WHERE NOT isnan(v) GROUP BY z")
def median_deviation(spark, d):
    return rounded(stats.mad(cube_of_lineitem(spark, d), "z"), "mad")


# --- histograms ---------------------------------------------------------------------------------------------------


def _hist_sql(ctes: str, source: str, bins: str) -> str:
    return f"""WITH {ctes}, f AS ({source}), b AS (SELECT CAST({bins} AS INTEGER) AS n, min(v) AS lo, CAST((CAST(max(v) AS DOUBLE) - CAST(min(v) AS DOUBLE)) / CAST({bins} AS INTEGER) AS FLOAT) AS w FROM f),
h AS (SELECT least(greatest(CAST(floor((v - lo) / w) AS BIGINT), 0), n - 1) AS bin, count(*) AS c FROM f, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(CAST(lo AS DOUBLE) + i * CAST(w AS DOUBLE), 9) AS lower, coalesce(c, 0) AS count FROM b, range(100000) r(i) LEFT JOIN h ON bin = i WHERE i < n"""


def _hist(df: DataFrame) -> DataFrame:
    return rounded(df, "lower", digits=9).select("bin", "lower", "count")


@query("image_histogram", _hist_sql(EMB, "SELECT v FROM embf", "(SELECT floor(greatest(sqrt(64 * count(DISTINCT vec_id)), 2)) FROM embeddings)"))
def image_histogram(spark, d):
    height = table(spark, d, "embeddings").agg(F.countDistinct("vec_id")).first()[0]
    return _hist(histogram.image_histogram(image_of_embeddings(spark, d), 64, height))


@query("cube_histogram", _hist_sql(CLI, "SELECT v FROM li WHERE NOT isnan(v)", "32"))
def cube_histogram(spark, d):
    return _hist(histogram.cube_histogram(cube_of_lineitem(spark, d), LI[0], LI[1]))


@query(
    "histogram_fixed_bounds",
    f"""WITH {CEV}, f AS (SELECT z, v FROM ev WHERE stokes = 0 AND v >= 10 AND v <= 500),
h AS (SELECT z, least(greatest(CAST(floor((v - CAST(10 AS FLOAT)) / CAST(24.5 AS FLOAT)) AS BIGINT), 0), 19) AS bin, count(*) AS c FROM f GROUP BY 1, 2)
SELECT CAST(gz AS INTEGER) AS z, CAST(i AS INTEGER) AS bin, coalesce(c, 0) AS count FROM range(5) a(gz), range(20) r(i) LEFT JOIN h ON z = gz AND bin = i""",
)
def histogram_fixed_bounds(spark, d):
    cube = cube_of_events(spark, d).where("stokes = 0")
    return histogram.histogram(cube, 20, (10.0, 500.0), "z").select("z", "bin", "count")


@query(
    "histogram_merged",
    f"""WITH {CEV}, f AS (SELECT v FROM ev WHERE stokes = 0 AND v >= 10 AND v <= 500),
h AS (SELECT least(greatest(CAST(floor((v - CAST(10 AS FLOAT)) / CAST(24.5 AS FLOAT)) AS BIGINT), 0), 19) AS bin, count(*) AS c FROM f GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, CAST(coalesce(c, 0) AS BIGINT) AS count FROM range(20) r(i) LEFT JOIN h ON bin = i""",
)
def histogram_merged(spark, d):
    cube = cube_of_events(spark, d).where("stokes = 0")
    return histogram.merge_histograms(histogram.histogram(cube, 20, (10.0, 500.0), "z")).select("bin", "count")


# --- catalogs -----------------------------------------------------------------------------------------------------


def _supplier(spark, d):
    return catalog.with_row_id(table(spark, d, "supplier"), "s_suppkey")


_SUP = "SELECT s_suppkey AS row_id, s_name, s_nationkey, s_acctbal FROM supplier"
_OPS = {"eq": ("s_nationkey", 7, "s_nationkey = 7"), "ne": ("s_nationkey", 7, "s_nationkey <> 7"), "lt": ("s_acctbal", 1000.5, "s_acctbal < 1000.5"), "gt": ("s_acctbal", 1000.5, "s_acctbal > 1000.5"), "le": ("s_nationkey", 3.7, "s_nationkey <= 3"), "ge": ("s_nationkey", 20.2, "s_nationkey >= 20")}
for _op, (_c, _v, _cond) in _OPS.items():
    query(f"cat_{_op}", f"{_SUP} WHERE {_cond}")(lambda spark, d, op=_op, c=_c, v=_v: catalog.select_rows(_supplier(spark, d), [Filter(c, op, v)]).select("row_id", "s_name", "s_nationkey", "s_acctbal"))


@query("cat_range_closed", "SELECT o_orderkey AS row_id, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 50000")
def cat_range_closed(spark, d):
    return catalog.select_rows(catalog.with_row_id(table(spark, d, "orders"), "o_orderkey"), [Filter("o_totalprice", "range_closed", 1000, 50000)]).select("row_id", "o_totalprice")


@query("cat_range_open", "SELECT p_partkey AS row_id, p_size FROM part WHERE p_size > 10 AND p_size < 20")
def cat_range_open(spark, d):
    return catalog.select_rows(catalog.with_row_id(table(spark, d, "part"), "p_partkey"), [Filter("p_size", "range_open", 10, 20)]).select("row_id", "p_size")


@query("cat_float_literal", f"WITH {EMB} SELECT x, y FROM emb WHERE v >= CAST(0.1 AS FLOAT) AND v <= CAST(0.11 AS FLOAT) AND NOT isnan(v)")
def cat_float_literal(spark, d):
    return catalog.select_rows(image_of_embeddings(spark, d), [Filter("v", "ge", 0.1), Filter("v", "le", 0.11)]).select("x", "y")


@query("cat_nan_rules", f"WITH {CEV} SELECT (SELECT count(*) FROM ev WHERE v >= 50 AND NOT isnan(v)) AS ge, (SELECT count(*) FROM ev WHERE v <> 50 OR isnan(v)) AS ne")
def cat_nan_rules(spark, d):
    cube = cube_of_events(spark, d)
    p = {op: catalog.predicate(cube, Filter("v", op, 50.0)) for op in ("ge", "ne")}
    return cube.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(op) for op, c in p.items()])


@query("cat_substring", "SELECT c_custkey AS row_id, c_name FROM customer WHERE contains(c_name, '12')")
def cat_substring(spark, d):
    return catalog.select_rows(catalog.with_row_id(table(spark, d, "customer"), "c_custkey"), [Filter("c_name", "contains", "12")]).select("row_id", "c_name")


@query("cat_substring_nocase", "SELECT p_partkey AS row_id, p_type FROM part WHERE contains(lower(p_type), 'a')")
def cat_substring_nocase(spark, d):
    return catalog.select_rows(catalog.with_row_id(table(spark, d, "part"), "p_partkey"), [Filter("p_type", "contains", "A", ignore_case=True)]).select("row_id", "p_type")


@query("cat_conjunction", f"{_SUP} WHERE s_acctbal > 0 AND s_nationkey < 10 AND contains(s_name, '1')")
def cat_conjunction(spark, d):
    """A filter on an unknown column and one of the wrong kind are skipped."""
    f = [Filter("s_acctbal", "gt", 0), Filter("s_nationkey", "lt", 10), Filter("s_name", "contains", "1"), Filter("nothing", "eq", 1), Filter("s_name", "eq", 1)]
    return catalog.select_rows(_supplier(spark, d), f).select("row_id", "s_name", "s_nationkey", "s_acctbal")


@query("cat_invert", f"{_SUP} WHERE NOT (s_acctbal > 0 AND s_nationkey < 10)")
def cat_invert(spark, d):
    return catalog.inverted(_supplier(spark, d), [Filter("s_acctbal", "gt", 0), Filter("s_nationkey", "lt", 10)]).select("row_id", "s_name", "s_nationkey", "s_acctbal")


@query("cat_union", f"{_SUP} WHERE s_acctbal > 5000 OR s_nationkey = 3")
def cat_union(spark, d):
    return catalog.combined(_supplier(spark, d), [Filter("s_acctbal", "gt", 5000)], [Filter("s_nationkey", "eq", 3)]).select("row_id", "s_name", "s_nationkey", "s_acctbal")


@query("cat_sort_page", "SELECT s_suppkey AS row_id, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 5")
def cat_sort_page(spark, d):
    return catalog.page(catalog.ordered(_supplier(spark, d), "s_acctbal", True), 5, 25).select("row_id", "s_acctbal")


@query("cat_sort_text", "SELECT c_custkey AS row_id, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 40")
def cat_sort_text(spark, d):
    return catalog.page(catalog.ordered(catalog.with_row_id(table(spark, d, "customer"), "c_custkey"), "c_mktsegment"), -1, 40).select("row_id", "c_mktsegment")


@query("cat_sort_nan_last", f"WITH {CEV} SELECT z * 720 + y * 24 + x AS row_id, CAST(v AS DOUBLE) AS v FROM ev WHERE stokes = 1 ORDER BY isnan(v), v DESC, row_id LIMIT 1500")
def cat_sort_nan_last(spark, d):
    cube = cube_of_events(spark, d).where("stokes = 1").select((F.col("z") * 720 + F.col("y") * 24 + F.col("x")).alias("row_id"), F.col("v").cast("double").alias("v"))
    return catalog.page(catalog.ordered(cube, "v", True), -1, 1500)


@query("cat_preview", "SELECT p_partkey AS row_id, p_name, p_size FROM part ORDER BY p_partkey LIMIT 50")
def cat_preview(spark, d):
    return catalog.preview(catalog.with_row_id(table(spark, d, "part"), "p_partkey")).select("row_id", "p_name", "p_size")


@query("cat_project", "SELECT s_name, s_acctbal FROM supplier")
def cat_project(spark, d):
    return catalog.project(table(spark, d, "supplier"), [1, 3, 99])


# --- profiles -----------------------------------------------------------------------------------------------------


@query("point_value", f"WITH {EMB} SELECT x, y, CAST(v AS DOUBLE) AS v FROM emb WHERE x = 13 AND y = 8")
def point_value(spark, d):
    return profiles.point_value(image_of_embeddings(spark, d), 12.5, 7.6).select("x", "y", F.col("v").cast("double").alias("v"))


@query("profile_x", f"WITH {EMB} SELECT x, CAST(v AS DOUBLE) AS v FROM emb WHERE y = 20 AND x >= 4 AND x < 50")
def profile_x(spark, d):
    return profiles.x_profile(image_of_embeddings(spark, d), 20, 4, 50).withColumn("v", F.col("v").cast("double"))


@query("profile_y", f"WITH {EMB} SELECT y, CAST(v AS DOUBLE) AS v FROM emb WHERE x = 30")
def profile_y(spark, d):
    return profiles.y_profile(image_of_embeddings(spark, d), 30).withColumn("v", F.col("v").cast("double"))


@query("profile_z", f"WITH {CLI} SELECT z, CAST(v AS DOUBLE) AS v FROM li WHERE x = 9 AND y = 21")
def profile_z(spark, d):
    return profiles.z_profile(cube_of_lineitem(spark, d), 9, 21).withColumn("v", F.col("v").cast("double"))


@query("sub_image", f"WITH {CLI} SELECT z, y - 4 AS y, x - 3 AS x, CAST(v AS DOUBLE) AS v FROM li WHERE x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 9")
def sub_image(spark, d):
    return profiles.box(cube_of_lineitem(spark, d), 3, 12, 4, 9).select("z", "y", "x", F.col("v").cast("double").alias("v"))


@query(
    "decimate_minmax",
    f"""WITH {CEV}, p AS (SELECT y * 24 + x AS i, v FROM ev WHERE stokes = 0 AND z = 0), w AS (SELECT i // 8 AS w, i, v FROM p WHERE NOT isnan(v)),
m AS (SELECT w, arg_min(i, (v, i)) AS pl, min(v) AS lo, arg_min(i, (-v, i)) AS ph, max(v) AS hi FROM w GROUP BY w), a AS (SELECT DISTINCT i // 8 AS w FROM p)
SELECT CAST(2 * a.w + k AS INTEGER) AS i, CAST(coalesce(CASE WHEN (pl <= ph) = (k = 0) THEN lo ELSE hi END, CAST('nan' AS FLOAT)) AS DOUBLE) AS v FROM a LEFT JOIN m ON a.w = m.w, range(2) r(k)""",
)
def decimate_minmax(spark, d):
    row = cube_of_events(spark, d).where("stokes = 0 and z = 0").select((F.col("y") * 24 + F.col("x")).alias("i"), "v")
    return profiles.decimate(row, "i", 4).withColumn("v", F.col("v").cast("double"))


@query("line_profile", f"WITH {EMB} SELECT CAST(x - 5 AS INTEGER) AS box, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM embf WHERE x BETWEEN 5 AND 25 AND y BETWEEN 9 AND 11 GROUP BY x")
def line_profile(spark, d):
    return rounded(profiles.line_profile(image_of_embeddings(spark, d), [(4.5, 10.0), (25.5, 10.0)], 3), "v")


@query("pv_image", f"WITH {CLI} SELECT CAST(x - 1 AS INTEGER) AS x, z AS y, CAST(v AS DOUBLE) AS v FROM li WHERE y = 5 AND x BETWEEN 1 AND 9")
def pv_image(spark, d):
    return profiles.pv_image(cube_of_lineitem(spark, d), [(1.0, 5.0), (9.0, 5.0)]).select("x", "y", "v")


@query(
    "pv_polyline",
    f"""WITH {CLI}, b AS (SELECT i AS box, 1 + i AS x, 1 AS y FROM range(9) r(i) UNION ALL SELECT 8 + i, 9, 1 + i FROM range(1, 5) r(i))
SELECT z AS x, CAST(box AS INTEGER) AS y, CAST(v AS DOUBLE) AS v FROM li JOIN b USING (x, y)""",
)
def pv_polyline(spark, d):
    return profiles.pv_image(cube_of_lineitem(spark, d), [(1.0, 1.0), (9.0, 1.0), (9.0, 5.0)], reverse=True).select("x", "y", "v")


@query(
    "pv_preview",
    f"""WITH {CEV}, a AS (SELECT z, y // 3 AS y, x // 3 AS x, avg(CAST(v AS DOUBLE)) FILTER (NOT isnan(v)) AS m FROM ev WHERE stokes = 0 GROUP BY ALL),
b AS (SELECT z // 2 AS z, y, x, avg(coalesce(m, {_NAN})) AS m FROM a GROUP BY ALL)
SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN (z + 1) * 2 <= 5 AND NOT isnan(m) THEN round(m, 6) ELSE {_NAN} END AS v FROM b""",
)
def pv_preview(spark, d):
    return rounded(profiles.preview_cube(cube_of_events(spark, d).where("stokes = 0"), EV[2], 3, 2), "v").select("z", "y", "x", "v")


# --- down-sampling, tiles, encodings ------------------------------------------------------------------------------


def _mip_sql(ctes: str, source: str, m: int) -> str:
    return f"WITH {ctes} SELECT CAST(y // {m} AS INTEGER) AS y, CAST(x // {m} AS INTEGER) AS x, round(coalesce(avg(CAST(v AS DOUBLE)) FILTER (NOT isnan(v)), {_NAN}), 6) AS v FROM {source} GROUP BY 1, 2"


@query("mip_mean_2", _mip_sql(EMB, "emb", 2))
def mip_mean_2(spark, d):
    return rounded(resample.block_mean(image_of_embeddings(spark, d), 2), "v")


@query("mip_via_divisor", _mip_sql(CEV, "(SELECT * FROM ev WHERE stokes = 1 AND z = 2)", 8))
def mip_via_divisor(spark, d):
    image = profiles.plane(cube_of_events(spark, d), 2, 1)
    stored = resample.best_divisor([2, 4], 8)
    return rounded(resample.from_mip(resample.mip_sums(image, stored), stored, 8), "v")


@query("mip_nearest_4", f"WITH {EMB} SELECT CAST(x // 4 AS INTEGER) AS x, CAST(y // 4 AS INTEGER) AS y, CAST(v AS DOUBLE) AS v FROM emb WHERE x % 4 = 0 AND y % 4 = 0")
def mip_nearest_4(spark, d):
    return resample.nearest(image_of_embeddings(spark, d), 4).select("x", "y", F.col("v").cast("double").alias("v"))


@query(
    "tile_ids",
    "SELECT CAST(2 AS INTEGER) AS layer, CAST(i % 4 AS INTEGER) AS tx, CAST(i // 4 AS INTEGER) AS ty, CAST(2 * 16777216 + (i // 4) * 4096 + i % 4 AS INTEGER) AS tile, CAST(i % 4 * 256 AS INTEGER) AS x0, CAST(i // 4 * 256 AS INTEGER) AS y0, CAST(least(i % 4 * 256 + 256, 1000) - 1 AS INTEGER) AS x1, CAST(least(i // 4 * 256 + 256, 700) - 1 AS INTEGER) AS y1 FROM range(12) r(i)",
)
def tile_ids(spark, d):
    return resample.tiles_of_image(spark, 1000, 700, 1)


@query(
    "tile_codes",
    "SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey < 4096 AND l_partkey < 4096 THEN CAST(12 * 16777216 + l_suppkey * 4096 + l_partkey AS INTEGER) ELSE -1 END AS tile, CASE WHEN l_suppkey < 4096 AND l_partkey < 4096 THEN CAST(l_partkey AS INTEGER) ELSE -1 END AS x FROM lineitem",
)
def tile_codes(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), resample.encode_tile(F.lit(12), F.col("l_partkey"), F.col("l_suppkey")).alias("tile"))
    return t.withColumn("x", resample.decode_tile(F.col("tile"))[1])


@query(
    "nan_rle",
    f"""WITH {CEV}, p AS (SELECT z, y * 24 + x AS i, isnan(v) AS bad FROM ev WHERE stokes = 2), m AS (SELECT *, CASE WHEN lag(bad) OVER w = bad THEN 0 ELSE 1 END AS n FROM p WINDOW w AS (PARTITION BY z ORDER BY i)),
r AS (SELECT z, bad, run, count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY z ORDER BY i) AS run FROM m) GROUP BY ALL), f AS (SELECT z, bool_or(bad) FILTER (run = 1) AS fb FROM r GROUP BY z)
SELECT z, CAST(run - 1 + CAST(fb AS INTEGER) AS INTEGER) AS i, length FROM r JOIN f USING (z) UNION ALL SELECT z, 0, 0 FROM f WHERE fb""",
)
def nan_rle(spark, d):
    rows = cube_of_events(spark, d).where("stokes = 2").select("z", (F.col("y") * 24 + F.col("x")).alias("i"), "v")
    return resample.nan_runs(rows, "i", "z")


@query(
    "nan_forward_fill",
    f"""WITH {CEV}, p AS (SELECT z, y * 24 + x AS i, CASE WHEN NOT isnan(v) THEN CAST(v AS DOUBLE) END AS v FROM ev WHERE stokes = 3)
SELECT z, i, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY z ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY z ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {_NAN}) AS v FROM p""",
)
def nan_forward_fill(spark, d):
    rows = cube_of_events(spark, d).where("stokes = 3").select("z", (F.col("y") * 24 + F.col("x")).alias("i"), F.col("v").cast("double").alias("v"))
    return resample.fill_nan(rows, "i", "z")


@query(
    "nan_block_fill",
    f"""WITH {CEV}, p AS (SELECT x, y, v FROM ev WHERE stokes = 1 AND z = 0), b AS (SELECT x // 4 AS bx, y // 4 AS b_y, avg(CAST(v AS DOUBLE)) FILTER (NOT isnan(v)) AS m FROM p GROUP BY ALL)
SELECT x, y, round(CASE WHEN isnan(v) THEN coalesce(m, {_NAN}) ELSE CAST(v AS DOUBLE) END, 6) AS v FROM p JOIN b ON bx = x // 4 AND b_y = y // 4""",
)
def nan_block_fill(spark, d):
    return rounded(resample.fill_blocks(profiles.plane(cube_of_events(spark, d), 0, 1)), "v")


@query("delta_encode", "SELECT o_orderkey, o_custkey, o_orderkey - coalesce(lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta_encode(spark, d):
    return resample.delta(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_orderkey", 2, "o_custkey")


def _smooth_sql() -> str:
    k = resample.gaussian_kernel(3)
    rows = ", ".join(f"({i - 2}, {w!r})" for i, w in enumerate(k))
    return f"""WITH {CLI}, k(o, w) AS (VALUES {rows}), p AS (SELECT x, y, CASE WHEN NOT isnan(v) THEN CAST(v AS DOUBLE) END AS v FROM li WHERE z = 0),
a AS (SELECT y, x + o AS x, sum(w * v) / sum(w) FILTER (v IS NOT NULL) AS v FROM p, k WHERE x + o BETWEEN 2 AND 29 GROUP BY ALL),
b AS (SELECT x, y + o AS y, sum(w * v) / sum(w) FILTER (v IS NOT NULL) AS v FROM a, k WHERE y + o BETWEEN 2 AND 29 GROUP BY a.x, a.y + o)
SELECT b.x - 2 AS x, b.y - 2 AS y, CASE WHEN p.v IS NULL THEN {_NAN} ELSE round(b.v, 6) END AS v FROM b JOIN p ON p.x = b.x AND p.y = b.y"""


@query("gaussian_smooth", _smooth_sql())
def gaussian_smooth(spark, d):
    return rounded(resample.gaussian_smooth(profiles.plane(cube_of_lineitem(spark, d)), 3, LI[0], LI[1]), "v")


@query(
    "contour_crossings",
    f"""WITH {EMB}, n AS (SELECT a.x, a.y, a.v, r.v AS rv, u.v AS uv FROM embf a LEFT JOIN embf r ON r.x = a.x + 1 AND r.y = a.y LEFT JOIN embf u ON u.x = a.x AND u.y = a.y + 1)
SELECT 'x' AS side, x, y, round(x + (0.05 - CAST(v AS DOUBLE)) / (CAST(rv AS DOUBLE) - CAST(v AS DOUBLE)), 6) AS at FROM n WHERE (v >= 0.05) <> (rv >= 0.05)
UNION ALL SELECT 'y', x, y, round(y + (0.05 - CAST(v AS DOUBLE)) / (CAST(uv AS DOUBLE) - CAST(v AS DOUBLE)), 6) FROM n WHERE (v >= 0.05) <> (uv >= 0.05)""",
)
def contour_crossings(spark, d):
    from ..operators.contour import crossings

    return rounded(crossings(image_of_embeddings(spark, d), 0.05), "at")


# --- regions ------------------------------------------------------------------------------------------------------

_RECT = Region("rectangle", ((15.0, 16.0), (9.0, 7.0)))
_TILTED = Region("polygon", ((3.0, 3.0), (20.0, 6.0), (17.0, 25.0), (5.0, 18.0)))
_OVAL = Region("ellipse", ((16.0, 15.0), (10.0, 6.0)))


def _region_stats(region: Region):
    return lambda spark, d: _stats(regions.region_stats(cube_of_lineitem(spark, d), region, "z"))


def _polygon_sql(points) -> str:
    odd, edge = [], []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        cross = f"({bx - ax} * (y - {ay}) - {by - ay} * (x - {ax}))"
        edge.append(f"(abs({cross}) <= 1e-6 AND x BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND y BETWEEN {min(ay, by)} AND {max(ay, by)})")
        odd.append(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < {bx - ax} * (y - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END")
    return f"(({' + '.join(odd)}) % 2 = 1 OR {' OR '.join(edge)})"


_REGION = "WITH {c}, t AS (SELECT z, {s} FROM li WHERE NOT isnan(v) AND {w} GROUP BY z) SELECT z, {d} FROM t"
query("region_stats_rect", _REGION.format(c=CLI, s=STATS, d=DERIVED, w="x BETWEEN 11 AND 19 AND y BETWEEN 13 AND 19"))(_region_stats(_RECT))
query("region_stats_poly", _REGION.format(c=CLI, s=STATS, d=DERIVED, w=_polygon_sql(list(_TILTED.points))))(_region_stats(_TILTED))
query("region_stats_ellipse", _REGION.format(c=CLI, s=STATS, d=DERIVED, w="(x - 16) * (x - 16) / 36.0 + (y - 15) * (y - 15) / 100.0 <= 1"))(_region_stats(_OVAL))


@query("region_histogram", _hist_sql(CLI, "SELECT v FROM li WHERE z = 1 AND NOT isnan(v) AND x BETWEEN 11 AND 19 AND y BETWEEN 13 AND 19", "floor(sqrt(9 * 7))"))
def region_histogram(spark, d):
    return _hist(regions.region_histogram(profiles.plane(cube_of_lineitem(spark, d), 1), _RECT))


@query("region_spectral", f"WITH {CEV} SELECT z, count(*) FILTER (NOT isnan(v)) AS num_pixels, round(coalesce(avg(CAST(v AS DOUBLE)) FILTER (NOT isnan(v)), {_NAN}), 6) AS mean FROM ev WHERE stokes = 1 AND x BETWEEN 2 AND 3 AND y BETWEEN 4 AND 5 GROUP BY z")
def region_spectral(spark, d):
    cube = cube_of_events(spark, d).where("stokes = 1")
    return rounded(regions.spectral_profile(cube, Region("rectangle", ((2.5, 4.5), (2.0, 2.0))), EV[2]), "mean").select("z", "num_pixels", "mean")


# --- moments ------------------------------------------------------------------------------------------------------


def _moments_sql() -> str:
    cols = ", ".join(f"round(coalesce({k}, {_NAN}), 6) AS {k}" for k in moments.KINDS)
    return f"""WITH {CLI}, p AS (SELECT y, x, CAST(v AS DOUBLE) AS i, 100.0 + z * 2.5 AS c FROM li WHERE NOT isnan(v) AND v BETWEEN 5 AND 1e9),
l AS (SELECT *, avg(i) OVER g AS mean, sum(i * c) OVER g / sum(i) OVER g AS m1, sum(i) OVER (PARTITION BY y, x ORDER BY c) * 2 >= sum(i) OVER g AS half FROM p WINDOW g AS (PARTITION BY y, x)),
m AS (SELECT y, x, sum(i) / count(*) AS average, sum(i) * 2.5 AS integrated, sum(i * c) / sum(i) AS weighted_coordinate, sqrt(sum(i * (c - m1) * (c - m1)) / sum(i)) AS weighted_dispersion, median(i) AS median,
 min(c) FILTER (half) AS median_coordinate, CASE WHEN count(*) > 1 THEN sqrt(greatest((sum(i * i) - sum(i) * sum(i) / count(*)) / (count(*) - 1), 0)) END AS standard_deviation, sqrt(sum(i * i) / count(*)) AS rms,
 sum(abs(i - mean)) / count(*) AS abs_mean_deviation, max(i) AS maximum, arg_min(c, (-i, c)) AS maximum_coordinate, min(i) AS minimum, arg_min(c, (i, c)) AS minimum_coordinate FROM l GROUP BY y, x)
SELECT y, x, {cols} FROM m"""


@query("moments", _moments_sql())
def all_moments(spark, d):
    got = moments.moments(cube_of_lineitem(spark, d), 100.0, 2.5, include=(1e9, 5.0))
    return rounded(got, *moments.KINDS).drop("stokes")


# --- polarization -------------------------------------------------------------------------------------------------

_WIDE = f"""WITH {CEV}, w AS (SELECT z, y, x, max(CAST(v AS DOUBLE)) FILTER (stokes = 0) AS i, max(CAST(v AS DOUBLE)) FILTER (stokes = 1) AS q, max(CAST(v AS DOUBLE)) FILTER (stokes = 2) AS u, max(CAST(v AS DOUBLE)) FILTER (stokes = 3) AS v FROM ev GROUP BY z, y, x)"""


@query(
    "polarization",
    f"""{_WIDE} SELECT z, y, x, {_r("sqrt(q*q+u*u+v*v)", "ptotal")}, {_r("sqrt(q*q+u*u)", "plinear")}, {_r("100*sqrt(q*q+u*u+v*v)/i", "pftotal")}, {_r("100*sqrt(q*q+u*u)/i", "pflinear")}, {_r("degrees(atan2(u,q))/2", "pangle")} FROM w""",
)
def polarization_planes(spark, d):
    names = ("ptotal", "plinear", "pftotal", "pflinear", "pangle")
    return rounded(polarization.computed(polarization.side_by_side(cube_of_events(spark, d))), *names).select("z", "y", "x", *names)


@query(
    "vector_field",
    f"""WITH {CEV}, b AS (SELECT stokes, z, y // 2 AS y, x // 2 AS x, coalesce(avg(CAST(v AS DOUBLE)) FILTER (NOT isnan(v)), {_NAN}) AS v FROM ev GROUP BY ALL),
w AS (SELECT z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, max(v) FILTER (stokes = 0) AS i, max(v) FILTER (stokes = 1) AS q, max(v) FILTER (stokes = 2) AS u FROM b GROUP BY z, y, x),
r AS (SELECT *, q*q+u*u-12.5 AS r FROM w)
SELECT z, y, x, CASE WHEN isnan(i) OR i < 60 OR isnan(r) OR r < 0 THEN {_NAN} ELSE round(sqrt(abs(r)), 6) END AS pi, CASE WHEN isnan(i) OR i < 60 OR isnan(q) OR isnan(u) THEN {_NAN} ELSE round(degrees(atan2(u, q)) / 2, 6) END AS pa FROM r""",
)
def vector_field(spark, d):
    return rounded(polarization.vector_field(cube_of_events(spark, d), 2, 60.0, 3.0, 4.0), "pi", "pa")


@query("stokes_concat", f"WITH {CEV} SELECT stokes, z, y, x, CAST(v AS DOUBLE) AS v FROM ev WHERE stokes < 3")
def stokes_concat(spark, d):
    cube = cube_of_events(spark, d)
    planes = {n: cube.where(F.col("stokes") == s).drop("stokes") for n, s in polarization.CODES.items() if s < 3}
    return polarization.concatenated(planes).select("stokes", "z", "y", "x", F.col("v").cast("double").alias("v"))


@query("image_arithmetic", f"WITH {CEV} SELECT a.z, a.y, a.x, {_r('CAST(a.v AS DOUBLE) * 2 - CAST(b.v AS DOUBLE)', 'v')} FROM ev a JOIN ev b USING (z, y, x) WHERE a.stokes = 0 AND b.stokes = 1")
def image_arithmetic(spark, d):
    from ..operators.expression import evaluate

    cube = cube_of_events(spark, d)
    return rounded(evaluate("a * 2 - b", {n: cube.where(F.col("stokes") == s).withColumn("stokes", F.lit(0)) for n, s in (("a", 0), ("b", 1))}), "v").select("z", "y", "x", "v")


@query("finite_pixels", f"WITH {CEV} SELECT stokes, count(*) AS n FROM ev WHERE NOT isnan(v) GROUP BY stokes")
def finite_pixels(spark, d):
    return cube_of_events(spark, d).where(finite(F.col("v"))).groupBy("stokes").agg(F.count("*").alias("n"))


@query(
    "percentiles",
    f"""WITH {CLI}, q AS (SELECT z, quantile_cont(CAST(v AS DOUBLE), [0.25, 0.5, 0.9]) AS q FROM li WHERE NOT isnan(v) GROUP BY z)
SELECT z, unnest([CAST(0.25 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS rank, round(unnest(q), 6) AS value FROM q""",
)
def percentiles(spark, d):
    return rounded(stats.exact_percentiles(cube_of_lineitem(spark, d), (0.25, 0.5, 0.9), "z"), "value").select("z", "rank", "value")


# --- view requests ------------------------------------------------------------------------------------------------


@query("latest_requests", "SELECT CAST(user_id AS VARCHAR) AS file_id, event_type AS kind, max(event_id) AS seq, arg_max(props, event_id) AS value FROM events GROUP BY ALL")
def latest_requests(spark, d):
    from ..streaming.reactive import latest

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("props").alias("value"))
    return latest(e)


@query("animation_frames", "SELECT event_id, CAST(2 + ((event_id + 1) % 4) * 2 AS INTEGER) AS frame, CAST(CASE WHEN event_id % 6 < 4 THEN event_id % 6 ELSE 6 - event_id % 6 END AS INTEGER) AS swing FROM events")
def animation_frames(spark, d):
    from ..streaming.reactive import frame_of

    t = F.col("event_id")
    return table(spark, d, "events").select("event_id", frame_of(t, 2, 8, 4, 2).alias("frame"), frame_of(t, 0, 3, 0, 1, reverse=True).alias("swing"))


@query("matched_channels", "SELECT event_id, CAST(least(greatest(round((value - 20.0) / 7.0), 0), 40) AS INTEGER) AS matched FROM events")
def matched_channels(spark, d):
    from ..streaming.reactive import matched_frames

    return matched_frames(table(spark, d, "events").select("event_id", F.col("value").alias("coordinate")), 20.0, 7.0, 41).select("event_id", "matched")


# --- without SQL: iterative or ordered results --------------------------------------------------------------------


@query("gaussian_fit")
def gaussian_fit(spark, d):
    """A Gaussian fitted to every channel."""
    from ..operators.fit import fit_gaussians

    return fit_gaussians(cube_of_lineitem(spark, d), [(16.0, 16.0, 50.0, 20.0, 20.0, 0.0)], {"pa"}, fit_background=True)


# With centre, widths and angle fixed, a fit is a linear regression on the Gaussian's shape; pa 0 points along y.
_SHAPE = "exp(-4 * ln(2) * (pow((y - 15.5) / 14.0, 2) + pow((x - 16.0) / 9.0, 2)))"
_LINEAR = f"""f AS (SELECT *, CAST(v AS DOUBLE) AS d, {_SHAPE} AS g FROM li WHERE NOT isnan(v)),
fitted AS (SELECT z, regr_slope(d, g) AS amp, regr_intercept(d, g) AS background FROM f GROUP BY z)"""


def _amplitudes(spark, d):
    from ..operators.fit import fit_gaussians

    return fit_gaussians(cube_of_lineitem(spark, d), [(16.0, 15.5, 10.0, 14.0, 9.0, 0.0)], {"cx", "cy", "fwhm_x", "fwhm_y", "pa"}, fit_background=True, unit="Jy/pixel")


@query(
    "gaussian_amplitudes",
    f"""WITH {CLI}, {_LINEAR}, m AS (SELECT z, median(d) AS mid FROM f GROUP BY z), s AS (SELECT z, 1.4826 * median(abs(d - mid)) AS noise FROM f JOIN m USING (z) GROUP BY z)
SELECT z, round(amp, 4) AS amp, round(background, 4) AS background, round(noise * sqrt(16 * ln(2) / (pi() * 14 * 9)), 4) AS amp_error,
round(amp * 14 * 9 * pi() / (4 * ln(2)), 2) AS flux FROM fitted JOIN s USING (z)""",
)
def gaussian_amplitudes(spark, d):
    """Amplitude and background of a source of known place and shape, in every channel."""
    got = rounded(_amplitudes(spark, d).select("z", "amp", "background", "amp_error", "flux"), "amp", "background", "amp_error", digits=4)
    return rounded(got, "flux", digits=2)


@query(
    "gaussian_fit_images",
    f"""WITH {CLI}, {_LINEAR}, i AS (SELECT li.z, li.y, li.x, CAST(v AS DOUBLE) AS v, background + amp * {_SHAPE} AS model FROM li JOIN fitted USING (z))
SELECT z, y, x, round(model, 3) AS model, {_r("v - model", "residual", 3)} FROM i""",
)
def gaussian_fit_images(spark, d):
    """Model and residual images of that fit."""
    from ..operators.fit import fit_images

    return rounded(fit_images(cube_of_lineitem(spark, d), _amplitudes(spark, d)).select("z", "y", "x", "model", "residual"), "model", "residual", digits=3)


def _contour_sql(level: float) -> str:
    """Directed segments of every cell, followed from the start of each line; closed lines from their smallest side."""
    side = {"B": "y * 8589934592 + x * 2", "R": "y * 8589934592 + (x + 1) * 2 + 1", "T": "(y + 1) * 8589934592 + x * 2", "L": "y * 8589934592 + x * 2 + 1"}
    point = {
        "B": (f"x + ({level} - p) / (q - p)", "y"),
        "R": ("x + 1", f"y + ({level} - q) / (r - q)"),
        "T": (f"x + ({level} - s) / (r - s)", "y + 1"),
        "L": ("x", f"y + ({level} - p) / (s - p)"),
    }
    ways = {1: "BL", 2: "RB", 3: "RL", 4: "TR", 6: "TB", 7: "TL", 8: "LT", 9: "BT", 11: "RT", 12: "LR", 13: "BR", 14: "LB"}
    rows = [(f"code = {code}", way) for code, way in ways.items()]
    high = f"(p + q + r + s) / 4 >= {level}"
    rows += [(f"code = 5 AND {high}", w) for w in ("BR", "TL")] + [(f"code = 5 AND NOT ({high})", w) for w in ("BL", "TR")]
    rows += [(f"code = 10 AND {high}", w) for w in ("RT", "LB")] + [(f"code = 10 AND NOT ({high})", w) for w in ("RB", "LT")]
    parts = " UNION ALL ".join(f"SELECT {side[w[0]]} AS a, {side[w[1]]} AS b, {point[w[0]][0]} AS ua, {point[w[0]][1]} AS va, {point[w[1]][0]} AS ub, {point[w[1]][1]} AS vb FROM coded WHERE {c}" for c, w in rows)
    return f"""WITH RECURSIVE {EMB}, g AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(v AS DOUBLE) AS v FROM emb),
cell AS (SELECT p.x, p.y, p.v AS p, q.v AS q, r.v AS r, s.v AS s FROM g p JOIN g q ON q.x = p.x + 1 AND q.y = p.y JOIN g r ON r.x = p.x + 1 AND r.y = p.y + 1 JOIN g s ON s.x = p.x AND s.y = p.y + 1),
coded AS (SELECT *, CAST(p >= {level} AS INTEGER) + CAST(q >= {level} AS INTEGER) * 2 + CAST(r >= {level} AS INTEGER) * 4 + CAST(s >= {level} AS INTEGER) * 8 AS code FROM cell),
seg AS ({parts}),
walk AS (SELECT a AS line, a, b, ua, va, ub, vb, 0 AS i, a NOT IN (SELECT b FROM seg) AS open FROM seg
  UNION ALL SELECT w.line, s.a, s.b, s.ua, s.va, s.ub, s.vb, w.i + 1, w.open FROM walk w JOIN seg s ON s.a = w.b WHERE s.a <> w.line AND (w.open OR s.a > w.line)),
ends AS (SELECT line, max(i) AS last FROM walk WHERE open OR b = line GROUP BY line)
SELECT {level} AS level, line, CAST(i AS BIGINT) AS i, round(ua, 6) AS x, round(va, 6) AS y FROM walk JOIN ends USING (line)
UNION ALL SELECT {level}, line, CAST(i + 1 AS BIGINT), round(ub, 6), round(vb, 6) FROM walk JOIN ends USING (line) WHERE i = last"""


@query("contour_lines", _contour_sql(0.2))
def contour_lines(spark, d):
    """Lines of the embeddings image, traced in pieces of 32 pixels and joined."""
    from ..operators.contour import contours

    return rounded(contours(image_of_embeddings(spark, d), [0.2], piece=32), "x", "y").select("level", "line", "i", "x", "y")


@query("raster_tiles")
def raster_tiles(spark, d):
    return resample.tile_rows(image_of_embeddings(spark, d), 2, 16)


_FWHM2 = "(8 * ln(2))"


@query(
    "common_beam",
    f"""WITH {CLI}, k0 AS (SELECT z, (25 - pow(2 + z / 4.0, 2)) / {_FWHM2} AS sx, (16 - 4) / {_FWHM2} AS sy FROM (SELECT DISTINCT z FROM li)),
k1 AS (SELECT *, CAST(floor(5 * sqrt(greatest(sx, sy)) + 0.5) AS INTEGER) + 1 AS h FROM k0),
k2 AS (SELECT z, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, exp(-0.5 * (i * i / sx + j * j / sy)) AS w FROM k1, range(-40, 41) a(i), range(-40, 41) b(j) WHERE abs(i) <= h AND abs(j) <= h),
k3 AS (SELECT *, w / sum(w) OVER (PARTITION BY z) AS share FROM k2),
c AS (SELECT p.z, p.y + j AS y, p.x + i AS x, sum(CAST(p.v AS DOUBLE) * share) AS s FROM li p JOIN k3 USING (z) WHERE NOT isnan(p.v) GROUP BY ALL)
SELECT 0 AS stokes, li.z, li.y, li.x, CASE WHEN isnan(v) THEN {_NAN} ELSE round(coalesce(s, 0), 4) END AS v FROM li LEFT JOIN c ON c.z = li.z AND c.y = li.y AND c.x = li.x""",
)
def common_beam(spark, d):
    """Every channel brought to one beam, in tiles of 16 pixels and more."""
    from ..operators.fit import convolve_planes

    return rounded(convolve_planes(cube_of_lineitem(spark, d), {z: (2.0 + z / 4, 2.0, 0.0) for z in range(LI[2])}, (5.0, 4.0, 0.0), side=16), "v", digits=4)
