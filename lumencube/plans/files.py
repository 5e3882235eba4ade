"""Queries of sources and sinks over files written from the driver's tables, of file information, regions and world coordinates.

Every query writes its files to a folder of its own in the shared folder and reads them back with the library's readers.
"""

from __future__ import annotations

import gzip
import html
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, text
from ..operators import catalog, fit, moments, polarization, profiles, regions, resample, stats, world
from ..operators.numbering import numbered
from ..operators.regions import Region
from ..scratch import shared_folder
from ..sources import files, fits, region_text, tiled, votable
from ..sources.cubes import EV, cube_of_events, cube_of_lineitem, image_of_embeddings, table
from .registry import CEV, CLI, DERIVED, EMB, EMPTY_SAFE, STATS, _polygon_sql, _stats, query, rounded

_SUPPLIER_FIELDS = '<FIELD name="s_suppkey" ID="c0" datatype="long" ucd="meta.id"/><FIELD name="s_name" ID="c1" datatype="char" arraysize="*"/><FIELD name="s_nationkey" ID="c2" datatype="int"/><FIELD name="s_acctbal" ID="c3" datatype="double" unit="USD"/><FIELD name="rich" ID="c4" datatype="boolean"/><FIELD name="pair" ID="c5" datatype="float" arraysize="2"/>'


def _votable(spark, d: str) -> str:
    """supplier as a VOTable: a small dimension table, written by one process."""
    path = os.path.join(shared_folder(spark, "votable"), "supplier.xml")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0"?><VOTABLE version="1.3"><RESOURCE><DESCRIPTION>Suppliers</DESCRIPTION><COOSYS ID="s" system="ICRS" equinox="J2000"/><PARAM name="origin" datatype="char" arraysize="*" value="tables"/><TABLE name="supplier" nrows="{table(spark, d, "supplier").count()}">{_SUPPLIER_FIELDS}<DATA><TABLEDATA>\n')
        for r in table(spark, d, "supplier").toLocalIterator():
            f.write(f"<TR><TD>{r['s_suppkey']}</TD><TD>{html.escape(r['s_name'])}</TD><TD>{r['s_nationkey']}</TD><TD>{r['s_acctbal']!r}</TD><TD>{'T' if r['s_acctbal'] > 5000 else 'false'}</TD><TD>1 2</TD></TR>\n")
        f.write("</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>\n")
    return path


@query("votable_rows", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal > 5000 AS rich FROM supplier")
def votable_rows(spark, d) -> DataFrame:
    """Rows of a VOTable; the file holds them in the order of the table's key."""
    spark.dataSource.register(votable.VoTable)
    rows = spark.read.format("votable").load(_votable(spark, d))
    return numbered(rows.drop("row_id"), ["s_suppkey"]).select(rows.columns)


@query("votable_header", """SELECT * FROM (VALUES (0, 's_suppkey', 'long', '', true), (1, 's_name', 'char', '', true), (2, 's_nationkey', 'int', '', true), (3, 's_acctbal', 'double', 'USD', true), (4, 'rich', 'boolean', '', true), (5, 'pair', 'float', '', false)) t(i, name, datatype, unit, supported)""")
def votable_header(spark, d) -> DataFrame:
    head = votable.read_header(_votable(spark, d))
    return spark.createDataFrame([(i, f.name, f.datatype, f.unit, f.supported) for i, f in enumerate(head.fields)], "i int, name string, datatype string, unit string, supported boolean")


@query("votable_metadata", "SELECT * FROM (VALUES ('table', 'supplier'), ('description', 'Suppliers'), ('origin', 'tables'), ('system', 'ICRS'), ('equinox', 'J2000')) t(key, value) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM supplier")
def votable_metadata(spark, d) -> DataFrame:
    h = votable.read_header(_votable(spark, d))
    found = {"table": h.name, "description": h.description, "rows": str(h.rows), **h.params, **{k: v for c in h.coosys for k, v in c.items() if k != "ID"}}
    return spark.createDataFrame(sorted(found.items()), "key string, value string")


@query("fits_table_rows", "SELECT o_orderkey AS k, CAST(o_custkey AS INTEGER) AS c, o_orderstatus AS status, o_totalprice AS price, CAST(o_totalprice AS FLOAT) AS price4, CAST(o_custkey % 100 AS SMALLINT) AS small, o_totalprice > 100000 AS large FROM orders")
def fits_table_rows(spark, d) -> DataFrame:
    """orders through a binary table: written by tasks at their places, read by row ranges."""
    path = os.path.join(shared_folder(spark, "table"), "orders.fits")
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("int").alias("c"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_totalprice").cast("float").alias("price4"), (F.col("o_custkey") % 100).cast("smallint").alias("small"), (F.col("o_totalprice") > 100000).alias("large"))
    fits.save_table(numbered(rows, ["k"]), path)
    spark.dataSource.register(fits.FitsTable)
    return spark.read.format("fits_table").load(path).drop("row_id")


def _saved_events(spark, d, **how) -> str:
    path = os.path.join(shared_folder(spark, "image"), "events.fits")
    fits.save_image(cube_of_events(spark, d), path, {"BUNIT": "Jy/beam", "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CTYPE3": "FREQ", "CDELT1": -0.5, "CDELT2": 0.5, "BMAJ": 2.0, "BMIN": 1.0, "BPA": 30.0}, **how)
    return path


def _read(spark, path: str) -> DataFrame:
    return files.open_image(spark, path).select("stokes", "z", "y", "x", F.col("v").cast("double").alias("v"))


@query("fits_image_rows", f"WITH {CEV} SELECT stokes, z, y, x, CAST(v AS DOUBLE) AS v FROM ev")
def fits_image_rows(spark, d) -> DataFrame:
    """A cube written plane by plane by tasks, and read back by row ranges."""
    return _read(spark, _saved_events(spark, d))


@query("fits_image_gz", f"WITH {CEV} SELECT stokes, z, y, x, CAST(v AS DOUBLE) AS v FROM ev WHERE stokes = 1")
def fits_image_gz(spark, d) -> DataFrame:
    path = _saved_events(spark, d)
    with open(path, "rb") as f, gzip.open(path + ".gz", "wb") as g:
        while part := f.read(1 << 20):
            g.write(part)
    return _read(spark, path + ".gz").where("stokes = 1")


@query("fits_tiled_rows", f"WITH {CEV} SELECT stokes, z, y, x, round(CAST(v AS DOUBLE) * 100) AS cents FROM ev")
def fits_tiled_rows(spark, d) -> DataFrame:
    """The cube in hundredths, Rice-coded row by row by tasks, and read back by ranges of tiles."""
    path = os.path.join(shared_folder(spark, "image"), "events.fits.fz")
    tiled.save_tiled(cube_of_events(spark, d), path, step=0.01)
    return _read(spark, path).select("stokes", "z", "y", "x", F.when(F.isnan("v"), F.lit(exprs.NAN)).otherwise(F.round(F.col("v") * 100)).alias("cents"))


@query("fits_tiled_lossless", f"WITH {CLI} SELECT z, y, x, CAST(v AS DOUBLE) AS v FROM li")
def fits_tiled_lossless(spark, d) -> DataFrame:
    """Floating-point pixels as they are, byte-shuffled and compressed row by row."""
    path = os.path.join(shared_folder(spark, "image"), "lineitem.fits.fz")
    tiled.save_tiled(cube_of_lineitem(spark, d), path)
    return _read(spark, path).drop("stokes")


@query("fits_export_channels", f"WITH {CEV} SELECT CAST((z - 0) // 2 AS INTEGER) AS z, y, x, CAST(v AS DOUBLE) AS v FROM ev WHERE stokes = 2 AND z IN (0, 2, 4)")
def fits_export_channels(spark, d) -> DataFrame:
    """Every second channel of one polarization, written as an image of its own."""
    return _read(spark, _saved_events(spark, d, channels=(0, 4, 2), stokes=(2, 2, 1))).drop("stokes")


@query("fits_export_region", f"WITH {CLI} SELECT z, y - 13 AS y, x - 11 AS x, CAST(v AS DOUBLE) AS v FROM li WHERE x BETWEEN 11 AND 19 AND y BETWEEN 13 AND 19")
def fits_export_region(spark, d) -> DataFrame:
    """The pixels of a region, written as an image of the size of its box."""
    path = os.path.join(shared_folder(spark, "image"), "part.fits")
    fits.save_image(regions.masked(cube_of_lineitem(spark, d), Region("rectangle", ((15.0, 16.0), (9.0, 7.0)))), path)
    return _read(spark, path).drop("stokes")


@query("hdu_list", "SELECT 0 AS hdu, '' AS name, '24x30x5x4' AS shape")
def hdu_list(spark, d) -> DataFrame:
    return spark.createDataFrame([(i, n, "x".join(map(str, s))) for i, n, s in fits.hdu_list(_saved_events(spark, d))], "hdu int, name string, shape string")


@query("file_info", """SELECT * FROM (VALUES ('HDU', '0'), ('Data type', 'float'), ('Shape', '[24, 30, 5, 4]'), ('Number of channels', '5'), ('Number of polarizations', '4'), ('Pixel increment', '[-0.5, 0.5]'), ('Pixel unit', 'Jy/beam'), ('Beam', '[2.0, 1.0, 30.0]')) t(key, value)""")
def file_info(spark, d) -> DataFrame:
    wanted = ("HDU", "Data type", "Shape", "Number of channels", "Number of polarizations", "Pixel increment", "Pixel unit", "Beam")
    return fits.file_info(spark, _saved_events(spark, d)).where("section = 'computed'").where(F.col("key").isin(*wanted)).select("key", "value")


@query("beam_sources", "SELECT origin, channel, CAST(major AS DOUBLE) AS major, CAST(minor AS DOUBLE) AS minor, CAST(angle AS DOUBLE) AS angle FROM (VALUES ('header', 0, 2.0, 1.0, 30.0), ('table', 0, 0.002, 0.001, 5.0), ('table', 1, 0.003, 0.001, 6.0), ('history', 0, 0.5, 0.25, -10.0)) t(origin, channel, major, minor, angle)")
def beam_sources(spark, d) -> DataFrame:
    """The beam from the header, from a table of beams by channel, and from the history."""
    folder = shared_folder(spark, "beams")
    plain, per, told = (os.path.join(folder, n) for n in ("header.fits", "table.fits", "history.fits"))
    image = cube_of_lineitem(spark, d).where("z = 0")
    fits.save_image(image, plain, {"BMAJ": 2.0, "BMIN": 1.0, "BPA": 30.0})
    fits.save_table(spark.createDataFrame([(0, 7.2, 3.6, 5.0), (1, 10.8, 3.6, 6.0)], "row_id long, BMAJ double, BMIN double, BPA double"), per)
    with open(per, "r+b") as f:  # name the table
        data = f.read()
        at = data.index(b"TFIELDS")
        end = data.index(b"END" + b" " * 77, at)
        f.seek(end)
        f.write(b"EXTNAME = 'BEAMS   '".ljust(80) + b"END".ljust(80))
    with open(plain, "rb") as f:
        data = f.read()
    with open(told, "wb") as f:
        at = data.index(b"BMAJ")
        f.write(data[:at] + b"HISTORY CLEAN BMAJ=  0.5 BMIN=  0.25 BPA= -10.0".ljust(80) + b"COMMENT".ljust(80) * 2 + data[at + 240 :])
    rows = [(o, i, *map(float, b)) for o, p in (("header", plain), ("table", per), ("history", told)) for i, b in enumerate(fits.beams(p))]
    return rounded(spark.createDataFrame(rows, "origin string, channel int, major double, minor double, angle double"), "major", "minor", "angle")


def _mixed_folder(spark, d) -> str:
    folder = shared_folder(spark, "listing")
    fits.save_image(cube_of_lineitem(spark, d).where("z = 0"), os.path.join(folder, "a.fits"))
    for name, start in (("b.xml", b"<?xml version='1.0'?>"), ("c.reg", b"# Region file format: DS9\nimage\n"), ("d.crtf", b"#CRTFv0\n"), ("e.bin", b"nothing"), ("f.h5", b"\x89HDF\r\n\x1a\n")):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(start)
    return folder


@query("listing", "SELECT * FROM (VALUES ('a.fits', 'fits', CAST(8640 AS BIGINT)), ('b.xml', 'votable', 21), ('c.reg', 'ds9', 32), ('d.crtf', 'crtf', 8), ('e.bin', 'unknown', 7), ('f.h5', 'hdf5', 8)) t(name, type, size)")
def listing(spark, d) -> DataFrame:
    return files.listing(spark, _mixed_folder(spark, d)).select("name", "type", "size")


@query("listing_counts", "SELECT * FROM (VALUES ('fits', CAST(1 AS BIGINT), CAST(8640 AS BIGINT)), ('votable', 1, 21), ('ds9', 1, 32), ('crtf', 1, 8), ('unknown', 1, 7), ('hdf5', 1, 8)) t(type, files, bytes)")
def listing_counts(spark, d) -> DataFrame:
    return files.counts(files.listing(spark, _mixed_folder(spark, d)))


@query("type_by_name", "SELECT * FROM (VALUES ('x.fits', 'fits', 'fits', 'unknown'), ('x.FITS.GZ', 'fits_gz', 'unknown', 'unknown'), ('x.xml', 'unknown', 'votable', 'unknown'), ('x.reg', 'unknown', 'unknown', 'ds9'), ('x.crtf', 'unknown', 'unknown', 'crtf'), ('x', 'unknown', 'unknown', 'unknown')) t(path, image, catalog, region)")
def type_by_name(spark, d) -> DataFrame:
    names = ("x.fits", "x.FITS.GZ", "x.xml", "x.reg", "x.crtf", "x")
    return spark.createDataFrame([(n, *(files.guess(n, w, by_content=False) for w in ("image", "table", "region"))) for n in names], "path string, image string, catalog string, region string")


@query("units", "SELECT * FROM (VALUES ('JY/BEAM', 'Jy/beam'), ('Jy beam-1', 'Jy/beam'), (' jansky ', 'Jy'), ('KELVIN', 'K'), ('km s**-1', 'km/s'), ('furlong', 'furlong')) t(spelling, unit)")
def units(spark, d) -> DataFrame:
    return spark.createDataFrame([(u, files.normal_unit(u)) for u in ("JY/BEAM", "Jy beam-1", " jansky ", "KELVIN", "km s**-1", "furlong")], "spelling string, unit string")


@query(
    "angles",
    """WITH t AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) / 30 AS v FROM supplier), u AS (SELECT *, CAST(round(abs(v) * 3600 * 1000) AS BIGINT) AS a, CAST(round(abs(v) / 15 * 3600 * 10000) AS BIGINT) AS b FROM t)
SELECT s_suppkey, (CASE WHEN v < 0 THEN '-' ELSE '+' END) || lpad(CAST(a // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(a // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') AS dms,
(CASE WHEN v < 0 THEN '-' ELSE '' END) || lpad(CAST(b // 36000000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 600000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 10000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(b % 10000 AS VARCHAR), 4, '0') AS hours FROM u""",
)
def angles(spark, d) -> DataFrame:
    v = F.col("s_acctbal").cast("double") / 30
    return table(spark, d, "supplier").select("s_suppkey", files.sexagesimal_column(v).alias("dms"), files.sexagesimal_column(v, True).alias("hours"))


@query("cutout_address", "SELECT 'https://h/x?hips=CDS%2FP&width=100&height=50&fov=1.5&projection=TAN&coordsys=icrs&rotation_angle=0.0&ra=10.0&dec=-5.0&format=fits' AS address")
def cutout_address(spark, d) -> DataFrame:
    return spark.createDataFrame([(files.cutout_address("https://h/x", "CDS/P", 100, 50, 1.5, 10.0, -5.0),)], "address string")


@query("text_helpers", "SELECT c_custkey, regexp_extract(c_name, '#(.*)$', 1) AS last, ends_with(lower(c_name), '7') AS seven, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS number, url_encode(c_name || ' /x') AS address FROM customer")
def text_helpers(spark, d) -> DataFrame:
    name = F.col("c_name")
    last = F.element_at(text.parts(name, "#"), -1)
    address = text.escaped(F.concat(name, F.lit(" /x")))
    return table(spark, d, "customer").select("c_custkey", last.alias("last"), text.has_suffix(name, "7").alias("seven"), text.as_int(last).alias("number"), F.when(text.unescaped(address) == F.concat(name, F.lit(" /x")), address).alias("address"))


# --- regions ------------------------------------------------------------------------------------------------------

_SHAPES = [Region("rectangle", ((5.0, 5.0), (4.0, 3.0))), Region("rectangle", ((5.0, 5.0), (4.0, 3.0)), 30.0), Region("ellipse", ((6.0, 7.0), (4.0, 3.0)), 20.0), Region("polygon", ((1.0, 1.0), (1.0, 4.0), (4.0, 4.0))), Region("point", ((3.0, 2.0),)), Region("line", ((9.0, 5.0), (1.0, 5.0)))]
_SHAPE_ROWS = ", ".join(f"({n}, '{r.kind}', {i}, {p[0]}, {p[1]}, {r.rotation})" for n, r in enumerate(_SHAPES) for i, p in enumerate(r.points))


def _shape_rows(spark, shapes: list[Region]) -> DataFrame:
    return rounded(spark.createDataFrame([(n, r.kind, i, *map(float, p), float(r.rotation)) for n, r in enumerate(shapes) for i, p in enumerate(r.points)], "n int, kind string, i int, x double, y double, rotation double"), "x", "y", "rotation", digits=3)


for _name, _out, _in in (("region_text_crtf", region_text.to_crtf, region_text.from_crtf), ("region_text_ds9", region_text.to_ds9, region_text.from_ds9)):
    query(_name, f"SELECT n, kind, i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(rotation AS DOUBLE) AS rotation FROM (VALUES {_SHAPE_ROWS}) t(n, kind, i, x, y, rotation)")(lambda spark, d, o=_out, i=_in: _shape_rows(spark, i(o(_SHAPES))[0]))

_TURNED = Region("rectangle", ((16.0, 15.0), (14.0, 8.0)), 30.0)


@query("region_stats_rotated", f"WITH {CLI}, t AS (SELECT z, {STATS} FROM li WHERE NOT isnan(v) AND abs((x - 16) * cos(radians(30)) + (y - 15) * sin(radians(30))) <= 7 + 1e-9 AND abs((y - 15) * cos(radians(30)) - (x - 16) * sin(radians(30))) <= 4 + 1e-9 GROUP BY z) SELECT z, {DERIVED} FROM t")
def region_stats_rotated(spark, d) -> DataFrame:
    return _stats(regions.region_stats(cube_of_lineitem(spark, d), _TURNED, "z"))


@query(
    "region_spectral_stats",
    f"""WITH {CEV}, t AS (SELECT z, {STATS} FROM ev WHERE stokes = 0 AND NOT isnan(v) AND x BETWEEN 2 AND 9 AND y BETWEEN 4 AND 12 GROUP BY z)
SELECT z, {EMPTY_SAFE} FROM (SELECT CAST(k AS INTEGER) AS z FROM range(7) r(k)) LEFT JOIN t USING (z)""",
)
def region_spectral_stats(spark, d) -> DataFrame:
    """All basic statistics per channel, channels without pixels included; the last two have none."""
    return _stats(regions.spectral_profile(cube_of_events(spark, d).where("stokes = 0"), Region("rectangle", ((5.5, 8.0), (8.0, 9.0))), EV[2] + 2))


@query("stats_requested", f"WITH {CLI}, f AS (SELECT * FROM li WHERE NOT isnan(v)), t AS (SELECT z, {STATS} FROM f GROUP BY z), n AS (SELECT z, count(*) FILTER (isnan(v)) AS nan_count FROM li GROUP BY z) SELECT z, {DERIVED}, nan_count, round(s / 9.0, 6) AS flux_density, CAST(CASE WHEN abs(lo) > abs(hi) THEN lo ELSE hi END AS DOUBLE) AS extrema FROM t JOIN n USING (z)")
def stats_requested(spark, d) -> DataFrame:
    """The whole set of statistics that a view can ask for, in one table."""
    cube = cube_of_lineitem(spark, d)
    basic = stats.extrema(stats.flux_density(stats.basic_stats(cube, "z"), 9.0))
    return rounded(_stats(basic).join(stats.nan_count(cube, "z").drop("total"), "z"), "flux_density")


def _regions_of(spark, d) -> DataFrame:
    """s_suppkey, kind, points, rotation: a region of each supplier; some have no size, some are annotations."""
    t = table(spark, d, "supplier")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k, cx, cy, w, h = F.col("s_suppkey") % 6, F.col("s_suppkey") % 32, F.col("s_nationkey"), F.col("s_acctbal") / 1000, 1 + F.col("s_suppkey") % 5
    kind = F.element_at(F.array(*[F.lit(n) for n in ("rectangle", "ellipse", "polygon", "point", "line", "ann_rectangle")]), (k + 1).cast("int"))
    centre, size, far = point(cx, cy), point(w, h), point(cx + w, cy + h)
    points = F.when(k == 2, F.array(centre, far, point(cx, cy + h))).when(k == 3, F.array(centre)).when(k == 4, F.array(centre, far)).otherwise(F.array(centre, size))
    return t.select("s_suppkey", kind.alias("kind"), points.alias("points"), (F.col("s_nationkey") * 10.0).alias("rotation"))


_OWN = """s AS (SELECT s_suppkey, s_suppkey % 6 AS k, CAST(s_suppkey % 32 AS DOUBLE) AS cx, CAST(s_nationkey AS DOUBLE) AS cy, CAST(s_acctbal AS DOUBLE) / 1000 AS w, CAST(1 + s_suppkey % 5 AS DOUBLE) AS h, s_nationkey * 10.0::DOUBLE AS rot FROM supplier)"""


@query("region_checks", f"WITH {_OWN} SELECT s_suppkey, k <> 5 AND (k > 1 OR w > 0) AS accepted FROM s")
def region_checks(spark, d) -> DataFrame:
    return _regions_of(spark, d).select("s_suppkey", regions.accepted(F.col("kind"), F.col("points")).alias("accepted"))


@query(
    "region_corners",
    f"""WITH {_OWN}, c AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) v(i, a, b))
SELECT s_suppkey, i, round(cx + cos(radians(rot)) * w * a / 2 - sin(radians(rot)) * h * b / 2, 6) AS x, round(cy + sin(radians(rot)) * w * a / 2 + cos(radians(rot)) * h * b / 2, 6) AS y FROM s, c WHERE k = 0 AND w > 0
UNION ALL SELECT s_suppkey, 0, cx, cy FROM s WHERE k = 2 UNION ALL SELECT s_suppkey, 1, round(cx + w, 6), cy + h FROM s WHERE k = 2 UNION ALL SELECT s_suppkey, 2, cx, cy + h FROM s WHERE k = 2""",
)
def region_corners(spark, d) -> DataFrame:
    r = _regions_of(spark, d).where(regions.accepted(F.col("kind"), F.col("points")))
    corners = r.select("s_suppkey", F.posexplode(regions.corner_points(F.col("kind"), F.col("points"), F.col("rotation"))).alias("i", "p"))
    return rounded(corners.select("s_suppkey", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "x", "y")


@query(
    "region_records",
    f"""WITH {_OWN} SELECT s_suppkey, CASE k WHEN 0 THEN 'polygon' WHEN 1 THEN 'ellipsoid' WHEN 2 THEN 'polygon' WHEN 3 THEN 'box' ELSE 'line' END AS shape, CASE k WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 2 END AS points,
CASE WHEN k = 1 THEN round(greatest(w, h), 6) END AS longer, CASE WHEN k = 1 THEN (rot + CASE WHEN h > w THEN 0 ELSE 90 END) % 360 END AS angle FROM s WHERE k <> 5 AND (k > 1 OR w > 0)""",
)
def region_records(spark, d) -> DataFrame:
    r = _regions_of(spark, d).select("s_suppkey", regions.records(F.col("kind"), F.col("points"), F.col("rotation")).alias("r")).where("r is not null")
    at = lambda i, c: F.when(F.col("r.shape") == "ellipsoid", F.col("r.points")[i][c])
    return r.select("s_suppkey", "r.shape", F.size("r.points").alias("points"), F.round(at(1, "x"), 6).alias("longer"), at(2, "x").alias("angle"))


# --- world coordinates --------------------------------------------------------------------------------------------

_SKY = world.Grid((12.0, 15.0), (40.0, -30.0), (-0.5, 0.5))
_TAN = "WITH p AS (SELECT event_id, hour(ts) AS x, day(ts) - 1 AS y FROM events), u AS (SELECT *, radians((x - 12) * -0.5) AS xi, radians((y - 15) * 0.5) AS eta, radians(-30) AS d0 FROM p)"


@query("world_tan", f"{_TAN} SELECT event_id, round(40 + degrees(atan2(xi, cos(d0) - eta * sin(d0))), 9) AS a, round(degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + power(cos(d0) - eta * sin(d0), 2)))), 9) AS d FROM u")
def world_tan(spark, d) -> DataFrame:
    a, b = _SKY.world(F.hour("ts"), F.dayofmonth("ts") - 1)
    return rounded(table(spark, d, "events").select("event_id", a.alias("a"), b.alias("d")), "a", "d", digits=9)


@query("world_and_back", "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS x, CAST(day(ts) - 1 AS DOUBLE) AS y FROM events")
def world_and_back(spark, d) -> DataFrame:
    a, b = _SKY.world(F.hour("ts"), F.dayofmonth("ts") - 1)
    there = table(spark, d, "events").select("event_id", a.alias("a"), b.alias("d"))
    x, y = _SKY.pixels(F.col("a"), F.col("d"))
    return rounded(there.select("event_id", x.alias("x"), y.alias("y")), "x", "y")


@query("region_matched", f"WITH {CLI}, t AS (SELECT z, {STATS} FROM li WHERE NOT isnan(v) AND x BETWEEN 4 AND 20 AND y BETWEEN 7 AND 23 GROUP BY z) SELECT z, {DERIVED} FROM t")
def region_matched(spark, d) -> DataFrame:
    """A rectangle of an image with pixels twice as large, as a region of this one."""
    coarse, fine = (world.Grid(p, (10.0, 20.0), (s, s), "linear") for p, s in (((8.0, 8.0), 1.0), ((16.0, 16.0), 0.5)))
    region = world.matched(Region("rectangle", ((6.0, 7.5), (8.0, 8.0))), coarse, fine)
    return _stats(regions.region_stats(cube_of_lineitem(spark, d), region, "z"))


@query("region_matched_tan", f"WITH {CLI}, t AS (SELECT z, {STATS} FROM li WHERE NOT isnan(v) AND {_polygon_sql(list(world.matched(Region('polygon', ((4.0, 5.0), (20.0, 6.0), (15.0, 25.0))), _SKY, world.Grid((16.0, 16.0), (40.5, -30.2), (-0.4, 0.4))).points))} GROUP BY z) SELECT z, {DERIVED} FROM t")
def region_matched_tan(spark, d) -> DataFrame:
    region = world.matched(Region("polygon", ((4.0, 5.0), (20.0, 6.0), (15.0, 25.0))), _SKY, world.Grid((16.0, 16.0), (40.5, -30.2), (-0.4, 0.4)))
    return _stats(regions.region_stats(cube_of_lineitem(spark, d), region, "z"))


@query("angular_spacing", "SELECT true AS even, true AS whole, true AS bent")
def angular_spacing(spark, d) -> DataFrame:
    """Positions along a line across the sky at equal angles, where equal pixels would not do."""
    wide = world.Grid((0.0, 0.0), (40.0, -30.0), (-2.0, 2.0))
    line = ((0.0, 0.0), (24.0, 18.0))
    at = world.angular_steps(line, wide, 2.0)
    apart = [world.separation(wide.world_of(p), wide.world_of(q)) for p, q in zip(at[:-1], at[1:], strict=True)]
    pixels = [world.separation(wide.world_of((0.8 * k, 0.6 * k)), wide.world_of((0.8 * (k + 1), 0.6 * (k + 1)))) for k in range(30)]
    rest = world.separation(wide.world_of(at[-1]), wide.world_of(line[1]))
    return spark.createDataFrame([(all(abs(s - 2.0) <= 0.02 for s in apart), rest < 2.0, not profiles.is_linear(pixels, 2.0))], "even boolean, whole boolean, bent boolean")


# --- catalogs, moments and the rest -------------------------------------------------------------------------------


@query("cat_no_filter", "SELECT s_suppkey AS row_id, s_name FROM supplier")
def cat_no_filter(spark, d) -> DataFrame:
    return catalog.select_rows(catalog.with_row_id(table(spark, d, "supplier"), "s_suppkey"), []).select("row_id", "s_name")


@query("cat_restored", "SELECT s_suppkey AS row_id FROM supplier ORDER BY s_suppkey LIMIT 7")
def cat_restored(spark, d) -> DataFrame:
    rows = catalog.with_row_id(table(spark, d, "supplier"), "s_suppkey")
    return catalog.restored(catalog.ordered(rows, "s_acctbal", True)).select("row_id").limit(7)


@query("cat_page_numbers", "SELECT vec_id, CAST(vec_id // 50 AS BIGINT) AS page, CAST(vec_id % 50 AS BIGINT) AS place FROM embeddings")
def cat_page_numbers(spark, d) -> DataFrame:
    return catalog.page_numbers(table(spark, d, "embeddings").select("vec_id"), 50, "vec_id")


@query("cat_sort_refused", "SELECT * FROM (VALUES ('embedding', false), ('label', true), ('vec_id', true)) t(name, accepted)")
def cat_sort_refused(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")

    def ok(name: str) -> bool:
        try:
            catalog.ordered(rows, name, row_id="vec_id")
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(n, ok(n)) for n in ("embedding", "label", "vec_id")], "name string, accepted boolean")


@query("moments_guarded", f"WITH {CLI} SELECT y, x, round(avg(CAST(v AS DOUBLE)), 6) AS average, round(max(CAST(v AS DOUBLE)), 6) AS maximum FROM li WHERE NOT isnan(v) AND v BETWEEN -10 AND 1e9 GROUP BY y, x")
def moments_guarded(spark, d) -> DataFrame:
    """A median coordinate is asked for, but the range spans zero: it is left out."""
    got = moments.moments(cube_of_lineitem(spark, d), include=(-10.0, 1e9), kinds=("average", "median_coordinate", "maximum"))
    return rounded(got.drop("stokes"), "average", "maximum")


@query("gaussian_model", f"""WITH {CLI} SELECT z, x, y, round(CAST(v AS DOUBLE) - 2.0 - 10 * exp(-4 * ln(2) * (power((x - 8) / 6.0, 2) + power((y - 7) / 4.0, 2))) - 5 * exp(-4 * ln(2) * (power((x - 20) / 3.0, 2) + power((y - 21) / 9.0, 2))), 6) + 0.0 AS v FROM li WHERE NOT isnan(v)""")
def gaussian_model(spark, d) -> DataFrame:
    """A cube less a model of two components, one along x and one along y."""
    parts = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(fit.PARAMS, c, strict=True)]) for c in ((8, 7, 10, 6, 4, 90), (20, 21, 5, 9, 3, 0))])
    image = cube_of_lineitem(spark, d).where(~F.isnan("v"))
    return rounded(image.select("z", "x", "y", (F.col("v").cast("double") - fit.model_column(parts, F.lit(2.0))).alias("v")), "v")


@query("vertex_rounding", f"WITH {EMB} SELECT x, y, round(CAST(v AS DOUBLE) * 4) / 4 + 0.0 AS v FROM emb WHERE NOT isnan(v)")
def vertex_rounding(spark, d) -> DataFrame:
    return image_of_embeddings(spark, d).where(~F.isnan("v")).select("x", "y", resample.round_vertex(F.col("v"), 4).alias("v"))


@query("noise_estimate", f"""WITH {CLI}, f AS (SELECT CAST(v AS DOUBLE) AS v FROM li WHERE NOT isnan(v)), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 100 AS w FROM f),
h AS (SELECT CAST(least(greatest(floor((v - lo) / w), 0), 99) AS INTEGER) AS bin, count(*) AS c FROM f, b GROUP BY 1), p AS (SELECT arg_min(bin, (-c, bin)) AS k FROM h WHERE bin BETWEEN 1 AND 98),
n AS (SELECT k, ln(coalesce((SELECT c FROM h WHERE bin = k - 1), 0) + 0.5) AS l, ln(coalesce((SELECT c FROM h WHERE bin = k), 0) + 0.5) AS m, ln(coalesce((SELECT c FROM h WHERE bin = k + 1), 0) + 0.5) AS r FROM p)
SELECT round(lo + w * (k + 0.5 + (l - r) / (2 * (l - 2 * m + r))), 6) AS peak, round(w / sqrt(-(l - 2 * m + r)), 6) AS noise FROM n, b""")
def noise_estimate(spark, d) -> DataFrame:
    return rounded(stats.noise(cube_of_lineitem(spark, d)), "peak", "noise")


@query("masked_to_nan", f"WITH {CLI} SELECT z, y, x, CASE WHEN x > y AND NOT isnan(v) THEN CAST(v AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END AS v FROM li")
def masked_to_nan(spark, d) -> DataFrame:
    return cube_of_lineitem(spark, d).select("z", "y", "x", exprs.keep_where(F.col("v").cast("double"), F.col("x") > F.col("y")).alias("v"))


@query("polarization_profiles", f"""WITH {CEV}, s AS (SELECT z, stokes, avg(CAST(v AS DOUBLE)) AS mean FROM ev WHERE NOT isnan(v) AND x BETWEEN 2 AND 9 AND y BETWEEN 4 AND 12 GROUP BY z, stokes),
w AS (SELECT z, max(mean) FILTER (stokes = 1) AS q, max(mean) FILTER (stokes = 2) AS u FROM s GROUP BY z) SELECT z, round(sqrt(q * q + u * u), 6) AS plinear FROM w""")
def polarization_profiles(spark, d) -> DataFrame:
    """The linearly polarized part of region profiles: computed from the profiles of Q and U."""
    got = regions.region_stats(cube_of_events(spark, d), Region("rectangle", ((5.5, 8.0), (8.0, 9.0))), "stokes", "z")
    pixels = got.select("stokes", "z", F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("mean").alias("v"))
    return rounded(polarization.computed(polarization.side_by_side(pixels)).select("z", "plinear"), "plinear")


@query("fit_in_region", f"""WITH {CLI}, f AS (SELECT z, CAST(v AS DOUBLE) AS v, exp(-4 * ln(2) * (power((y - 14.0) / 11.0, 2) + power((x - 16.0) / 8.0, 2))) AS g FROM li WHERE NOT isnan(v) AND x BETWEEN 5 AND 27 AND y BETWEEN 4 AND 25)
SELECT z, 0 AS component, round(regr_slope(v, g), 4) AS amp, round(regr_intercept(v, g), 4) AS background, true AS converged FROM f GROUP BY z""")
def fit_in_region(spark, d) -> DataFrame:
    """A source of known place and shape fitted to the pixels of a region of every channel."""
    region = Region("rectangle", ((16.0, 14.5), (22.0, 21.0)))
    start = [(16.0, 14.0, 40.0, 11.0, 8.0, 0.0)]
    got = fit.fit_gaussians(regions.masked(cube_of_lineitem(spark, d), region), start, {"cx", "cy", "fwhm_x", "fwhm_y", "pa"}, fit_background=True)
    return rounded(got.select("z", "component", "amp", "background", "converged"), "amp", "background", digits=4)
