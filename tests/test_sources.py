import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencube.operators.regions import Region
from lumencube.sources import files, fits, region_text, votable
from lumencube.streaming import reactive

TABLE = """<?xml version="1.0"?>
<VOTABLE version="1.4" xmlns="http://www.ivoa.net/xml/VOTable/v1.3">
 <COOSYS ID="frame" system="ICRS"/>
 <RESOURCE><TABLE name="harbours" nrows="3"><DESCRIPTION>Tide gauges</DESCRIPTION><PARAM name="datum" datatype="float" value="0.25"/>
 <FIELD name="depth" ID="f0" datatype="float" unit="m"/><FIELD name="port" ID="f1" datatype="char" arraysize="12*"/>
 <FIELD name="drift" ID="f2" datatype="int"/><FIELD name="open" ID="f3" datatype="boolean"/><FIELD name="pair" ID="f4" datatype="float" arraysize="2"/>
 <DATA><TABLEDATA><TR><TD>04.50</TD><TD>Emden 7</TD><TD>-18</TD><TD>true</TD><TD>3 4</TD></TR>
 <TR><TD>61.25</TD><TD>Brest</TD><TD></TD><TD>False</TD><TD/></TR><TR><TD/><TD>Cork 12</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""


def test_votable(spark, tmp_path):
    path = tmp_path / "t.xml"
    path.write_text(TABLE)
    h = votable.read_header(str(path))
    assert (h.name, h.rows, h.description, h.params, h.coosys[0]["system"]) == ("harbours", 3, "Tide gauges", {"datum": "0.25"}, "ICRS")
    assert h.find("f1").name == "port" and h.find("depth").unit == "m" and h.find("x") is None
    spark.dataSource.register(votable.VoTable)
    df = spark.read.format("votable").load(str(path))
    assert dict(df.dtypes) == {"row_id": "bigint", "depth": "float", "port": "string", "drift": "int", "open": "boolean"}
    rows = df.orderBy("row_id").collect()
    assert [r["drift"] for r in rows] == [-18, 0, 0] and [r["open"] for r in rows] == [True, False, False]
    assert [r["port"] for r in rows] == ["Emden 7", "Brest", "Cork 12"]
    assert math.isnan(rows[2]["depth"]) and df.where("depth = 61.25").count() == 1


def test_votable_errors(spark, tmp_path):
    for name, text in (("a", "<?xml version='1.0'?><VOTABLE/>"), ("b", "<?xml version='1.0'?><VOTABLE><RESOURCE/></VOTABLE>")):
        path = tmp_path / name
        path.write_text(text)
        with pytest.raises(ValueError):
            votable.read_header(str(path))
    path = tmp_path / "c"
    path.write_text("<?xml version='1.0'?><VOTABLE><RESOURCE><TABLE><FIELD name='a' datatype='int'/></TABLE></RESOURCE></VOTABLE>")
    assert not votable.read_header(str(path)).has_data
    spark.dataSource.register(votable.VoTable)
    with pytest.raises(Exception, match="no data"):
        spark.read.format("votable").load(str(path)).collect()


def write_fits(path, data, kind, cards=()):
    head = [("SIMPLE", True), ("BITPIX", {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}[kind]), ("NAXIS", data.ndim), *[(f"NAXIS{i + 1}", n) for i, n in enumerate(data.shape[::-1])], *cards]
    text = b"".join(fits._card(k, v) for k, v in head) + b"END".ljust(80)
    body = data.astype(">" + kind).tobytes()
    raw = text.ljust(-(-len(text) // 2880) * 2880) + body + b"\0" * (-len(body) % 2880)
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as f:
        f.write(raw)


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "i8", "f4", "f8"])
def test_fits_types(spark, tmp_path, kind):
    data = np.arange(24).reshape(2, 3, 4)
    path = tmp_path / "a.fits"
    write_fits(path, data, kind, [("BSCALE", 2.0), ("BZERO", 1.0)] + ([("BLANK", 5)] if kind in ("u1", "i2", "i4", "i8") else []))
    spark.dataSource.register(fits.FitsImage)
    rows = spark.read.format("fits_image").load(str(path)).collect()
    assert len(rows) == 24
    for r in rows:
        raw = data[r["z"], r["y"], r["x"]]
        assert r["v"] == 2 * raw + 1 or (raw == 5 and math.isnan(r["v"]))


def test_fits_gzip_axes_and_round_trip(spark, tmp_path):
    spark.dataSource.register(fits.FitsImage)
    data = np.random.default_rng(0).standard_normal((3, 2, 4, 5)).astype(np.float32)
    path = tmp_path / "b.fits.gz"
    write_fits(path, data, "f4", [("CTYPE3", "STOKES"), ("CTYPE4", "FREQ")])
    cube = spark.read.format("fits_image").load(str(path))
    for r in cube.collect():
        assert r["v"] == data[r["z"], r["stokes"], r["y"], r["x"]]
    out = tmp_path / "c.fits"
    assert fits.save_image(cube, str(out), {"BUNIT": "Jy"}, channels=(0, 2, 2)) == (5, 4, 2, 2)
    again = spark.read.format("fits_image").load(str(out))
    assert {(r["stokes"], r["z"], r["y"], r["x"]): r["v"] for r in again.collect()} == {(s, z, y, x): data[z * 2, s, y, x] for s in range(2) for z in range(2) for y in range(4) for x in range(5)}
    assert fits.hdus(str(out))[0].header["BUNIT"] == "Jy" and fits.hdu_list(str(out)) == [(0, "", [5, 4, 2, 2])]
    with pytest.raises(FileExistsError):
        fits.save_image(cube, str(out))


def test_fits_table(spark, tmp_path):
    kind = np.dtype([("a", ">f4"), ("b", ">i2"), ("c", "S6"), ("d", "S1"), ("e", ">f8", 2), ("f", ">i2")])
    rows = np.zeros(3, kind)
    rows["a"], rows["b"], rows["c"], rows["d"], rows["f"] = [1.5, 2.5, -1], [1, -2, 3], [b"N 224", b"x ", b""], [b"T", b"F", b"T"], [-32768, 0, 32767]
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", kind.itemsize), ("NAXIS2", 3), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 6)]
    head += [(f"TTYPE{i + 1}", n) for i, n in enumerate("abcdef")] + [(f"TFORM{i + 1}", f) for i, f in enumerate(("E", "1I", "6A", "L", "2D", "I"))] + [("TZERO6", 32768)]
    text = b"".join(fits._card(k, v) for k, v in head) + b"END".ljust(80)
    first = (fits._card("SIMPLE", True) + fits._card("BITPIX", 8) + fits._card("NAXIS", 0) + b"END".ljust(80)).ljust(2880)
    path = tmp_path / "t.fits"
    path.write_bytes(first + text.ljust(-(-len(text) // 2880) * 2880) + rows.tobytes().ljust(2880, b"\0"))
    spark.dataSource.register(fits.FitsTable)
    df = spark.read.format("fits_table").load(str(path))
    assert dict(df.dtypes) == {"row_id": "bigint", "a": "float", "b": "smallint", "c": "string", "d": "boolean", "f": "int"}
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, 1.5, 1, "N 224", True, 0), (1, 2.5, -2, "x", False, 32768), (2, -1.0, 3, "", True, 65535)]


def test_region_round_trips():
    regions = [Region("rectangle", ((5, 5), (4, 3)), 30), Region("rectangle", ((5, 5), (4, 3))), Region("ellipse", ((5, 5), (4, 3)), 20), Region("ellipse", ((5, 6), (3, 3))), Region("polygon", ((1, 1), (1, 4), (4, 4))), Region("point", ((3, 3),)), Region("line", ((9, 5), (1, 5))), Region("polyline", ((1, 1), (9, 1), (9, 5)))]
    for write, read in ((region_text.to_ds9, region_text.from_ds9), (region_text.to_crtf, region_text.from_crtf)):
        got, said = read(write(regions))
        assert not said and len(got) == len(regions)
        assert all(region_text.same(a, b) for a, b in zip(regions, got, strict=True))
    assert region_text.from_ds9("image\n# nothing\n-circle(1,1,2)\n") == ([], ["zero regions set"])
    assert region_text.from_ds9("image\nannulus(1,1,2,3)\n")[1] == ["annulus is not supported"]
    assert region_text.from_crtf("#CRTFv0\nbox[[1pix, 2pix], [5pix, 8pix]]\n")[0] == [Region("rectangle", ((3.0, 5.0), (4.0, 6.0)))]


def test_files(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(b"SIMPLE  = T")
    (tmp_path / "b.xml").write_bytes(b"<?xml version")
    (tmp_path / "c.dat").write_bytes(b"zzz")
    got = {r["name"]: (r["type"], r["size"]) for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.fits": ("fits", 11), "b.xml": ("votable", 13), "c.dat": ("unknown", 3)}
    assert files.guess(str(tmp_path / "a.fits")) == "fits" and files.guess("x.reg", "region", False) == "ds9"
    assert files.normal_unit(" jy beam^-1 ") == "Jy/beam" and files.normal_unit("furlong") == "furlong"
    assert files.increment_unit(0.002) == (pytest.approx(7.2), "arcsec") and files.sexagesimal(-1.5) == "-01:30:00.000" and files.sexagesimal(15.0, True) == "01:00:00.0000"
    assert "fov=0.5" in files.cutout_address("http://x", "s", 10, 10, 0.5, 1, 2)
    with pytest.raises(ValueError):
        files.cutout_address("http://x", "s", 10, 10, 0.5, 400, 2)


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    (source / "0.json").write_text('{"file_id":"a","seq":1,"kind":"channel","value":"3"}\n{"file_id":"a","seq":2,"kind":"channel","value":"4"}\n{"file_id":"b","seq":1,"kind":"pv_cut","value":"x"}\n{"file_id":"b","seq":2,"kind":"pv_cut","value":"y"}\n')
    requests = lambda: spark.readStream.schema(reactive.REQUEST).json(str(source))
    keep = lambda rows, n: out.append([tuple(r) for r in rows.collect()])
    reactive.answer(requests(), lambda df: df.where("kind = 'channel'"), keep, str(tmp_path / "c1")).awaitTermination(60)
    assert out.pop() == [("a", "channel", 2, "4")]
    (source / "1.json").write_text('{"file_id":"a","seq":3,"kind":"channel","value":"9"}\n')
    reactive.answer(requests(), lambda df: df.where("kind = 'channel'"), keep, str(tmp_path / "c1")).awaitTermination(60)
    assert out.pop() == [("a", "channel", 3, "9")]
    reactive.in_order(requests(), lambda df: df.select("seq", "value"), keep, str(tmp_path / "c2")).awaitTermination(60)
    assert out[-1] == [(1, "x"), (2, "y")]


def test_animation_and_matching(spark):
    t = spark.range(8).select("id", reactive.frame_of(F.col("id"), 2, 8, 4, 2).alias("loop"), reactive.frame_of(F.col("id"), 0, 3, 0, 1, reverse=True).alias("swing"), reactive.frame_of(F.col("id"), 0, 3, 1, 1, loop=False).alias("stop"))
    rows = t.orderBy("id").collect()
    assert [r["loop"] for r in rows] == [4, 6, 8, 2, 4, 6, 8, 2]
    assert [r["swing"] for r in rows] == [0, 1, 2, 3, 2, 1, 0, 1]
    assert [r["stop"] for r in rows] == [1, 2, 3, 3, 3, 3, 3, 3]
    m = reactive.matched_frames(spark.createDataFrame([(0.0,), (10.6,), (99.0,)], "coordinate double"), 10.0, 0.5, 5)
    assert [r["matched"] for r in m.collect()] == [0, 1, 4]
    cube = spark.range(30).select(F.col("id").cast("int").alias("z"))
    assert [(share, df.count()) for share, df in reactive.progressive(cube, 30, lambda c: c)] == [(1 / 3, 10), (1.0, 20)]
    log = spark.createDataFrame([("f", 1, "channel", "1"), ("f", 2, "channel", "2"), ("f", 0, "open", "f"), ("t", 3, "catalog", "t")], reactive.REQUEST)
    assert [r["value"] for r in reactive.replay(log).collect()] == ["f", "2", "t"]


def test_file_info(spark, tmp_path):
    path = tmp_path / "i.fits"
    write_fits(path, np.zeros((3, 4, 5)), "i2", [("BSCALE", 0.5), ("BUNIT", "Jy"), ("BMAJ", 0.002), ("BMIN", 0.001), ("CDELT1", -0.0005), ("CDELT2", 0.0005)])
    info = {(r["section"], r["key"]): r["value"] for r in fits.file_info(spark, str(path)).collect()}
    assert info["computed", "Data type"] == "float" and info["computed", "Shape"] == "[5, 4, 3]" and info["computed", "Number of channels"] == "3"
    assert info["header", "BUNIT"] == "Jy"
    header = fits.hdus(str(path))[0].header
    assert fits.beam_area(header) == pytest.approx(math.pi / (4 * math.log(2)) * 8) and fits.beam_area({}) is None
