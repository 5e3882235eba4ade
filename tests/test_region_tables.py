"""Regions as rows of a table, and angles as columns, against the functions of single ones."""

import math

import pytest
from pyspark.sql import functions as F

from lumencube.operators import regions
from lumencube.operators.regions import Region
from lumencube.sources import files

SHAPES = [
    Region("rectangle", ((5.0, 5.0), (4.0, 3.0)), 30.0), Region("rectangle", ((5.0, 5.0), (0.0, 3.0))), Region("ellipse", ((6.0, 7.0), (4.0, 3.0)), 20.0), Region("ellipse", ((6.0, 7.0), (3.0, 4.0)), 300.0), Region("ellipse", ((6.0, 7.0),)),
    Region("polygon", ((1.0, 1.0), (1.0, 4.0), (4.0, 4.0))), Region("polygon", ((1.0, 1.0), (1.0, 4.0))), Region("point", ((3.0, 2.0),)), Region("point", ((math.inf, 1.0),)), Region("line", ((9.0, 5.0), (1.0, 5.0))), Region("polyline", ((9.0, 5.0), (1.0, math.nan))), Region("ann_line", ((1.0, 1.0), (2.0, 2.0))), Region("star", ((1.0, 1.0),)), Region("point", ()),
]


def test_region_tables(spark):
    rows = [(n, r.kind, [tuple(p) for p in r.points], r.rotation) for n, r in enumerate(SHAPES)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "n int, kind string, points array<struct<x double, y double>>, rotation double")
    c = [F.col(n) for n in ("kind", "points", "rotation")]
    got = {r["n"]: r for r in df.select("n", regions.accepted(*c[:2]).alias("ok"), regions.corner_points(*c).alias("corners"), regions.records(*c).alias("record")).collect()}
    assert got[99]["ok"] is False and got[99]["record"] is None
    for n, shape in enumerate(SHAPES):
        try:
            shape.check()
        except ValueError:
            assert got[n]["ok"] is False and got[n]["record"] is None, shape
            continue
        assert got[n]["ok"] is True, shape
        name, points = regions.record(shape)
        assert got[n]["record"]["shape"] == name
        assert [tuple(p) for p in got[n]["record"]["points"]] == [pytest.approx(p) for p in points]
        if shape.kind in ("rectangle", "polygon"):
            assert [tuple(p) for p in got[n]["corners"]] == [pytest.approx(p) for p in shape.corners()]
        else:
            assert got[n]["corners"] is None


def test_angles(spark):
    values = [10.5, -0.25, 359.999999, 0.0, 59.99999999, -179.5, 12.3456789]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "v double")
    got = [tuple(r) for r in df.select(files.sexagesimal_column(F.col("v")), files.sexagesimal_column(F.col("v"), True)).collect()]
    assert got == [(files.sexagesimal(v), files.sexagesimal(v, True)) for v in values] + [(None, None)] * 2
