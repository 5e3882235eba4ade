"""Stored cubes: the answers, and which files give them."""

import glob
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import lumencube.plans.stores as plans
from lumencube.operators import regions, resample, stats
from lumencube.operators.regions import Region
from lumencube.operators.store import Store, row_spans, write_store
from lumencube.plans.registry import ORACLES, QUERIES
from tests.test_files import duck, plain  # noqa: F401
from tests.test_operators import cube

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == plans.__name__)
SHAPE = (12, 9, 6, 2)


@pytest.fixture(scope="module")
def data():
    v = np.random.default_rng(5).normal(3, 2, SHAPE[::-1]).astype(np.float32)
    v[0, 2] = np.nan
    v[1, 3, 4:, :5] = np.nan
    v[1, 4] = 7.5
    v[1, 1, 0, 0] = np.inf
    return v


@pytest.fixture(scope="module")
def store(spark, data, tmp_path_factory):
    return write_store(cube(spark, data), str(tmp_path_factory.mktemp("store") / "s"), *SHAPE, mips=(2, 3, 4), ranks=(0.5,), row_group=4096)


def read_from(df, store):
    """Names of the store's tables that a plan reads."""
    return {f.split(store.path, 1)[1].lstrip("/").rsplit("/", 1)[0] for f in df.inputFiles() if store.path in f}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):  # noqa: F811
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_statistics_read_no_pixels(spark, data, store):
    got = store.plane_stats()
    assert read_from(got, store) == {"stats"} and read_from(store.cube_stats("z"), store) == {"stats"}
    rows = {(r["stokes"], r["z"]): r for r in got.collect()}
    assert len(rows) == 12
    for (s, z), r in rows.items():
        v = data[s, z].astype(np.float64)
        f = v[np.isfinite(v)]
        assert (r["num_pixels"], r["nan_count"], r["total"]) == (len(f), np.isnan(v).sum(), v.size)
        assert r["mean"] == pytest.approx(f.mean(), rel=1e-9) if len(f) else math.isnan(r["mean"]) and math.isnan(r["min"])
    whole = store.cube_stats().first()
    f = data[np.isfinite(data)].astype(np.float64)
    assert whole["num_pixels"] == len(f) and whole["sigma"] == pytest.approx(f.std(ddof=1))
    assert store.plane_stats(1, 3).count() == 1


def test_histograms_of_planes(spark, data, store):
    rows = store.plane_histogram().collect()
    by = {}
    for r in rows:
        by.setdefault((r["stokes"], r["z"]), []).append(r["count"])
    assert by[0, 2] == [0] and by[1, 4] == [0]  # no pixels; one value, which is not zero
    for (s, z), counts in by.items():
        f = data[s, z][np.isfinite(data[s, z])]
        if (s, z) not in ((0, 2), (1, 4)):
            assert len(counts) == store.bins and sum(counts) == len(f)
    medians = {(r["stokes"], r["z"]): r["value"] for r in store.plane_percentiles().collect()}
    assert (0, 2) not in medians and medians[1, 3] == pytest.approx(np.median(data[1, 3][np.isfinite(data[1, 3])]))


@pytest.mark.parametrize(("mip", "table"), [(2, "mips/2"), (3, "mips/3"), (8, "mips/4"), (6, "mips/3"), (5, "planes")])
def test_mips_come_from_the_largest_stored_divisor(spark, data, store, mip, table):
    got = store.block_mean(mip)
    assert read_from(got, store) == {table}
    want = {(r["stokes"], r["z"], r["y"], r["x"]): r["v"] for r in resample.block_mean(cube(spark, data), mip, "stokes", "z").collect()}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["stokes"], r["z"], r["y"], r["x"]]
        assert math.isnan(r["v"]) if math.isnan(w) else r["v"] == pytest.approx(w)


def test_profiles(spark, data, store):
    assert read_from(store.profile("x", 5, 4, 1, 3), store) == {"mips/4"}
    means = {r["i"]: r["v"] for r in store.profile("x", 5, 4, 1, 0).collect()}
    assert means == {i: pytest.approx(data[1, 0, 4:8, 4 * i : 4 * i + 4].astype(np.float64).mean()) for i in range(3)}
    line = store.profile("x", 5, 1, 1, 0)
    assert read_from(line, store) == {"planes"}
    assert [v for _, v in sorted((r["i"], r["v"]) for r in line.collect())] == data[1, 0, 5].tolist()
    column = {r["i"]: r["v"] for r in store.profile("y", 3, 1, 0, 1).collect()}
    assert column == dict(enumerate(data[0, 1, :, 3].tolist()))
    five = sorted((r["i"], r["v"]) for r in store.profile("y", 3, 5, 0, 1).collect())  # no stored divisor: least and largest
    assert [i for i, _ in five] == [0, 1] and sorted(v for _, v in five) == sorted([data[0, 1, :, 3].min(), data[0, 1, :, 3].max()])
    with pytest.raises(ValueError, match="x or y"):
        store.profile("z", 1)


def test_the_copy_follows_the_shape(spark, data, store):
    assert store.copy_for((0, 0, 11, 8), 1) == "planes" and store.copy_for((3, 3, 3, 3), 6) == "spectra"
    assert store.copy_for((0, 0, 11, 8), 6) == "planes" and store.copy_for((2, 2, 4, 4), 1) == "planes"
    one = store.pixels((3, 4, 3, 4), stokes=1)
    assert read_from(one, store) == {"spectra"}
    assert {r["z"]: r["v"] for r in one.collect() if r["z"] != 3} == {z: float(data[1, z, 4, 3]) for z in (0, 1, 2, 4, 5)}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = store.pixels((3, 4, 3, 4), stokes=1)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(y,4)" in plan and "EqualTo(stokes,1)" in plan
    assert store.pixels().count() == data.size


def test_row_groups_outside_a_request_are_skipped(spark, tmp_path):
    """A copy in the order of pixels: a spectrum meets few of the row groups; in the order of planes it meets most."""
    big = spark.range(64 * 64 * 32).select(F.lit(0).alias("stokes"), F.floor(F.col("id") / 4096).cast("int").alias("z"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.rand(3).cast("float").alias("v"))
    made = write_store(big, str(tmp_path / "s"), 64, 64, 32, mips=(2,), ranks=(0.5,), row_group=16_384)

    def met(table, **box):
        hit = total = 0
        for f in glob.glob(f"{made.path}/{table}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            names = meta.schema.names
            for g in range(meta.num_row_groups):
                s = {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}
                hit += all(s[c].min <= hi and lo <= s[c].max for c, (lo, hi) in box.items())
                total += 1
        return hit / total

    spectrum = {"y": (40, 40), "x": (7, 7)}
    assert met("spectra", **spectrum) * 4 < met("planes", **spectrum)
    assert met("planes", z=(5, 5)) < 0.3
    assert made.pixels((7, 40, 7, 40)).count() == 32


def test_row_spans(spark):
    rng = np.random.default_rng(2)
    shapes = [Region("polygon", tuple(map(tuple, rng.uniform(-3, 33, (k, 2)).tolist()))) for k in (3, 5, 9)]
    shapes += [Region("polygon", ((2, 2), (20, 2), (20, 20), (14, 20), (14, 6), (8, 6), (8, 20), (2, 20))), Region("ellipse", ((10, 12), (4, 9)), 30), Region("rectangle", ((50, 50), (4, 4)))]
    grid = cube(spark, np.zeros((30, 30)))
    for shape in shapes:
        got = [(x, r["y"]) for r in row_spans(spark, shape, 30, 30).collect() for x in range(r["x0"], r["x1"] + 1)]
        want = {(r["x"], r["y"]) for r in regions.masked(grid, shape).collect()}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("limit", [0, 100_000])
def test_region_spectrum(spark, data, store, monkeypatch, limit):
    monkeypatch.setattr("lumencube.operators.store.BROADCAST_SPANS", limit)
    shape = Region("polygon", ((1, 1), (6, 2), (3, 7)))
    got = store.region_spectrum(shape)
    assert "spectra" in read_from(got, store)
    rows = {r["z"]: r for r in got.collect()}
    want = {r["z"]: r for r in regions.spectral_profile(cube(spark, data).where("stokes = 0"), shape, 6).collect()}
    assert set(rows) == set(want) == set(range(6)) and rows[2]["num_pixels"] == 0 and math.isnan(rows[2]["mean"])
    for z, r in rows.items():
        for c in stats.BASIC:
            assert r[c] == pytest.approx(want[z][c], nan_ok=True), (z, c)
    assert [r["z"] for r in store.region_spectrum(shape, 1, (4, 5)).orderBy("z").collect()] == [4, 5]
    outside = store.region_spectrum(Region("rectangle", ((100, 100), (4, 4)))).collect()
    assert {r["num_pixels"] for r in outside} == {0} and len(outside) == 6


def test_an_incomplete_store_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no complete store"):
        Store(spark, str(tmp_path / "none"))
