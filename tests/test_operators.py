import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencube.functions.exprs import compare, divide, finite
from lumencube.operators import catalog, histogram, moments, polarization, profiles, regions, resample, stats
from lumencube.operators.catalog import Filter
from lumencube.operators.contour import contours, trace
from lumencube.operators.fit import convolve_planes, errors, fit_gaussians, fit_images, model, slopes
from lumencube.operators.regions import Region

NAN = float("nan")


def cube(spark, data):
    """Canonical cube of a (stokes, z, y, x) array."""
    data = np.asarray(data, np.float32)
    data = data.reshape((1,) * (4 - data.ndim) + data.shape)
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(data)]
    return spark.createDataFrame(rows, "stokes int, z int, y int, x int, v float")


def as_array(df, *axes):
    rows = df.collect()
    shape = [max(r[a] for r in rows) + 1 for a in axes]
    out = np.full(shape, np.nan)
    for r in rows:
        out[tuple(r[a] for a in axes)] = r["v"]
    return out


@pytest.fixture(scope="module")
def noise():
    data = np.random.default_rng(0).standard_normal((10, 10, 10)).astype(np.float32)
    data[:, 2, 3] = np.nan
    data[4, 7, 7] = np.inf
    return data


def test_basic_stats_and_merge(spark, noise):
    c = cube(spark, noise)
    ok = noise[np.isfinite(noise)].astype(np.float64)
    whole = stats.basic_stats(c).first()
    merged = stats.merge_stats(stats.partial_stats(c, "z")).first()
    for r in (whole, merged):
        assert r["num_pixels"] == ok.size
        assert r["mean"] == pytest.approx(ok.mean())
        assert r["sigma"] == pytest.approx(ok.std(ddof=1))
        assert r["rms"] == pytest.approx(math.sqrt((ok**2).mean()))
        assert (r["min"], r["max"]) == (ok.min(), ok.max())


def test_stats_of_nothing_and_of_one(spark):
    none = stats.basic_stats(cube(spark, [[NAN, NAN]])).first()
    assert none["num_pixels"] == 0 and all(math.isnan(none[k]) for k in ("sum", "mean", "sigma", "min", "rms"))
    one = stats.basic_stats(cube(spark, [[2.0, NAN]])).first()
    assert (one["num_pixels"], one["mean"]) == (1, 2.0) and math.isnan(one["sigma"])


def test_histogram_golden(spark):
    values = [0.0, 0.5, 1.0, 4.0, 4.2, 4.4, 4.9, 5.0, 5.1, 5.9, 9.5, 10.0, NAN, -1.0, 11.0, float("inf")]
    got = {r["bin"]: r["count"] for r in histogram.histogram(cube(spark, [values]), 10, (0.0, 10.0)).collect()}
    assert sum(got.values()) == 12
    assert [got[i] for i in (0, 1, 4, 5, 9)] == [2, 1, 4, 3, 2]


def test_histogram_of_no_range(spark):
    rows = histogram.histogram(cube(spark, [[0.0, 0.0, NAN]]), 5, (0.0, 0.0)).collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(0, 2)]


def test_merge_refuses_other_bins(spark):
    c = cube(spark, [[0.0, 1.0]])
    parts = histogram.histogram(c, 4, (0.0, 1.0)).unionByName(histogram.histogram(c, 4, (0.0, 2.0)))
    with pytest.raises(ValueError):
        histogram.merge_histograms(parts)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(0, 10.68, "N 224", -297, 5, True), (1, 287.43, "N 6744", 839, 6, False), (2, 23.48, "N 598", -182, 3, True)]
    return spark.createDataFrame(rows, "row_id long, ra float, name string, rv int, e_rv short, flag boolean")


@pytest.mark.parametrize(
    "f,n",
    [
        (Filter("ra", "eq", 287.43), 1),
        (Filter("e_rv", "eq", 3), 1),
        (Filter("e_rv", "ne", 3), 2),
        (Filter("ra", "ge", 11), 2),
        (Filter("ra", "le", 11), 1),
        (Filter("ra", "range_closed", 11, 300), 2),
        (Filter("ra", "range_closed", 11, 14), 0),
        (Filter("ra", "range_open", 10.68, 287.43), 1),
        (Filter("flag", "eq", 1), 2),
        (Filter("flag", "eq", 0), 1),
        (Filter("rv", "le", -181.5), 2),
        (Filter("e_rv", "lt", 1e9), 3),
        (Filter("name", "contains", "N 224"), 1),
        (Filter("name", "contains", "n 224"), 0),
        (Filter("name", "contains", "n 224", ignore_case=True), 1),
        (Filter("name", "contains", ""), 3),
        (Filter("ra", "contains", "1"), 3),
        (Filter("name", "eq", 1), 3),
        (Filter("none", "eq", 1), 3),
    ],
)
def test_filters(sample, f, n):
    assert catalog.select_rows(sample, [f]).count() == n
    assert catalog.inverted(sample, [f]).count() == 3 - n


def test_nan_rules(spark):
    df = spark.createDataFrame([(0, NAN), (1, 1.0), (2, 2.0)], "row_id long, c double")
    count = lambda op, a, b=None: df.where(compare(F.col("c"), op, df.schema["c"].dataType, a, b)).count()
    assert [count(op, NAN) for op in ("eq", "ne")] == [0, 2 + 0] or count("eq", NAN) == 0
    assert [count(op, 1.0) for op in ("eq", "ne", "lt", "gt", "le", "ge")] == [1, 2, 0, 1, 1, 2]
    for down, expected in ((False, [1, 2, 0]), (True, [2, 1, 0])):
        assert [r["row_id"] for r in catalog.ordered(df, "c", down).collect()] == expected


def test_paging_and_projection(sample):
    by_ra = catalog.ordered(sample, "ra")
    assert [r["row_id"] for r in catalog.page(by_ra, -1, -1).collect()] == [0, 2, 1]
    assert [r["row_id"] for r in catalog.page(by_ra, 1, 2).collect()] == [2]
    assert catalog.page(by_ra, 5, 9).count() == 0
    assert catalog.project(sample, [2, 9]).columns == ["name"]
    assert [(len(p), done) for p, done in catalog.pages(by_ra, 2)] == [(2, 2 / 3), (1, 1.0)]
    with pytest.raises(ValueError):
        catalog.ordered(sample.withColumn("a", F.array(F.lit(1))), "a")


def test_division(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 0.0), (3.0, 2.0)], "n double, d double").select(divide(F.col("n"), F.col("d")).alias("q")).collect()
    assert [str(r["q"]) for r in rows] == ["inf", "-inf", "nan", "nan", "1.5"]


@pytest.mark.parametrize(
    "region,box",
    [
        (Region("rectangle", ((5, 5), (4, 3))), (5, 3)),
        (Region("rectangle", ((5, 5), (4, 3)), 30), (5, 5)),
        (Region("ellipse", ((5, 5), (4, 3))), (7, 9)),
        (Region("polygon", ((5, 5), (4, 3), (1, 6), (3, 8))), (5, 6)),
    ],
)
def test_region_boxes(spark, region, box):
    got = regions.masked(cube(spark, np.zeros((10, 10))), region).agg(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).first()
    assert tuple(got) == box


def test_polygon_edges_count(spark, noise):
    square = Region("polygon", ((1, 1), (1, 4), (4, 4), (4, 1)))
    c = cube(spark, noise)
    assert regions.masked(c.where("z = 0"), square).count() == 16
    part = noise[0, 1:5, 1:5]
    assert regions.region_stats(c.where("z = 0"), square).first()["mean"] == pytest.approx(part[np.isfinite(part)].mean(), rel=1e-6)
    assert regions.region_histogram(c.where("z = 0"), square).count() == 4
    profile = [r["mean"] for r in regions.spectral_profile(c, square, 12).orderBy("z").collect()]
    assert profile[3] == pytest.approx(np.nanmean(noise[3, 1:5, 1:5]), rel=1e-6) and math.isnan(profile[11])


def test_region_checks():
    for bad in (Region("ann_line", ((0, 0), (1, 1))), Region("rectangle", ((0, 0), (0, 1))), Region("polygon", ((0, 0), (1, 1))), Region("point", ((NAN, 0),)), Region("line", ((0, 0), (1, 1)))):
        with pytest.raises(ValueError):
            bad.predicate()


def test_outside_region(spark):
    r = regions.region_stats(cube(spark, np.zeros((4, 4))), Region("rectangle", ((50, 50), (2, 2)))).first()
    assert r["num_pixels"] == 0 and math.isnan(r["mean"])


def test_line_profiles(spark, noise):
    image = cube(spark, noise[0])
    line = [r["v"] for r in profiles.line_profile(image, [(9, 5), (1, 5)]).orderBy("box").collect()]
    assert len(line) == 9 and np.allclose(line, noise[0, 5, 9:0:-1].astype(float), equal_nan=True)
    poly = [r["v"] for r in profiles.line_profile(image, [(1, 1), (9, 1), (9, 5)]).orderBy("box").collect()]
    assert len(poly) == 13 and np.allclose(poly, np.r_[noise[0, 1, 1:10], noise[0, 2:6, 9]].astype(float), equal_nan=True)
    wide = [r["v"] for r in profiles.line_profile(image, [(1, 5), (8, 5)], 3).orderBy("box").collect()]
    assert len(wide) in (7, 9)
    oblique = profiles.line_profile(image, [(1, 1), (7, 7)], 2)
    assert oblique.where(finite(F.col("v"))).count() >= 7


def test_pv_image_and_preview(spark, noise):
    pv = as_array(profiles.pv_image(cube(spark, noise), [(1, 5), (9, 5)]), "y", "x")
    assert np.allclose(pv, noise[:, 5, 1:10].astype(float), equal_nan=True)
    data = np.arange(5 * 4 * 4, dtype=float).reshape(5, 4, 4)
    data[0, 0, 0] = NAN
    small = as_array(profiles.preview_cube(cube(spark, data), 5, 2, 2), "z", "y", "x")
    assert small.shape == (3, 2, 2) and np.isnan(small[2]).all()
    blocks = data.reshape(5, 2, 2, 2, 2)
    means = np.nanmean(blocks, axis=(2, 4))
    assert np.allclose(small[:2], (means[[0, 2]] + means[[1, 3]]) / 2)


def test_point_and_decimate(spark):
    image = cube(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert [r["v"] for r in profiles.point_value(image, 0.5, 0.4).collect()] == [2.0]
    assert profiles.point_value(image, 5, 0).count() == 0
    row = spark.createDataFrame(list(enumerate([5.0, NAN, 1.0, 3.0, NAN, NAN, NAN, NAN, 2.0])), "x int, v float")
    got = [r["v"] for r in profiles.decimate(row, "x", 2).orderBy("i").collect()]
    assert np.allclose(got, [5, 1, NAN, NAN, 2, 2], equal_nan=True)


@pytest.mark.parametrize("mip", [2, 3, 4, 7])
def test_block_mean(spark, noise, mip):
    got = as_array(resample.block_mean(cube(spark, noise[4]), mip), "y", "x")
    data = np.where(np.isfinite(noise[4]), noise[4], np.nan).astype(float)
    for y, x in np.ndindex(got.shape):
        part = data[y * mip : y * mip + mip, x * mip : x * mip + mip]
        assert got[y, x] == pytest.approx(np.nanmean(part)) or (np.isnan(part).all() and np.isnan(got[y, x]))


def test_mips_from_mips(spark, noise):
    image = cube(spark, noise[1])
    a = as_array(resample.block_mean(image, 4), "y", "x")
    b = as_array(resample.from_mip(resample.mip_sums(image, 2), 2, 4), "y", "x")
    assert np.allclose(a, b) and resample.best_divisor([2, 4, 3], 8) == 4
    with pytest.raises(ValueError):
        resample.from_mip(resample.mip_sums(image, 3), 3, 4)


def test_tiles(spark, noise):
    t = spark.createDataFrame([(3, 5, 7), (12, 4095, 4095), (3, 8, 0), (-1, 0, 0), (0, 0, 0)], "l int, x int, y int")
    code = t.withColumn("c", resample.encode_tile(F.col("l"), F.col("x"), F.col("y")))
    rows = code.select("*", *[c.alias(f"d{i}") for i, c in enumerate(resample.decode_tile(F.col("c")))]).collect()
    for r in rows:
        ok = 0 <= r["l"] and max(r["x"], r["y"]) < 2 ** r["l"]
        assert (r["d0"], r["d1"], r["d2"]) == ((r["l"], r["x"], r["y"]) if ok else (-1, -1, -1))
    row = resample.tile_rows(cube(spark, noise[0]), 1, 8).where("tx = 0 and ty = 0").first()
    got = resample.unpack_tile(bytes(row["data"]), row["w"], row["h"])
    assert np.array_equal(got, noise[0, :8, :8], equal_nan=True)


def test_gaussian_smooth(spark, noise):
    f = 3
    got = as_array(resample.gaussian_smooth(cube(spark, noise[2]), f, 10, 10), "y", "x")
    k, r = np.array(resample.gaussian_kernel(f)), f - 1
    data = noise[2].astype(float)

    def one(a):
        out = np.full((a.shape[0], a.shape[1] - 2 * r), np.nan)
        for y, x in np.ndindex(out.shape):
            part = a[y, x : x + 2 * r + 1]
            ok = np.isfinite(part)
            out[y, x] = (k[ok] * part[ok]).sum() / k[ok].sum() if ok.any() else np.nan
        return out

    want = one(one(data).T).T
    want[~np.isfinite(data[r:-r, r:-r])] = np.nan
    assert got.shape == (6, 6) and np.allclose(got, want, equal_nan=True)


def test_encodings(spark):
    rows = spark.createDataFrame([(g, i, v) for g, vs in ((0, [1.0, NAN, NAN, 2.0]), (1, [NAN, 3.0]), (2, [NAN])) for i, v in enumerate(vs)], "g int, i int, v double")
    runs = {(r["g"], r["i"]): r["length"] for r in resample.nan_runs(rows, "i", "g").collect()}
    assert runs == {(0, 0): 1, (0, 1): 2, (0, 2): 1, (1, 0): 0, (1, 1): 1, (1, 2): 1, (2, 0): 0, (2, 1): 1}
    filled = {(r["g"], r["i"]): r["v"] for r in resample.fill_nan(rows, "i", "g").collect()}
    assert [filled[0, i] for i in range(4)] == [1, 1, 1, 2] and filled[1, 0] == 3 and math.isnan(filled[2, 0])


def test_runs_and_fills_over_blocks(spark):
    """Scans by blocks of 4 places equal a scan of the whole; gaps in the order, groups of one kind, null groups."""
    rng = np.random.default_rng(5)
    groups = {g: [float("nan") if rng.random() < p else float(k) for k in range(n)] for g, p, n in ((0, 0.5, 60), (1, 0.9, 45), (2, 0.0, 9), (3, 1.0, 9), (None, 0.3, 30), (5, 0.05, 100))}
    data = [(g, 3 * i + (i > 20) * 40, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    rows = spark.createDataFrame(data, "g int, i int, v double").repartition(3)
    runs = {(r["g"], r["i"]): r["length"] for r in resample.nan_runs(rows, "i", "g", block=4).collect()}
    filled = {(r["g"], r["i"]): r["v"] for r in resample.fill_nan(rows, "i", "g", block=4).collect()}
    want_runs, want = {}, {}
    for g, vs in groups.items():
        places = [i for h, i, _ in data if h == g]
        lengths, kind = [0], False
        for v in vs:
            if math.isnan(v) != kind:
                lengths.append(0)
                kind = not kind
            lengths[-1] += 1
        want_runs |= {(g, k): n for k, n in enumerate(lengths)}
        last = next((v for v in vs if not math.isnan(v)), math.nan)
        for i, v in zip(places, vs, strict=True):
            last = last if math.isnan(v) else v
            want[g, i] = last
    assert runs == want_runs
    assert filled.keys() == want.keys() and all(a == want[k] or math.isnan(a) and math.isnan(want[k]) for k, a in filled.items())


def test_percentiles_by_rank_selection(spark):
    """With buffers of 5 pixels the rounds of histograms give what sorting gives: ties, outliers, single values, tiny groups."""
    rng = np.random.default_rng(6)
    groups = {0: rng.standard_normal(300).tolist(), 1: [1.0] * 50 + [2.0] * 51, 2: [3.0], 3: [1e38, -1e38, 0.0, 1e-40, 5.0, 5.0, 7.0], None: rng.integers(0, 9, 200).astype(float).tolist(), 5: [math.nan, math.inf]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double").repartition(3)
    ranks = (0.0, 0.1, 0.5, 0.77, 1.0)
    for buffer in (5, 1000):
        got = {(r["g"], r["rank"]): r["value"] for r in stats.exact_percentiles(rows, ranks, "g", buffer=buffer).collect()}
        want = {(g, q): np.quantile(vs, q) for g, vs in groups.items() if g != 5 for q in ranks}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
        mads = {r["g"]: r["mad"] for r in stats.mad(rows, "g", buffer=buffer).collect()}
        assert mads == {g: pytest.approx(1.4826 * np.median(np.abs(np.array(vs) - np.median(vs)))) for g, vs in groups.items() if g != 5}
    whole = [v for vs in groups.values() for v in vs if math.isfinite(v)]
    assert stats.exact_percentiles(rows, (0.3,), buffer=5).first()["value"] == pytest.approx(np.quantile(whole, 0.3))


def lines_of(rows):
    """Vertices by line, in order."""
    found = {}
    for r in sorted(rows, key=lambda r: (r["level"], r["line"], r["i"])):
        found.setdefault((r["level"], r["line"]), []).append((r["x"], r["y"]))
    return found


def test_contours(spark):
    y, x = np.mgrid[0:20, 0:20]
    data = np.exp(-((x - 9.3) ** 2 + (y - 10.1) ** 2) / 20)
    fragments = trace(data, 0.5)
    assert len(fragments) == 1 and fragments[0][0] == fragments[0][1] == fragments[0][3]
    lines = lines_of(contours(cube(spark, data), [0.5, 0.9], scale=2.0, offset=1.0).collect())
    assert sorted(lv for lv, _ in lines) == [0.5, 0.9]
    for (level, _), line in lines.items():
        at = (np.array(line) - 1) / 2
        assert np.allclose(at[0], at[-1]) and np.allclose(np.hypot(at[:, 0] - 9.3, at[:, 1] - 10.1), math.sqrt(-20 * math.log(level)), atol=0.1)
        turn = np.cross(np.c_[np.diff(at, axis=0), np.zeros(len(at) - 1)], np.c_[np.array([9.3, 10.1]) - at[:-1], np.zeros(len(at) - 1)])[:, 2]
        assert (turn > 0).all()  # what lies above is on the left


def test_contours_do_not_depend_on_pieces(spark):
    """Lines over one piece equal those over many: rings and open lines that cross borders, saddles and NaN."""
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:45, 0:50]
    data = np.sin(x / 4) * np.cos(y / 5) + rng.standard_normal(x.shape) * 0.3
    data[10:13, 20:24] = np.nan
    image = cube(spark, data).cache()
    levels = [0.0, -0.4]
    whole = lines_of(contours(image, levels).collect())
    for piece in (7, 16):
        cut = lines_of(contours(image, levels, piece=piece).collect())
        assert cut.keys() == whole.keys() and all(np.allclose(cut[k], whole[k]) for k in whole)
    assert max(map(len, whole.values())) > 60
    for level in levels:
        above = np.nan_to_num(data, nan=-1e9) >= level
        met = sum(len(v) - (v[0] == v[-1]) for (lv, _), v in whole.items() if lv == level)
        assert met == (above[:, 1:] != above[:, :-1]).sum() + (above[1:] != above[:-1]).sum()
    for (level, _), line in whole.items():
        inside = [0 < c[0] < 49 and 0 < c[1] < 44 for c in (line[0], line[-1])]
        assert line[0] == line[-1] or not any(inside)
        for vx, vy in line:
            x0, y0 = math.floor(vx), math.floor(vy)
            fx, fy = vx - x0, vy - y0
            assert fx == 0 or fy == 0
            p, q = np.nan_to_num([data[y0, x0], data[y0, x0 + 1] if fx else data[y0 + 1, x0] if fy else level], nan=-1e9)
            assert (p - level) * (q - level) <= 0 or not (fx or fy)


def test_contours_of_flat_images(spark):
    assert contours(cube(spark, np.zeros((5, 5))), [1.0, 0.0]).count() == 0
    assert contours(cube(spark, np.zeros((1, 5))), [0.0]).count() == 0


def test_moments(spark, noise):
    data = np.abs(noise) + 0.5
    got = {(r["y"], r["x"]): r for r in moments.moments(cube(spark, data), 10.0, -2.0, include=(0.0, 9.0)).collect()}
    c = 10.0 - 2.0 * np.arange(10)
    for (y, x), r in got.items():
        ok = np.isfinite(data[:, y, x])
        i, w = data[ok, y, x].astype(float), c[ok]
        m1 = (i * w).sum() / i.sum()
        want = {
            "average": i.mean(),
            "integrated": i.sum() * 2,
            "weighted_coordinate": m1,
            "weighted_dispersion": math.sqrt((i * (w - m1) ** 2).sum() / i.sum()),
            "median": np.median(i),
            "standard_deviation": i.std(ddof=1),
            "rms": math.sqrt((i * i).mean()),
            "abs_mean_deviation": np.abs(i - i.mean()).mean(),
            "maximum": i.max(),
            "maximum_coordinate": w[i.argmax()],
            "minimum": i.min(),
            "minimum_coordinate": w[i.argmin()],
        }
        for k, v in want.items():
            assert r[k] == pytest.approx(v), k
    assert (2, 3) not in got
    assert moments.allowed(["median", "median_coordinate"], None) == ["median"]
    assert moments.allowed(["median_coordinate"], (-1.0, 1.0)) == []


def test_polarization(spark):
    planes = np.random.default_rng(1).standard_normal((4, 1, 3, 3)).astype(np.float32)
    planes[1, 0, 0, 0] = np.nan
    planes[0, 0, 1, 1] = 0
    i, q, u, v = planes.astype(float)[:, 0]
    for r in polarization.computed(polarization.side_by_side(cube(spark, planes))).collect():
        at = r["y"], r["x"]
        assert r["ptotal"] == pytest.approx(math.sqrt(q[at] ** 2 + u[at] ** 2 + v[at] ** 2), nan_ok=True)
        assert r["pangle"] == pytest.approx(math.degrees(math.atan2(u[at], q[at])) / 2, nan_ok=True)
        assert r["pflinear"] == pytest.approx(np.inf if at == (1, 1) else 100 * math.sqrt(q[at] ** 2 + u[at] ** 2) / i[at], nan_ok=True)
    c = cube(spark, planes)
    one = lambda s: c.where(F.col("stokes") == s)
    both = polarization.concatenated({"Q": one(1), "I": one(0)})
    assert both.groupBy("stokes").count().count() == 2
    with pytest.raises(ValueError):
        polarization.concatenated({"I": one(0)})
    with pytest.raises(ValueError):
        polarization.concatenated({"I": one(0), "Q": one(1).where("x < 2")})


def test_fit_recovers_a_gaussian(spark):
    y, x = np.mgrid[0:64, 0:64]
    true = np.array([30.0, 33.0, 20.0, 14.0, 8.0, 35.0, 0.5])
    data = model(true, x.astype(float), y.astype(float))
    data += np.random.default_rng(0).normal(0, 0.02, data.shape)
    data[3, 3] = np.nan
    r = fit_gaussians(cube(spark, data), [(28, 35, 15, 10, 10, 20)], background=0.0, fit_background=True).first()
    assert r["converged"]
    for name, value in zip(("cx", "cy", "amp", "fwhm_x", "fwhm_y", "pa"), true, strict=False):
        assert r[name] == pytest.approx(value, abs=0.1)
    assert r["background"] == pytest.approx(0.5, abs=0.05)
    fixed = fit_gaussians(cube(spark, data), [(30, 33, 15, 10, 10, 20)], {"cx", "cy"}, 0.5).first()
    assert (fixed["cx"], fixed["cy"], fixed["cx_error"]) == (30, 33, 0)


def test_slopes_are_those_of_the_model():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 30, 50), rng.uniform(0, 30, 50)
    p = np.array([12.0, 14.0, 5.0, 9.0, 6.0, 25.0, 18.0, 7.0, -3.0, 5.0, 8.0, -40.0, 0.7])
    for k, got in enumerate(slopes(p, x, y).T):
        h = np.zeros(len(p))
        h[k] = 1e-5
        assert np.allclose(got, (model(p + h, x, y) - model(p - h, x, y)) / 2e-5, atol=1e-6)


def test_angle_counts_from_the_y_axis():
    p = np.array([0.0, 0.0, 1.0, 10.0, 2.0, 0.0, 0.0])
    assert model(p, np.array([0.0]), np.array([5.0]))[0] == pytest.approx(0.5) and model(p, np.array([5.0]), np.array([0.0]))[0] < 1e-6


def test_fits_of_many_planes_and_their_images(spark):
    """Two components, planes with different truths, one with too few pixels; image = model + residual."""
    y, x = np.mgrid[0:40, 0:48]
    rng = np.random.default_rng(2)
    truth = [np.array([14.0 + z, 20.0, 10.0 + z, 8.0, 5.0, 30.0, 34.0, 12.0, 6.0, 5.0, 9.0, 70.0, 1.0]) for z in range(2)]
    data = np.stack([model(t, x.astype(float), y.astype(float)) + rng.normal(0, 0.002, x.shape) for t in truth] + [np.full(x.shape, np.nan)])
    data[2, 0, :3] = 1.0
    image = cube(spark, data).repartition(5)
    start = [(15, 19, 9, 7, 6, 25), (33, 13, 5, 6, 8, 60)]
    fitted = fit_gaussians(image, start, fit_background=True, beam=2.0, unit="Jy/beam")
    rows = {(r["z"], r["component"]): r for r in fitted.collect()}
    for z in range(2):
        for k in range(2):
            r = rows[z, k]
            assert r["converged"] and r["message"] is None
            for name, value in zip(("cx", "cy", "amp", "fwhm_x", "fwhm_y", "pa"), truth[z][6 * k : 6 * k + 6], strict=True):
                assert r[name] == pytest.approx(value, abs=0.05)
            assert r["flux"] == pytest.approx(r["amp"] * r["fwhm_x"] * r["fwhm_y"] / 4, rel=1e-9)
    assert rows[2, 0]["message"] == "insufficient data points" and rows[2, 0]["cx"] == 15
    parts = fit_images(image.where("z < 2"), fitted).collect()
    assert len(parts) == 2 * x.size
    for r in parts[:200]:
        t = np.array([rows[r["z"], k][n] for k in range(2) for n in ("cx", "cy", "amp", "fwhm_x", "fwhm_y", "pa")] + [rows[r["z"], 0]["background"]])
        assert r["model"] == pytest.approx(model(t, np.array([float(r["x"])]), np.array([float(r["y"])]))[0], abs=1e-9)
        assert r["model"] + r["residual"] == pytest.approx(r["v"], abs=1e-9)


def test_errors_of_white_and_correlated_noise():
    """At the limit of a tiny beam with noise per beam area, both formulas agree; angle 90 swaps the errors of the centre."""
    component = np.array([0.0, 0.0, 8.0, 12.0, 6.0, 0.0])
    white, flux, flux_error = errors(component, 0.5, None, "Jy/pixel")
    rho = math.pi * 12 * 6 / (8 * math.log(2)) * 256
    assert white[2] == pytest.approx(8 * math.sqrt(2 / rho)) and white[3] == pytest.approx(12 * math.sqrt(2 / rho))
    assert flux_error / flux == pytest.approx(math.sqrt(2 / rho))
    turned, *_ = errors(np.array([0.0, 0.0, 8.0, 12.0, 6.0, 90.0]), 0.5)
    assert turned[:2] == pytest.approx(white[1::-1])
    tiny = 1e-3
    correlated, *_ = errors(component, 0.5 * math.sqrt(2 * math.log(2) / math.pi) / tiny, tiny)
    assert correlated[:5] == pytest.approx(white[:5], rel=1e-3)
    assert errors(component, 0.5, 2.0, "Jy/pixel")[1] is None and math.isinf(errors(np.array([0, 0, 1, 5, 5, 0.0]), 1.0)[0][5])


def test_tiles_change_nothing(spark, noise):
    """Smoothing and convolution by small tiles equal those of the whole image."""
    rng = np.random.default_rng(4)
    data = rng.standard_normal((2, 30, 37)).astype(np.float32)
    data[0, 5:9, 10:14] = np.nan
    image = cube(spark, data).cache()
    beams, target = {0: (2.0, 2.0, 0.0), 1: (3.0, 2.0, 20.0)}, (4.5, 4.0, 30.0)
    whole = as_array(convolve_planes(image, beams, target), "z", "y", "x")
    assert np.allclose(as_array(convolve_planes(image, beams, target, side=7), "z", "y", "x"), whole, equal_nan=True)
    assert np.array_equal(np.isnan(whole), np.isnan(data))
    one = image.where("z = 0")
    smooth = as_array(resample.gaussian_smooth(one, 4, 37, 30), "y", "x")
    assert np.allclose(as_array(resample.gaussian_smooth(one, 4, 37, 30, side=5), "y", "x"), smooth, equal_nan=True)
    with pytest.raises(Exception, match="no beam"):
        convolve_planes(image, {0: (2.0, 2.0, 0.0)}, target).collect()


def test_convolution(spark):
    data = np.zeros((2, 21, 21), np.float32)
    data[:, 10, 10] = 1
    beams = {0: (4.0, 4.0, 0.0), 1: (5.0, 5.0, 0.0)}
    out = as_array(convolve_planes(cube(spark, data), beams, (5.0, 5.0, 0.0)), "z", "y", "x")
    assert np.array_equal(out[1], data[1]) and out[0].sum() == pytest.approx(1, abs=1e-3) and out[0, 10, 10] < 1
    assert out[0, 10, 12] == pytest.approx(out[0, 12, 10], rel=1e-4)
    with pytest.raises(Exception, match="smaller"):
        convolve_planes(cube(spark, data), beams, (3.0, 3.0, 0.0)).collect()


def test_percentiles_and_mad(spark, noise):
    c = cube(spark, noise)
    ok = noise[np.isfinite(noise)].astype(float)
    got = {r["rank"]: r["value"] for r in stats.exact_percentiles(c, (0.1, 0.5)).collect()}
    assert got[0.1] == pytest.approx(np.quantile(ok, 0.1)) and got[0.5] == pytest.approx(np.median(ok))
    near = {r["rank"]: r["value"] for r in stats.percentiles(c, (0.1, 0.5)).collect()}
    assert near[0.5] == pytest.approx(np.median(ok), abs=0.01)
    assert stats.mad(c).first()["mad"] == pytest.approx(1.4826 * np.median(np.abs(ok - np.median(ok))))


def test_small_helpers():
    assert polarization.parse_coordinate("Qz") == ("Q", "z") and polarization.parse_coordinate("Ptotalz") == ("Ptotal", "z") and polarization.parse_coordinate("x") == ("", "x")
    assert [polarization.fits_code(c) for c in (-1, 5)] == [5, -1]
    assert profiles.is_linear([1.0, 1.005], 1.0) and not profiles.is_linear([1.0, 1.02], 1.0)
    with pytest.raises(ValueError):
        polarization.parse_coordinate("Zz")
