"""Tile-compressed images: the Rice code against a bit-by-bit decoder, files of every kind of tile, round trips."""

import gzip
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumencube.sources import files, fits, tiled
from tests.test_operators import as_array, cube


def slow_decode(data, n, size, shared=32):
    """One bit at a time."""
    bits = "".join(f"{b:08b}" for b in data)
    at = 8 * size
    last, out = int(bits[:at], 2), []
    header, plain = tiled.RICE[size]
    while len(out) < n:
        split = int(bits[at : at + header], 2) - 1
        at += header
        for _ in range(min(shared, n - len(out))):
            m = 0
            if split == plain:
                m, at = int(bits[at : at + 8 * size], 2), at + 8 * size
            elif split >= 0:
                zeros = bits.index("1", at) - at
                at += zeros + 1
                m = zeros << split | int("0" + bits[at : at + split], 2)
                at += split
            last = (last + (-(m + 1) // 2 if m & 1 else m // 2)) % (1 << 8 * size)
            out.append(last)
    return [v - (1 << 8 * size) if size > 1 and v >= 1 << (8 * size - 1) else v for v in out]


@pytest.mark.parametrize("size", [1, 2, 4])
def test_rice_code(size):
    rng = np.random.default_rng(size)
    lo, hi = (0, 256) if size == 1 else (-(1 << (8 * size - 1)), 1 << (8 * size - 1))
    rows = [rng.integers(lo, hi, n) for n in (1, 31, 32, 33, 200)]
    rows += [np.full(70, 5), np.clip(np.cumsum(rng.integers(-3, 4, 500)), lo, hi - 1), np.tile([lo, hi - 1], 40), np.r_[np.full(64, 9), rng.integers(0, 100, 64), np.full(5, 1)]]
    packed = [tiled.rice_encode(r, size) for r in rows]
    assert [g.tolist() for g in tiled.rice_decode(packed, np.array([len(r) for r in rows]), size)] == [r.tolist() for r in rows]
    for r, p in zip(rows, packed, strict=True):
        assert slow_decode(p, len(r), size) == r.tolist()
    assert len(packed[5]) < 10 and len(packed[6]) < 500  # flat, and of small steps


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=90), min_size=1, max_size=5))
def test_rice_round_trip(rows):
    packed = [tiled.rice_encode(np.array(r)) for r in rows]
    assert [g.tolist() for g in tiled.rice_decode(packed, np.array([len(r) for r in rows]))] == rows


def test_dither_sequence():
    sequence = tiled.dither_sequence()
    assert round(sequence[-1] * tiled.MODULUS) == 1043618065  # the check value that the standard gives
    long = tiled.dither_of(3, 9999, 25_000, sequence)
    seed = (3 + 9998) % 10_000
    want, lo = [], int(sequence[seed] * 500)
    while len(want) < 25_000:
        want.append(sequence[lo])
        lo += 1
        if lo == 10_000:
            seed = (seed + 1) % 10_000
            lo = int(sequence[seed] * 500)
    assert long.tolist() == want


def write_tiled(path, shape, tile, tiles, head, columns=("COMPRESSED_DATA",), extra=()):
    """tiles: for each tile, bytes per column of `columns`, then values of the extra (name, form, numpy type) columns."""
    heap, rows = b"", b""
    for t in tiles:
        for data in t[: len(columns)]:
            rows += np.array([len(data), len(heap)], ">i4").tobytes()
            heap += data
        for v, (_, _, kind) in zip(t[len(columns) :], extra, strict=True):
            rows += np.array([v], kind).tobytes()
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", len(rows) // len(tiles)), ("NAXIS2", len(tiles)), ("PCOUNT", len(heap) + 16), ("GCOUNT", 1), ("TFIELDS", len(columns) + len(extra)), ("THEAP", len(rows) + 16)]
    for i, (n, form) in enumerate([*[(c, "1PB(99)") for c in columns], *[e[:2] for e in extra]]):
        cards += [(f"TTYPE{i + 1}", n), (f"TFORM{i + 1}", form)]
    cards += [("ZIMAGE", True), ("ZNAXIS", len(shape)), *[(f"ZNAXIS{i + 1}", n) for i, n in enumerate(shape)], *[(f"ZTILE{i + 1}", n) for i, n in enumerate(tile)], *head]
    block = lambda cs: (b"".join(fits._card(k, v) for k, v in cs) + b"END".ljust(80)).ljust(-(-(80 * len(cs) + 80) // 2880) * 2880)
    data = rows + b"\xff" * 16 + heap
    path.write_bytes(block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + block(cards) + data.ljust(-(-len(data) // 2880) * 2880, b"\0"))


def boxes(data, tile):
    """Tiles of a (y, x) array, x fastest."""
    return [data[y : y + tile[1], x : x + tile[0]].ravel() for y in range(0, data.shape[0], tile[1]) for x in range(0, data.shape[1], tile[0])]


@pytest.mark.parametrize(("method", "size"), [("RICE_1", 4), ("RICE_ONE", 2), ("RICE_1", 1), ("GZIP_1", 2), ("GZIP_2", 4), ("NOCOMPRESS", 2)])
def test_integer_tiles(spark, tmp_path, method, size):
    data = np.random.default_rng(1).integers(0, 200, (11, 13))
    data[4, 5] = 77
    kind = {1: ">u1", 2: ">i2", 4: ">i4"}[size]
    raw = lambda v: v.astype(kind).tobytes()
    pack = {"R": lambda v: tiled.rice_encode(v, size), "GZIP_1": lambda v: gzip.compress(raw(v)), "GZIP_2": lambda v: tiled._gzip(v.astype(kind)), "NOCOMPRESS": raw}[method if method[0] != "R" else "R"]
    head = [("ZBITPIX", 8 * size), ("ZCMPTYPE", method), ("BSCALE", 0.5), ("BZERO", 1.0), ("ZBLANK", 77), ("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", size)]
    path = tmp_path / "a.fits.fz"
    write_tiled(path, (13, 11), (5, 4), [(pack(t),) for t in boxes(data, (5, 4))], head)
    got = as_array(files.open_image(spark, str(path)), "y", "x")
    want = np.where(data == 77, np.nan, data * 0.5 + 1)
    np.testing.assert_array_equal(got, want)
    assert fits.hdu_list(str(path)) == [(1, "", [13, 11])]
    info = {(r["section"], r["key"]): r["value"] for r in fits.file_info(spark, str(path)).collect()}
    assert info["computed", "Shape"] == "[13, 11]" and info["header", "NAXIS1"] == "13" and ("header", "ZIMAGE") not in info


@pytest.mark.parametrize("dither", ["NO_DITHER", "SUBTRACTIVE_DITHER_1", "SUBTRACTIVE_DITHER_2"])
def test_scaled_tiles(spark, tmp_path, monkeypatch, dither):
    """Tiles scaled to integers, one of them kept as it is, with pixels without value and exact zeros."""
    monkeypatch.setattr(tiled, "TOGETHER", 40)
    rng = np.random.default_rng(2)
    data = rng.normal(0, 1, (9, 30)).astype(np.float32)
    data[2, 3], data[5, 6] = np.nan, 0.0
    sequence, tiles = tiled.dither_sequence(), []
    for i, row in enumerate(data):
        scale, zero = 0.01 * (1 + i), -0.5 * i
        if i == 7:
            tiles.append((b"", gzip.compress(row.astype(">f4").tobytes()), 0.0, 0.0))
            continue
        shift = 0 if dither == "NO_DITHER" else tiled.dither_of(i, 5, 30, sequence) - 0.5
        whole = np.rint((np.nan_to_num(row.astype(np.float64)) - zero) / scale + shift).astype(np.int64)
        whole[np.isnan(row)] = tiled.NO_VALUE
        if dither.endswith("2"):
            whole[row == 0] = tiled.ZERO_VALUE
        tiles.append((tiled.rice_encode(whole), b"", scale, zero))
    path = tmp_path / "b.fz"
    head = [("ZBITPIX", -32), ("ZCMPTYPE", "RICE_1"), ("ZQUANTIZ", dither), ("ZDITHER0", 5)]
    write_tiled(path, (30, 9), (30, 1), tiles, head, ("COMPRESSED_DATA", "GZIP_COMPRESSED_DATA"), [("ZSCALE", "1D", ">f8"), ("ZZERO", "1D", ">f8")])
    got = as_array(spark.read.format("fits_image").load(str(path)), "y", "x")
    assert np.isnan(got[2, 3]) and np.isnan(got).sum() == 1
    np.testing.assert_array_equal(got[7], data[7])
    for i in range(9):
        assert np.nanmax(np.abs(got[i] - data[i])) <= 0.01 * (1 + i) * 0.5001 + 1e-6
    if dither.endswith("2"):
        assert got[5, 6] == 0.0


def test_unknown_tiles_are_refused(spark, tmp_path):
    path = tmp_path / "c.fz"
    write_tiled(path, (3, 1), (3, 1), [(b"abc",)], [("ZBITPIX", 16), ("ZCMPTYPE", "HCOMPRESS_1")])
    with pytest.raises(Exception, match="no decoder for HCOMPRESS_1"):
        spark.read.format("fits_image").load(str(path)).count()


@pytest.mark.parametrize("step", [None, 0.25])
def test_written_tiles(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(tiled, "WRITTEN", 40)
    monkeypatch.setattr(tiled, "PIXELS", 70)
    monkeypatch.setattr(tiled, "PLACED", 4)
    data = np.random.default_rng(3).integers(-500, 500, (2, 3, 7, 12)) * 0.25
    data = data.astype(np.float32)
    data[0, 1] = np.nan
    data[1, 2, 3, 4] = np.nan
    path = str(tmp_path / "d.fits.fz")
    assert tiled.save_tiled(cube(spark, data).where("not (stokes = 1 and z = 0 and y = 2)"), path, step, {"BUNIT": "Jy"}) == (12, 7, 3, 2)
    data[1, 0, 2] = np.nan
    got = spark.read.format("fits_image").load(path)
    reader = tiled.TiledReader(path, fits.hdus(path)[1])
    pieces = reader.partitions()
    assert len(pieces) == 9 and sum(b.num_rows for p in pieces for b in reader.read(p)) == data.size
    np.testing.assert_array_equal(as_array(got, "stokes", "z", "y", "x"), data)
    header = fits.hdus(path)[1].image
    assert header["BUNIT"] == "Jy" and header["NAXIS4"] == 2 and header["CTYPE4"] == "STOKES"
    with pytest.raises(FileExistsError):
        tiled.save_tiled(cube(spark, data), path, step)


def test_a_step_too_small_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit 32 bits"):
        tiled.save_tiled(cube(spark, np.array([[1e6, 2.0]])), str(tmp_path / "e.fz"), 1e-5)
