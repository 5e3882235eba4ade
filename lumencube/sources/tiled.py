"""Tile-compressed FITS images: the convention of the FITS standard (version 4, section 10) for images kept in binary tables.

Each row of the table holds one compressed tile. A partition reads a range of rows; tiles of a batch are decoded together,
one lane of numpy each. Read are RICE_1, GZIP_1, GZIP_2 and uncompressed tiles of integer images, of floating-point images
that were scaled to integers (with either subtractive dither or none) and of those kept as they are. `save_tiled` writes
images of one-row tiles, without loss or as multiples of a step.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceReader
from pyspark.sql.window import Window

from ..scratch import stored
from .fits import BITPIX, BLOCK, CARD, PIXELS, WRITTEN, Hdu, Piece, _blank_file, _card, _open, axis_roles

# Fixed values of the Rice code by bytes of a pixel: bits of a block's header, the split that means "not coded".
RICE = {1: (3, 6), 2: (4, 14), 4: (5, 25)}
# Fixed values of scaled floating-point tiles: no value; exactly zero (second dither only).
NO_VALUE, ZERO_VALUE = -2147483647, -2147483646
# Fixed values of the dither: length and multiplier of the sequence, and its modulus; places among which a tile starts.
DITHER, MULTIPLIER, MODULUS, STARTS = 10_000, 16_807, 2_147_483_647, 500
#: Pixels of a Rice block that are coded alike; pixels decoded together.
SHARED, TOGETHER = 32, 250_000
#: Rows of a block of the scan that places compressed tiles.
PLACED = 4096


def _wrap(v: np.ndarray, size: int) -> np.ndarray:
    """Integers as pixels of so many bytes: signed, but for single bytes."""
    return v & 0xFF if size == 1 else ((v + (1 << (8 * size - 1))) & ((1 << (8 * size)) - 1)) - (1 << (8 * size - 1))


def rice_decode(streams: list[bytes], counts: np.ndarray, size: int = 4, shared: int = SHARED) -> list[np.ndarray]:
    """Pixels of Rice-coded streams, all decoded in step: pixel k of every stream at a time."""
    header, plain = RICE[size]
    data = np.frombuffer(b"".join(s + b"\0" * 8 for s in streams), np.uint8)
    starts = np.cumsum([0] + [len(s) + 8 for s in streams[:-1]])
    words = np.zeros(len(data), np.uint64)  # the 64 bits from each byte on
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    n_bits = 8 * len(data)
    ones = np.where(np.unpackbits(data) == 1, np.arange(n_bits, dtype=np.int64), n_bits)
    ones = np.minimum.accumulate(ones[::-1])[::-1]  # the first set bit from each bit on

    def bits(at, n):
        at = np.minimum(at, n_bits - 1)
        got = (words[at >> 3] << (at & 7).astype(np.uint64)) >> np.minimum(64 - n, 63).astype(np.uint64)
        return np.where(n > 0, got, 0).astype(np.int64)

    counts = np.asarray(counts, np.int64)
    lanes = len(streams)
    wide = lambda n: np.full(lanes, n, np.int64)
    last, at = bits(starts * 8, wide(8 * size)), starts * 8 + 8 * size
    out = np.zeros((lanes, int(counts.max(initial=0))), np.int64)
    split = wide(0)
    for k in range(out.shape[1]):
        if k % shared == 0:
            split = bits(at, wide(header)) - 1
            at = at + header
        same, raw = split < 0, split == plain
        low = np.where(same | raw, 0, split)
        stop = ones[np.minimum(at, n_bits - 1)]
        coded = ((stop - at) << low) | bits(stop + 1, low)
        mapped = np.where(same, 0, np.where(raw, bits(at, wide(8 * size)), coded))
        at = np.minimum(np.where(same, at, np.where(raw, at + 8 * size, stop + 1 + low)), n_bits - 1)
        last = last + np.where(mapped & 1, ~(mapped >> 1), mapped >> 1)
        out[:, k] = last
    out = _wrap(out, size)
    return [out[i, :n] for i, n in enumerate(counts)]


def rice_encode(pixels: np.ndarray, size: int = 4, shared: int = SHARED) -> bytes:
    """The Rice code of integers: each block takes the split that makes it shortest, or stays as it is."""
    header, plain = RICE[size]
    v = np.asarray(pixels, np.int64)
    if not len(v):
        return b""
    half = 1 << (8 * size - 1)
    step = np.diff(v, prepend=v[:1])
    step = ((step + half) & ((1 << (8 * size)) - 1)) - half
    blocks = -(-len(v) // shared)
    mapped = np.zeros(blocks * shared, np.int64)
    mapped[: len(v)] = np.where(step < 0, ~(step << 1), step << 1)
    mapped = mapped.reshape(blocks, shared)
    here = (np.arange(blocks * shared) < len(v)).reshape(blocks, shared)
    lengths = np.stack([((mapped >> s) + 1 + s).sum(axis=1, where=here) for s in range(plain)], axis=1)
    split = lengths.argmin(axis=1)
    split[lengths.min(axis=1) >= here.sum(axis=1) * 8 * size] = plain
    split[~mapped.any(axis=1)] = -1
    s = split[:, None]
    coded, raw = here & (s >= 0) & (s < plain), here & (s == plain)
    low = np.where(coded, s, 0)
    each = np.where(coded, (mapped >> low) + 1 + low, np.where(raw, 8 * size, 0))
    whole = header + each.sum(axis=1)
    start = np.cumsum(whole) - whole
    place = start[:, None] + header + np.cumsum(each, axis=1) - each
    bits = np.zeros(int(whole.sum()), np.uint8)
    for b in range(header):
        bits[start + header - 1 - b] = (split + 1) >> b & 1
    stop = place + (mapped >> low)
    bits[stop[coded]] = 1
    for b in range(int(low.max(initial=0))):
        put = coded & (low > b)
        bits[(stop + low - b)[put]] = (mapped[put] >> b) & 1
    for b in range(8 * size):
        bits[(place + 8 * size - 1 - b)[raw]] = (mapped[raw] >> b) & 1
    first = int(v[0]) & ((1 << (8 * size)) - 1)
    return first.to_bytes(size, "big") + np.packbits(bits).tobytes()


def dither_sequence() -> np.ndarray:
    out, seed = np.empty(DITHER), 1
    for i in range(DITHER):
        seed = seed * MULTIPLIER % MODULUS
        out[i] = seed / MODULUS
    return out


def dither_of(tile: int, first: int, n: int, sequence: np.ndarray) -> np.ndarray:
    """The dither of the n pixels of a tile (counted from 0); first: the file's ZDITHER0."""
    seed, parts = (tile + first - 1) % DITHER, []
    while n > 0:
        lo = int(sequence[seed] * STARTS)
        parts.append(sequence[lo : min(DITHER, lo + n)])
        n -= len(parts[-1])
        seed = (seed + 1) % DITHER
    return np.concatenate(parts) if parts else np.zeros(0)


def _gunzip(data: bytes, kind: str, n: int, shuffled: bool) -> np.ndarray:
    raw = zlib.decompress(data, wbits=47)
    if shuffled:
        raw = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T.tobytes()
    return np.frombuffer(raw, kind, n)


def _gzip(v: np.ndarray) -> bytes:
    """GZIP_2: the bytes of big-endian values, most significant ones first, compressed."""
    shuffled = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(shuffled) + packer.flush()


class TiledReader(DataSourceReader):
    """Pixels of a tile-compressed image, a partition for each range of tiles."""

    def __init__(self, path: str, unit: Hdu):
        self.path, self.unit, h = path, unit, unit.header
        self.shape = unit.shape
        self.tile = [min(h.get(f"ZTILE{i + 1}", n if i == 0 else 1), n) for i, n in enumerate(self.shape)]
        self.grid = [-(-n // t) for n, t in zip(self.shape, self.tile, strict=True)]
        self.method = str(h["ZCMPTYPE"]).strip().replace("RICE_ONE", "RICE_1")
        if self.method not in ("RICE_1", "GZIP_1", "GZIP_2", "NOCOMPRESS"):
            raise ValueError(f"no decoder for {self.method} tiles")
        named = {str(h.get(f"ZNAME{i}", "")).strip(): h.get(f"ZVAL{i}") for i in range(1, 10)}
        self.shared, self.size = named.get("BLOCKSIZE") or SHARED, named.get("BYTEPIX") or 4
        self.columns, at = {}, 0
        for i in range(1, h["TFIELDS"] + 1):
            form = str(h[f"TFORM{i}"]).strip()
            letter = form.lstrip("0123456789")[0]
            kind = {"P": ">i4", "Q": ">i8", "D": ">f8", "E": ">f4", "J": ">i4", "I": ">i2", "K": ">i8"}[letter]
            count = 2 if letter in "PQ" else 1
            element = form.split(letter, 1)[1][:1]
            self.columns[str(h[f"TTYPE{i}"]).strip()] = (at, kind, count, {"I": 2, "J": 4, "E": 4, "D": 8, "K": 8}.get(element, 1))
            at += np.dtype(kind).itemsize * count

    def partitions(self):
        tiles, step = math.prod(self.grid), max(1, PIXELS // math.prod(self.tile))
        step = tiles if self.path.endswith(".gz") else step
        return [Piece(i, min(tiles, i + step)) for i in range(0, tiles, max(1, step))]

    def _box(self, tile: int) -> tuple[list[int], list[int]]:
        """First pixel and size of a tile, axis by axis."""
        first = [int(k) * t for k, t in zip(np.unravel_index(tile, self.grid[::-1])[::-1], self.tile, strict=True)]
        return first, [min(t, n - f) for t, n, f in zip(self.tile, self.shape, first, strict=True)]

    def read(self, partition):
        h, roles = self.unit.header, axis_roles(self.unit.image)
        with _open(self.path) as f:
            step = max(1, TOGETHER // math.prod(self.tile))
            for lo in range(partition.start, partition.stop, step):
                hi = min(partition.stop, lo + step)
                boxes = [self._box(t) for t in range(lo, hi)]
                values = self._values(f, h, lo, hi, [math.prod(s) for _, s in boxes])
                places = [[p.astype(np.int32) + first[a] for a, p in enumerate(np.unravel_index(np.arange(math.prod(size)), size[::-1])[::-1])] for first, size in boxes]
                v = np.concatenate(values)
                axis = lambda r: np.concatenate([p[roles[r]] for p in places]) if roles[r] >= 0 else np.zeros(len(v), np.int32)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(axis(r)) for r in ("stokes", "z", "y", "x")] + [pa.array(v)], ["stokes", "z", "y", "x", "v"])

    def _values(self, f, h: dict, lo: int, hi: int, counts: list[int]) -> list[np.ndarray]:
        """float32 pixels of tiles lo to hi."""
        width = h["NAXIS1"]
        f.seek(self.unit.data_at + lo * width)
        rows = np.frombuffer(f.read((hi - lo) * width), np.uint8).reshape(hi - lo, width)

        def column(name):
            at, kind, count, _ = self.columns[name]
            return np.ascontiguousarray(rows[:, at : at + np.dtype(kind).itemsize * count]).view(kind).reshape(hi - lo, count)

        heap = self.unit.data_at + h.get("THEAP", width * h["NAXIS2"])

        def held(name):
            if name not in self.columns:
                return [b""] * (hi - lo)
            out = []
            for n, at in column(name).tolist():
                f.seek(heap + at)
                out.append(f.read(n * self.columns[name][3]))
            return out

        packed, zipped, plain = (held(c) for c in ("COMPRESSED_DATA", "GZIP_COMPRESSED_DATA", "UNCOMPRESSED_DATA"))
        each = lambda name, default: column(name)[:, 0].tolist() if name in self.columns else [h.get(name, default)] * (hi - lo)
        scales, zeros, blanks = each("ZSCALE", None), each("ZZERO", None), each("ZBLANK", h.get("BLANK"))
        real = h["ZBITPIX"] < 0
        kind = BITPIX[h["ZBITPIX"]]
        scaled = real and scales[0] is not None and str(h.get("ZQUANTIZ", "NO_DITHER")).strip() != "NONE"
        coded = ">i4" if scaled else kind
        riced = [i for i in range(hi - lo) if packed[i] and self.method == "RICE_1"]
        found = dict(zip(riced, rice_decode([packed[i] for i in riced], np.array([counts[i] for i in riced]), self.size, self.shared), strict=True)) if riced else {}
        sequence = dither_sequence() if scaled and "DITHER" in str(h.get("ZQUANTIZ", "")).replace("NO_DITHER", "") else None
        out = []
        for i, n in enumerate(counts):
            if i in found:
                v, whole = found[i], True
            elif packed[i]:
                v, whole = (np.frombuffer(packed[i], coded, n) if self.method == "NOCOMPRESS" else _gunzip(packed[i], coded, n, self.method == "GZIP_2")), True
            else:  # a tile that was not worth scaling
                v, whole = (_gunzip(zipped[i], kind, n, False) if zipped[i] else np.frombuffer(plain[i], kind, n)), not real
            if real and (not scaled or not whole):
                out.append(v.astype(np.float32))
                continue
            blank = (NO_VALUE if blanks[i] is None else blanks[i]) if real else blanks[i]
            w = v.astype(np.float64)
            if real:
                w = (w - dither_of(lo + i, h.get("ZDITHER0", 1), n, sequence) + 0.5 if sequence is not None else w) * scales[i] + zeros[i]
                if str(h.get("ZQUANTIZ", "")).strip() == "SUBTRACTIVE_DITHER_2":
                    w[v == ZERO_VALUE] = 0.0
            else:
                w = w * h.get("BSCALE", 1.0) + h.get("BZERO", 0.0)
            if blank is not None:
                w[v == blank] = np.nan
            out.append(w.astype(np.float32))
        return out


def save_tiled(cube: DataFrame, path: str, step: float | None = None, cards: dict | None = None, overwrite: bool = False) -> tuple[int, ...]:
    """Write a cube as a tile-compressed FITS image, one tile for each row of pixels; returns its shape (x, y, z, stokes).

    step: pixels are kept as 32-bit multiples of it, Rice-coded; None: as float32, without loss, by GZIP_2. NaN and pixels
    that the cube lacks have no value either way. Tasks compress the rows; a scan of two levels places them in the heap, and
    tasks write their own at these places, in a folder that all share.
    """
    x0, y0, nx, ny, nz, ns = cube.agg(F.min("x"), F.min("y"), F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1, F.max("z") + 1, F.max("stokes") + 1).first()
    shape = [nx, ny] + ([nz] if nz > 1 or ns > 1 else []) + ([ns] if ns > 1 else [])
    rows, each, empty = ny * nz * ns, max(1, WRITTEN // nx), -(1 << 31)

    def pack(block: pa.Table, pixels: pa.Table) -> pa.Table:
        lo = block.column("block")[0].as_py() * each
        data = np.full((min(each, rows - lo), nx), np.nan, np.float32)
        data[pixels.column("row").to_numpy() - lo, pixels.column("x").to_numpy()] = pixels.column("v").to_numpy()
        if step is None:
            tiles = [_gzip(r.astype(">f4")) for r in data]
        else:
            whole = np.rint(data.astype(np.float64) / step)
            if np.nanmax(np.abs(whole), initial=0) >= 1 << 31:
                raise ValueError("a pixel does not fit 32 bits at this step")
            tiles = [rice_encode(r) for r in np.where(np.isfinite(whole), whole, empty).astype(np.int64)]
        return pa.table({"row": pa.array(np.arange(lo, lo + len(data))), "data": pa.array(tiles, pa.binary())})

    row = (F.col("stokes").cast("long") * nz + F.col("z")) * ny + F.col("y") - y0
    placed = cube.select(row.alias("row"), (F.col("x") - x0).alias("x"), "v").withColumn("block", F.floor(F.col("row") / each))
    blocks = cube.sparkSession.range(-(-rows // each)).withColumnRenamed("id", "block")
    tiles = stored(blocks.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(pack, "row long, data binary"), "tiles")
    sizes = tiles.select("row", F.octet_length("data").cast("long").alias("n"), F.floor(F.col("row") / PLACED).alias("part"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy("part"))).drop("n")
    offsets = sizes.withColumn("at", before(Window.partitionBy("part").orderBy("row"))).join(parts, "part").select("row", (F.col("base") + F.col("at")).alias("at"))
    total, longest = sizes.agg(F.sum("n"), F.max("n")).first()
    letter, entry = ("P", ">i4") if total < 1 << 31 else ("Q", ">i8")
    width = 2 * np.dtype(entry).itemsize
    first = _blank_file(path, {"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True}, 0, overwrite)
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": width, "NAXIS2": rows, "PCOUNT": total, "GCOUNT": 1, "TFIELDS": 1, "TTYPE1": "COMPRESSED_DATA", "TFORM1": f"1{letter}B({longest})"}
    head |= {"ZIMAGE": True, "ZBITPIX": -32 if step is None else 32, "ZNAXIS": len(shape), **{f"ZNAXIS{i + 1}": n for i, n in enumerate(shape)}, **{f"ZTILE{i + 1}": nx if i == 0 else 1 for i in range(len(shape))}}
    head |= {"ZCMPTYPE": "GZIP_2", "ZQUANTIZ": "NONE"} if step is None else {"ZCMPTYPE": "RICE_1", "ZNAME1": "BLOCKSIZE", "ZVAL1": SHARED, "ZNAME2": "BYTEPIX", "ZVAL2": 4, "BSCALE": float(step), "BZERO": 0.0, "ZBLANK": empty}
    head |= ({"CTYPE4": "STOKES"} if ns > 1 else {}) | (cards or {})
    text = b"".join(_card(k, v) for k, v in head.items()) + b"END".ljust(CARD)
    text = text.ljust(-(-len(text) // BLOCK) * BLOCK)
    at = first + len(text)
    with open(path, "r+b") as f:
        f.seek(first)
        f.write(text)
        f.truncate(at + -(-(rows * width + total) // BLOCK) * BLOCK)

    def write(batches):
        for b in batches:
            with open(path, "r+b") as f:
                for r, data, place in zip(b.column("row").to_pylist(), b.column("data"), b.column("at").to_pylist(), strict=True):
                    f.seek(at + r * width)
                    f.write(np.array([len(data.as_py()), place], entry).tobytes())
                    f.seek(at + rows * width + place)
                    f.write(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["written"])

    done = tiles.join(offsets, "row").mapInArrow(write, "written long").agg(F.sum("written")).first()[0]
    if done != rows:
        raise OSError(f"{done} of {rows} tiles written")
    return tuple(shape)
