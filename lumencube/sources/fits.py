"""FITS: images as pixel cubes and binary tables as catalogs, read in parallel; a writer for images.

    spark.dataSource.register(FitsImage); spark.read.format("fits_image").load(path)

Pixels are converted to float32; BSCALE, BZERO and BLANK are applied. Every partition reads its own stretch of planes or
rows. Files ending in .gz are read by one partition each. Tile-compressed images (.fz) are read by ranges of tiles.
"""

from __future__ import annotations

import gzip
import math
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, CARD = 2880, 80
BITPIX = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: TFORM letter: (numpy type, Spark type)
COLUMNS = {"L": ("S1", "boolean"), "B": (">u1", "smallint"), "S": (">i1", "tinyint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
#: TFORM letters of other columns and bytes of one element: these are skipped.
SKIPPED = {"X": 1 / 8, "C": 8, "M": 16, "P": 8, "Q": 16}
#: Pixels and rows that a partition reads.
PIXELS, ROWS = 4_000_000, 1_000_000
#: Pixels that a task writes at a time, and rows of a table that it sorts and writes, about.
WRITTEN, SORTED = 1_000_000, 250_000


def _open(path: str):
    path = path.removeprefix("file://").removeprefix("file:")
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def parse_card(card: str):
    """(key, value) of a header card; the value is text, bool, int or float, or None."""
    key = card[:8].rstrip()
    if card[8:10] != "= ":
        return key, None
    text = card[10:].strip()
    if text.startswith("'"):
        end = 1
        while end < len(text):
            if text[end] == "'":
                if text[end + 1 : end + 2] != "'":
                    break
                end += 1
            end += 1
        return key, text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return key, text == "T"
    for kind in (int, lambda s: float(s.replace("D", "E"))):
        try:
            return key, kind(text)
        except ValueError:
            continue
    return key, None


@dataclass
class Hdu:
    header: dict
    data_at: int
    history: list[str] = field(default_factory=list)

    @property
    def is_tiled(self) -> bool:
        """Whether a table holds a compressed image."""
        return self.header.get("ZIMAGE") is True and str(self.header.get("XTENSION", "")).strip() == "BINTABLE"

    @property
    def image(self) -> dict:
        """The header of the image, for a compressed one too."""
        if not self.is_tiled:
            return self.header
        kept = {k: v for k, v in self.header.items() if not re.match(r"Z|T(TYPE|FORM|FIELDS|HEAP)|NAXIS|BITPIX|[PG]COUNT|XTENSION", k)}
        return {"BITPIX": self.header["ZBITPIX"], "NAXIS": self.header["ZNAXIS"], **{f"NAXIS{i + 1}": self.header[f"ZNAXIS{i + 1}"] for i in range(self.header["ZNAXIS"])}, **kept}

    @property
    def shape(self) -> list[int]:
        return [self.image.get(f"NAXIS{i + 1}", 0) for i in range(self.image.get("NAXIS", 0))]

    @property
    def size(self) -> int:
        """Bytes of the data as stored."""
        n = math.prod(self.header.get(f"NAXIS{i + 1}", 0) for i in range(self.header["NAXIS"])) if self.header.get("NAXIS") else 0
        return abs(self.header.get("BITPIX", 8)) // 8 * (n + self.header.get("PCOUNT", 0)) * self.header.get("GCOUNT", 1) if n else 0

    @property
    def is_image(self) -> bool:
        kind = self.header.get("XTENSION", "IMAGE" if self.header.get("SIMPLE") else "")
        return self.is_tiled and self.header["ZNAXIS"] >= 2 or str(kind).strip() == "IMAGE" and self.header.get("BITPIX") in BITPIX and self.header.get("NAXIS", 0) >= 2


def hdus(path: str) -> list[Hdu]:
    """Headers of all units; data are skipped."""
    out, at = [], 0
    with _open(path) as f:
        while True:
            header, history, done = {}, [], False
            while not done:
                block = f.read(BLOCK)
                if len(block) < BLOCK:
                    return out
                at += BLOCK
                for i in range(0, BLOCK, CARD):
                    card = block[i : i + CARD].decode("ascii", "replace")
                    if card.startswith("END") and not card[3:].strip():
                        done = True
                        break
                    if card.startswith("HISTORY"):
                        history.append(card[8:].rstrip())
                    key, value = parse_card(card)
                    if key and value is not None:
                        header.setdefault(key, value)
            hdu = Hdu(header, at, history)
            out.append(hdu)
            at += -(-hdu.size // BLOCK) * BLOCK
            f.seek(at)


def hdu_list(path: str) -> list[tuple[int, str, list[int]]]:
    """(number, name, shape) of the image units."""
    return [(i, str(h.header.get("EXTNAME", "")), h.shape) for i, h in enumerate(hdus(path)) if h.is_image]


def file_info(spark, path: str, hdu: int = -1) -> DataFrame:
    """section, key, value: the header's cards, and entries computed from them."""
    units = hdus(path)
    number = hdu if hdu >= 0 else next(i for i, u in enumerate(units) if u.is_image)
    unit = units[number]
    h, roles = unit.image, axis_roles(unit.image)
    size = lambda r: unit.shape[roles[r]] if roles[r] >= 0 else 1
    scaled = h.get("BITPIX", 0) > 0 and (h.get("BSCALE", 1) != 1 or h.get("BZERO", 0) != 0)
    computed = {
        "Name": os.path.basename(path),
        "HDU": number,
        "Extension name": h.get("EXTNAME", ""),
        "Data type": "float" if scaled or h.get("BITPIX") == -32 else "double" if h.get("BITPIX") == -64 else f"int{h.get('BITPIX')}",
        "Shape": unit.shape,
        "Number of channels": size("z"),
        "Number of polarizations": size("stokes"),
        "Pixel increment": [h.get(f"CDELT{roles[r] + 1}") for r in "xy"],
        "Pixel unit": h.get("BUNIT", ""),
        "Celestial frame": h.get("RADESYS", ""),
        "Spectral frame": h.get("SPECSYS", ""),
        "Beam": [h[k] for k in ("BMAJ", "BMIN", "BPA") if k in h],
    }
    rows = [("header", k, str(v)) for k, v in h.items()] + [("computed", k, str(v)) for k, v in computed.items()]
    return spark.createDataFrame(rows, "section string, key string, value string")


def beam_area(header: dict) -> float | None:
    """Pixels under the restoring beam; None without one."""
    if not all(k in header for k in ("BMAJ", "BMIN", "CDELT1", "CDELT2")):
        return None
    return math.pi / (4 * math.log(2)) * header["BMAJ"] * header["BMIN"] / abs(header["CDELT1"] * header["CDELT2"])


def axis_roles(header: dict) -> dict[str, int]:
    """0-based axes: x and y are the first two that are not stokes, z the next, stokes by name."""
    n = header.get("NAXIS", 0)
    stokes = next((i for i in range(n) if str(header.get(f"CTYPE{i + 1}", "")).upper().startswith("STOKES")), -1)
    rest = [i for i in range(n) if i != stokes]
    return {"x": rest[0], "y": rest[1], "z": rest[2] if len(rest) > 2 else -1, "stokes": stokes}


@dataclass
class Piece(InputPartition):
    start: int
    stop: int

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _ImageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.hdu = int(options.get("hdu", -1))

        self.unit: Hdu | None = None

    def _unit(self) -> Hdu:
        """Read once, on the driver; tasks get it with the reader."""
        if self.unit is None:
            self.unit = self._find()
        return self.unit

    def _find(self) -> Hdu:
        units = hdus(self.path)
        return units[self.hdu] if self.hdu >= 0 else next(h for h in units if h.is_image)

    def partitions(self):
        shape = self._unit().shape
        row, rows = shape[0], math.prod(shape[1:])
        step = max(1, PIXELS // max(1, row)) if not self.path.endswith(".gz") else rows
        return [Piece(i, min(rows, i + step)) for i in range(0, rows, step)]

    def read(self, partition):
        unit = self._unit()
        h, shape, roles = unit.header, unit.shape, axis_roles(unit.header)
        kind = np.dtype(BITPIX[h["BITPIX"]])
        scale, zero, blank = h.get("BSCALE", 1.0), h.get("BZERO", 0.0), h.get("BLANK") if h["BITPIX"] > 0 else None
        with _open(self.path) as f:
            for lo in range(partition.start, partition.stop, max(1, 250_000 // max(1, shape[0]))):
                hi = min(partition.stop, lo + max(1, 250_000 // max(1, shape[0])))
                f.seek(unit.data_at + lo * shape[0] * kind.itemsize)
                raw = np.frombuffer(f.read((hi - lo) * shape[0] * kind.itemsize), kind)
                v = raw.astype(np.float64) * scale + zero if (scale, zero) != (1.0, 0.0) else raw
                v = v.astype(np.float32)
                if blank is not None:
                    v[raw == blank] = np.nan
                index = np.unravel_index(np.arange(lo * shape[0], hi * shape[0]), shape[::-1])[::-1]
                axis = lambda r: index[roles[r]].astype(np.int32) if roles[r] >= 0 else np.zeros(len(v), np.int32)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(axis(r)) for r in ("stokes", "z", "y", "x")] + [pa.array(v)], ["stokes", "z", "y", "x", "v"])


class FitsImage(DataSource):
    """A FITS image (2-D to 4-D) as a pixel cube; option hdu picks a unit, else the first image."""

    @classmethod
    def name(cls):
        return "fits_image"

    def schema(self):
        return "stokes int, z int, y int, x int, v float"

    def reader(self, schema):
        plain = _ImageReader(self.options)
        if plain._unit().is_tiled:
            from .tiled import TiledReader

            return TiledReader(plain.path, plain._unit())
        return plain


def table_layout(header: dict) -> tuple[list[tuple[str, str, str, int, int]], list[str]]:
    """(name, letter, Spark type, offset, width) of the readable columns, and the names of the others."""
    out, skipped, at = [], [], 0
    for i in range(1, header.get("TFIELDS", 0) + 1):
        form = str(header[f"TFORM{i}"]).strip()
        digits = "".join(c for c in form[:8] if c.isdigit()) if form[:1].isdigit() else ""
        repeat, letter = int(digits or 1), form[len(digits)]
        name = str(header.get(f"TTYPE{i}", f"col{i}"))
        if letter == "A":
            width = int(form[len(digits) + 1 :] or repeat)
            (out.append((name, "A", "string", at, repeat)) if width == repeat else skipped.append(name))
            at += repeat
        elif letter in COLUMNS:
            np_type, kind = COLUMNS[letter]
            if repeat == 1:
                unsigned = {("I", 32768): "int", ("J", 2147483648): "bigint", ("K", 9223372036854775808): "decimal(20,0)"}.get((letter, header.get(f"TZERO{i}", 0)))
                out.append((name, letter, unsigned or kind, at, np.dtype(np_type).itemsize))
            else:
                skipped.append(name)
            at += np.dtype(np_type).itemsize * repeat
        else:
            skipped.append(name)
            at += math.ceil(SKIPPED.get(letter, 1) * repeat)
    return out, skipped


class _TableReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.unit: Hdu | None = None

    def _unit(self) -> Hdu:
        if self.unit is None:
            self.unit = next(h for h in hdus(self.path) if str(h.header.get("XTENSION", "")).strip() == "BINTABLE" and not h.is_tiled)
        return self.unit

    def partitions(self):
        rows = self._unit().header["NAXIS2"]
        step = rows if self.path.endswith(".gz") else ROWS
        return [Piece(i, min(rows, i + step)) for i in range(0, rows, max(1, step))]

    def read(self, partition):
        unit = self._unit()
        width, (layout, _) = unit.header["NAXIS1"], table_layout(unit.header)
        with _open(self.path) as f:
            for lo in range(partition.start, partition.stop, 50_000):
                hi = min(partition.stop, lo + 50_000)
                f.seek(unit.data_at + lo * width)
                raw = np.frombuffer(f.read((hi - lo) * width), np.uint8).reshape(hi - lo, width)
                columns = [pa.array(np.arange(lo, hi))]
                for _, letter, kind, at, size in layout:
                    cell = np.ascontiguousarray(raw[:, at : at + size])
                    if letter == "A":
                        columns.append(pa.array([bytes(c).split(b"\0")[0].decode("utf-8", "replace").rstrip(" ") for c in cell], pa.string()))
                    elif letter == "L":
                        columns.append(pa.array(cell[:, 0] == ord("T")))
                    else:
                        v = cell.view(COLUMNS[letter][0])[:, 0]
                        if kind == "decimal(20,0)":
                            columns.append(pa.array([int(x) + 2**63 for x in v], pa.decimal128(20, 0)))
                        elif (letter, kind) in (("I", "int"), ("J", "bigint")):
                            columns.append(pa.array(v.astype(np.int64) + (32768 if letter == "I" else 2147483648), pa.int32() if letter == "I" else pa.int64()))
                        else:
                            target = {"smallint": np.int16, "tinyint": np.int8, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[kind]
                            columns.append(pa.array(v.astype(target)))
                yield pa.RecordBatch.from_arrays(columns, ["row_id", *[c[0] for c in layout]])


class FitsTable(DataSource):
    """The first binary table of a FITS file, with row_id; columns of arrays and complex numbers are left out."""

    @classmethod
    def name(cls):
        return "fits_table"

    def schema(self):
        unit = _TableReader(self.options)._unit()
        return "row_id bigint, " + ", ".join(f"`{n}` {kind}" for n, _, kind, _, _ in table_layout(unit.header)[0])

    def reader(self, schema):
        return _TableReader(self.options)


def _card(key: str, value) -> bytes:
    text = f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"'{value:<8}'" if isinstance(value, str) else f"{value!r:>20}"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii")


def _blank_file(path: str, head: dict, size: int, overwrite: bool) -> int:
    """A file with a header and room for `size` bytes of data; returns where the data start."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    text = b"".join(_card(k, v) for k, v in head.items()) + b"END".ljust(CARD)
    start = -(-len(text) // BLOCK) * BLOCK
    with open(path, "wb") as f:
        f.write(text.ljust(start))
        f.truncate(start + -(-size // BLOCK) * BLOCK)
    return start


def save_image(cube: DataFrame, path: str, cards: dict | None = None, channels: tuple[int, int, int] | None = None, stokes: tuple[int, int, int] | None = None, overwrite: bool = False) -> tuple[int, ...]:
    """Write a cube as a float32 FITS image; returns its shape (x, y, z, stokes). channels and stokes: (start, end, stride).

    The driver writes the header; every task fills its own stretch of rows in the file, which is in a folder that all
    share. A stretch that is written again gets the same bytes. Pixels that the cube lacks are NaN.
    """
    from pyspark.sql import functions as F

    for name, part in (("z", channels), ("stokes", stokes)):
        if part:
            start, end, stride = part
            cube = cube.where(F.col(name).between(start, end) & ((F.col(name) - start) % stride == 0)).withColumn(name, F.floor((F.col(name) - start) / stride).cast("int"))
    x0, y0, nx, ny, nz, ns = cube.agg(F.min("x"), F.min("y"), F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1, F.max("z") + 1, F.max("stokes") + 1).first()
    shape = [nx, ny] + ([nz] if nz > 1 or ns > 1 else []) + ([ns] if ns > 1 else [])
    head = {"SIMPLE": True, "BITPIX": -32, "NAXIS": len(shape), **{f"NAXIS{i + 1}": n for i, n in enumerate(shape)}, **({"CTYPE4": "STOKES"} if ns > 1 else {}), **(cards or {})}
    rows = ny * nz * ns
    at = _blank_file(path, head, rows * nx * 4, overwrite)
    each = max(1, WRITTEN // nx)

    def write(block: pa.Table, pixels: pa.Table) -> pa.Table:
        lo = block.column("block")[0].as_py() * each
        data = np.full((min(each, rows - lo), nx), np.nan, ">f4")
        data[pixels.column("row").to_numpy() - lo, pixels.column("x").to_numpy()] = pixels.column("v").to_numpy()
        with open(path, "r+b") as f:
            f.seek(at + lo * nx * 4)
            f.write(data.tobytes())
        return pa.table({"written": pa.array([data.size], pa.int64())})

    row = (F.col("stokes").cast("long") * nz + F.col("z")) * ny + F.col("y") - y0
    placed = cube.select(row.alias("row"), (F.col("x") - x0).alias("x"), "v").withColumn("block", F.floor(F.col("row") / each))
    blocks = cube.sparkSession.range(-(-rows // each)).withColumnRenamed("id", "block")
    done = blocks.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(write, "written long").agg(F.sum("written")).first()[0]
    if done != rows * nx:
        raise OSError(f"{done} of {rows * nx} pixels written")
    return tuple(shape)


#: Spark type: (TFORM letter, numpy type) of the columns of a written table; text is padded to its longest.
WRITES = {"boolean": ("L", "S1"), "smallint": ("I", ">i2"), "int": ("J", ">i4"), "bigint": ("K", ">i8"), "float": ("E", ">f4"), "double": ("D", ">f8"), "string": ("A", "S")}


def save_table(df: DataFrame, path: str, row_id: str = "row_id", overwrite: bool = False) -> int:
    """Write a table as a FITS binary table, every row at the place that row_id (0, 1, 2 ...) gives it; returns the rows.

    As in save_image, tasks write their own rows. Null is not supported.
    """
    from pyspark.sql import functions as F

    kinds = [(c, k) for c, k in df.dtypes if c != row_id]
    widths = df.agg(F.count("*"), *[F.max(F.octet_length(c)).alias(c) for c, k in kinds if k == "string"]).first()
    n = widths[0]
    layout = [(c, *WRITES[k], max(1, widths[c] or 0) if k == "string" else np.dtype(WRITES[k][1]).itemsize) for c, k in kinds]
    record = np.dtype([(c, f"S{w}" if letter == "A" else kind) for c, letter, kind, w in layout])
    head: dict = {"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True}
    first = _blank_file(path, head, 0, overwrite)
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": record.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(layout)}
    for i, (c, letter, _, w) in enumerate(layout):
        head |= {f"TTYPE{i + 1}": c, f"TFORM{i + 1}": f"{w}A" if letter == "A" else f"1{letter}"}
    text = b"".join(_card(k, v) for k, v in head.items()) + b"END".ljust(CARD)
    text = text.ljust(-(-len(text) // BLOCK) * BLOCK)
    at = first + len(text)
    with open(path, "r+b") as f:
        f.seek(first)
        f.write(text)
        f.truncate(at + -(-n * record.itemsize // BLOCK) * BLOCK)

    def write(batches):
        for b in batches:
            rows = np.zeros(b.num_rows, record)
            for c, letter, _, _ in layout:
                v = b.column(c)
                rows[c] = [x.encode() for x in v.to_pylist()] if letter == "A" else np.where(v.to_numpy(zero_copy_only=False), b"T", b"F") if letter == "L" else v.to_numpy(zero_copy_only=False)
            place = b.column(row_id).to_numpy()
            cut = np.flatnonzero(np.r_[True, np.diff(place) != 1, True])
            with open(path, "r+b") as f:
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    f.seek(at + int(place[lo]) * record.itemsize)
                    f.write(rows[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["written"])

    ordered = df.repartitionByRange(max(1, -(-n // SORTED)), row_id).sortWithinPartitions(row_id)
    return ordered.mapInArrow(write, "written long").agg(F.sum("written")).first()[0]


def beams(path: str) -> list[tuple[float, float, float]]:
    """Beams (major, minor, angle in degrees): from the header, from a table named BEAMS (one per channel), or from the history."""
    units = hdus(path)
    for u in units:
        if all(k in u.header for k in ("BMAJ", "BMIN")):
            return [(u.header["BMAJ"], u.header["BMIN"], u.header.get("BPA", 0.0))]
    for u in units:
        if str(u.header.get("EXTNAME", "")).strip() == "BEAMS":
            layout = {n: (letter, at) for n, letter, _, at, _ in table_layout(u.header)[0]}
            unit = {str(u.header.get(f"TTYPE{i}", "")).strip(): str(u.header.get(f"TUNIT{i}", "arcsec")).strip() for i in range(1, u.header["TFIELDS"] + 1)}
            factor = lambda n: 1 / 3600 if unit[n] == "arcsec" else 1.0  # noqa: E731, B023
            width, rows = u.header["NAXIS1"], u.header["NAXIS2"]
            with _open(path) as f:
                f.seek(u.data_at)
                raw = np.frombuffer(f.read(width * rows), np.uint8).reshape(rows, width)
            cell = lambda n: np.ascontiguousarray(raw[:, layout[n][1] : layout[n][1] + np.dtype(COLUMNS[layout[n][0]][0]).itemsize]).view(COLUMNS[layout[n][0]][0])[:, 0]  # noqa: E731, B023
            return [(float(a) * factor("BMAJ"), float(b) * factor("BMIN"), float(c)) for a, b, c in zip(cell("BMAJ"), cell("BMIN"), cell("BPA"), strict=True)]
    number = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
    for u in units:
        for line in reversed(u.history):
            if m := re.search(rf"BMAJ=\s*{number}\s+BMIN=\s*{number}\s+BPA=\s*{number}", line):
                return [tuple(float(x) for x in m.groups())]
    return []
