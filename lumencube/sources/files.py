"""Files: guessed types, listings, units and cut-out addresses."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IMAGES = {".fits": "fits", ".fz": "fits", ".fits.gz": "fits_gz", ".hdf5": "hdf5", ".h5": "hdf5"}
_TABLES = {".xml": "votable", ".vot": "votable", ".votable": "votable", ".fits": "fits"}
_REGIONS = {".crtf": "crtf", ".reg": "ds9"}


def _by_name(path: str, known: dict[str, str]) -> str:
    return next((t for end, t in sorted(known.items(), key=lambda x: -len(x[0])) if path.lower().endswith(end)), "unknown")


def kind_of(start: bytes) -> str:
    """Type by the first bytes."""
    if start[:4] == b"SIMP":
        return "fits"
    if start[:4] == b"<?xm":
        return "votable"
    if start[:4] == b"\x89HDF":
        return "hdf5"
    if start[:2] == b"\x1f\x8b":
        return "gzip"
    if start[:6] == b"#CRTFv":
        return "crtf"
    if start[:13] == b"# Region file":
        return "ds9"
    return "unknown"


def guess(path: str, what: str = "image", by_content: bool = True) -> str:
    """Type of an image, table or region file, by its content or else its name."""
    known = {"image": _IMAGES, "table": _TABLES, "region": _REGIONS}[what]
    if by_content and os.path.isfile(path):
        with open(path, "rb") as f:
            kind = kind_of(f.read(16))
        if kind not in ("unknown", "gzip"):
            return kind
    return _by_name(path, known)


def kind_column(content: Column) -> Column:
    """kind_of() as an expression over a binary column."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "53494D50", "fits").when(head == "3C3F786D", "votable").when(head == "89484446", "hdf5").when(F.substring(head, 1, 4) == "1F8B", "gzip").when(head == "23435254", "crtf").when(head == "23205265", "ds9").otherwise("unknown")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, type, size, modified of the files below a folder; only paths and the first 16 bytes of each file are read.

    Files that a task cannot open as such (in a store that only Spark reads) get their type from their name.
    """

    @F.pandas_udf("string")
    def kinds(paths: pd.Series) -> pd.Series:
        def kind(path: str) -> str:
            path = unquote(path.removeprefix("file://").removeprefix("file:"))
            try:
                with open(path, "rb") as f:
                    return kind_of(f.read(16))
            except OSError:
                return _by_name(path, _IMAGES | _TABLES | _REGIONS)

        return paths.map(kind)

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).drop("content")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), kinds(F.col("path")).alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def counts(files: DataFrame) -> DataFrame:
    """type, files, bytes of a listing."""
    return files.groupBy("type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def open_image(spark: SparkSession, path: str) -> DataFrame:
    """An image as a pixel cube, by the reader that suits its type."""
    from .fits import FitsImage

    kind = guess(path)
    if kind not in ("fits", "fits_gz"):
        raise ValueError(f"no reader for {kind} images")
    spark.dataSource.register(FitsImage)
    return spark.read.format("fits_image").load(path)


# Spellings of units and what they become.
UNITS = {"Jy/beam": ("jy/beam", "jypb", "jansky/beam", "jybeam-1", "jy beam-1", "jy/bm"), "Jy": ("jy", "jansky"), "K": ("k", "kelvin"), "km/s": ("km/s", "kms-1", "km s-1", "kmps"), "m/s": ("m/s", "ms-1", "m s-1"), "Hz": ("hz", "hertz"), "GHz": ("ghz",), "MHz": ("mhz",), "deg": ("deg", "degree", "degrees"), "arcsec": ("arcsec", "arcseconds", "asec"), "rad": ("rad", "radian", "radians")}


def normal_unit(unit: str) -> str:
    """A unit in its usual spelling; unknown ones as they are, without outer spaces."""
    text = unit.strip()
    flat = text.lower().replace("**", "").replace("^", "")
    return next((u for u, names in UNITS.items() if flat in names), text)


def cutout_address(base: str, hips: str, width: int, height: int, fov: float, ra: float, dec: float, projection: str = "TAN", frame: str = "icrs", rotation: float = 0.0) -> str:
    """Address of a cut-out of a HiPS survey as FITS."""
    if not hips or width <= 0 or height <= 0 or width * height > 50_000_000:
        raise ValueError("a survey and a size of 1 to 50 million pixels are needed")
    if not 0 < fov <= 360 or not -90 <= dec <= 90 or not 0 <= ra < 360:
        raise ValueError("field of view, right ascension or declination out of range")
    return f"{base}?{urlencode({'hips': hips, 'width': width, 'height': height, 'fov': fov, 'projection': projection, 'coordsys': frame, 'rotation_angle': rotation, 'ra': ra, 'dec': dec, 'format': 'fits'})}"


def increment_unit(degrees: float) -> tuple[float, str]:
    """An angular increment in the unit in which it is read most easily."""
    size = abs(degrees)
    for factor, unit, least in ((1.0, "deg", 1.0), (60.0, "arcmin", 1.0 / 60), (3600.0, "arcsec", 1.0 / 3600)):
        if size >= least:
            return degrees * factor, unit
    return degrees * 3_600_000.0, "mas"


def sexagesimal(degrees: float, hours: bool = False) -> str:
    """d:mm:ss.sss, or h:mm:ss.ssss."""
    value = abs(degrees) / (15 if hours else 1)
    digits = 4 if hours else 3
    total = round(value * 3600, digits)
    h, m = int(total // 3600), int(total % 3600 // 60)
    return f"{'-' if degrees < 0 else '' if hours else '+'}{h:02d}:{m:02d}:{total - h * 3600 - m * 60:0{3 + digits}.{digits}f}"


def sexagesimal_column(degrees: Column, hours: bool = False) -> Column:
    """sexagesimal() of a column, from whole units of the last digit; null and NaN give null."""
    unit = 10_000 if hours else 1000
    total = F.round(F.abs(degrees) / (15 if hours else 1) * 3600 * unit).cast("long")
    sign = F.when(degrees < 0, "-").otherwise("" if hours else "+")
    text = F.format_string(f"%s%02d:%02d:%02d.%0{4 if hours else 3}d", sign, F.floor(total / (3600 * unit)), F.floor(total / (60 * unit)) % 60, F.floor(total / unit) % 60, total % unit)
    return F.when(degrees.isNotNull() & ~F.isnan(degrees), text)
