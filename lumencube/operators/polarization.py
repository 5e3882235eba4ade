"""Polarization: the planes of one position side by side, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NAN, divide

CODES = {"I": 0, "Q": 1, "U": 2, "V": 3}


COMPUTED = ("Ptotal", "Plinear", "PFtotal", "PFlinear", "Pangle")


def parse_coordinate(text: str) -> tuple[str, str]:
    """(stokes, axis) of a profile request such as "x", "Qz" or "Ptotalz"; no stokes: the current one (empty)."""
    stokes, axis = text[:-1], text[-1:]
    if axis not in ("x", "y", "z") or stokes not in ("", *CODES, *COMPUTED):
        raise ValueError(f"unknown profile {text}")
    return stokes, axis


def fits_code(code: int) -> int:
    """FITS codes -1..-8 and 5..12 of circular and linear products, into each other."""
    return 4 - code


def side_by_side(cube: DataFrame, at: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """i, q, u, v of each position (NaN where missing), by one aggregate instead of joins."""
    plane = lambda s: F.max(F.when(F.col("stokes") == s, F.col("v").cast("double")))
    return cube.groupBy(*at).agg(*[F.coalesce(plane(s), F.lit(NAN)).alias(n.lower()) for n, s in CODES.items()])


def computed(wide: DataFrame) -> DataFrame:
    """ptotal, plinear, pftotal, pflinear (percent of I) and pangle (degrees) from i, q, u, v."""
    i, q, u, v = (F.col(c) for c in "iquv")
    linear, total = F.sqrt(q * q + u * u), F.sqrt(q * q + u * u + v * v)
    return wide.withColumns({"ptotal": total, "plinear": linear, "pftotal": divide(total * 100, i), "pflinear": divide(linear * 100, i), "pangle": F.degrees(F.atan2(u, q)) / 2})


def debiased(q: Column, u: Column, q_error: float, u_error: float) -> Column:
    """Linear polarization less the errors' part, NaN where that is negative."""
    r = q * q + u * u - (q_error * q_error + u_error * u_error) / 2
    return F.when(F.isnan(r) | (r < 0), F.lit(NAN)).otherwise(F.sqrt(F.abs(r)))


def above(value: Column, i: Column, threshold: float) -> Column:
    """The value, or NaN where I is NaN or below the threshold."""
    return F.when(F.isnan(i) | (i < threshold), F.lit(NAN)).otherwise(value)


def vector_field(cube: DataFrame, mip: int, threshold: float, q_error: float = 0.0, u_error: float = 0.0, fractional: bool = False) -> DataFrame:
    """Polarization intensity and angle of block means: (z, y, x, pi, pa)."""
    from .resample import block_mean

    wide = side_by_side(block_mean(cube, mip, "stokes", "z"))
    i, q, u = F.col("i"), F.col("q"), F.col("u")
    size = debiased(q, u, q_error, u_error)
    if fractional:
        size = divide(size, i) * 100
    return wide.select("z", "y", "x", above(size, i, threshold).alias("pi"), above(F.degrees(F.atan2(u, q)) / 2, i, threshold).alias("pa"))


def concatenated(planes: dict[str, DataFrame]) -> DataFrame:
    """One cube from the images of at least two different polarizations of one grid."""
    if len(planes) < 2 or not set(planes) <= set(CODES):
        raise ValueError("at least two of I, Q, U and V are needed")
    shapes = {tuple(p.agg(F.max("x"), F.max("y"), F.max("z")).first()) for p in planes.values()}
    if len(shapes) != 1:
        raise ValueError("images of different shapes cannot be joined")
    parts = [planes[s].withColumn("stokes", F.lit(CODES[s])) for s in CODES if s in planes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
