"""Arithmetic over images of one grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["stokes", "z", "y", "x"]


def evaluate(expression: str, images: dict[str, DataFrame]) -> DataFrame:
    """A cube whose values are a SQL expression of the images' names; pixels that not all images have are left out."""
    parts = [df.select(*KEYS, F.col("v").cast("double").alias(name)) for name, df in images.items()]
    return reduce(lambda a, b: a.join(b, KEYS), parts).select(*KEYS, F.expr(expression).alias("v"))
