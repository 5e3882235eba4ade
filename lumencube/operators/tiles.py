"""Neighbourhood work on images of any size: tiles with an apron, one shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels along the side of a tile.
SIDE = 512


def by_tiles(image: DataFrame, apron: int, work: Callable[[np.ndarray, dict], np.ndarray], *by: str, side: int = SIDE) -> DataFrame:
    """(by, y, x, v double) of every pixel of the image, v as `work` gives it for the pixel's place.

    Every tile, with the pixels up to `apron` places around it, goes to one task; pixels near a border are copied to the
    tiles on its other side, others are not. work takes an array (NaN where there is no value) and the tile's values of `by`,
    and returns one of the same shape; it may look `apron` places around a pixel. Tiles grow with the apron, so that copies
    stay a few for each pixel.
    """
    side = max(side, 2 * apron)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - apron) / side), F.floor((F.col(c) + apron) / side)))
    copies = image.select(*by, "y", "x", "v").withColumn("tx", near("x")).withColumn("ty", near("y"))
    copies = copies.withColumns({"tx": F.col("tx").cast("int"), "ty": F.col("ty").cast("int")})

    def run(t: pa.Table) -> pa.Table:
        tx, ty = t.column("tx")[0].as_py(), t.column("ty")[0].as_py()
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        mine = (x // side == tx) & (y // side == ty)
        got = np.zeros(0)
        if mine.any():
            x0, y0 = int(x.min()), int(y.min())
            data = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
            data[y - y0, x - x0] = t.column("v").to_numpy()
            got = work(data, {c: t.column(c)[0].as_py() for c in by})[y[mine] - y0, x[mine] - x0]
        kept = t.filter(pa.array(mine)).select([*by, "y", "x"])
        return kept.append_column("v", pa.array(got, pa.float64()))

    kinds = dict(image.dtypes)
    return copies.groupBy(*by, "tx", "ty").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "y", "x")) + ", v double")
