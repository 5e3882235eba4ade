"""Places of rows in an order over the whole table, without a task that holds the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored

#: Rows that a task sorts, about.
SORTED = 250_000


def numbered(df: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """df with the place (0, 1, 2 ...) of every row in the order of some columns, nulls first; other columns break ties.

    Ranges of about SORTED rows are sorted and stored with their places in the range; a range's first place is the sum of
    the ranges before it, a window over a row for each range. Columns must be ones that Spark can sort.
    """
    columns = [*order, *(c for c in df.columns if c not in order)]
    ranges = max(1, -(-df.count() // SORTED))
    # partitions of a range partitioning are numbered in its order; the id has the partition above 33 bits for the row
    ranged = df.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns).withColumn("__place", F.monotonically_increasing_id())
    placed = stored(ranged, "numbered").withColumn("__range", F.shiftright("__place", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__rows"))
    bases = sizes.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(bases), "__range").withColumn(out, F.col("__base") + within).drop("__range", "__place", "__base")
