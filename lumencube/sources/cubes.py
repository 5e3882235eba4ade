"""Pixel cubes made from relational tables.

The canonical cube is a DataFrame (stokes int, z int, y int, x int, v float); NaN marks a pixel without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(df: DataFrame, x: Column, y: Column, v: Column, z: Column | None = None, stokes: Column | None = None) -> DataFrame:
    """Canonical columns from expressions."""
    zero = F.lit(0)
    return df.select((zero if stokes is None else stokes).cast("int").alias("stokes"), (zero if z is None else z).cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), v.cast("float").alias("v"))


def complete(cube: DataFrame, width: int, height: int, depth: int = 1, stokes: int = 1) -> DataFrame:
    """Every pixel of the grid, NaN where the cube has none. The grid is generated in parallel and joined once."""
    n = width * height * depth * stokes
    i = F.col("id")
    grid = cube.sparkSession.range(n).select(
        F.floor(i / (width * height * depth)).cast("int").alias("stokes"),
        (F.floor(i / (width * height)) % depth).cast("int").alias("z"),
        (F.floor(i / width) % height).cast("int").alias("y"),
        (i % width).cast("int").alias("x"),
    )
    return grid.join(cube, ["stokes", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(float("nan")).cast("float")))


def image_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D image: x is the position in the vector, y the vector's id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return pixels(e, F.col("x"), F.col("vec_id"), F.col("v"))


LI = (32, 32, 7)
EV = (24, 30, 5, 4)


def cube_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-D cube, 32 x 32 x 7: summed quantities by part, supplier and line number."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), (F.col("l_linenumber") - 1).alias("z")).agg(F.sum("l_quantity").alias("v"))
    return complete(pixels(t, F.col("x"), F.col("y"), F.col("v"), F.col("z")), *LI)


def cube_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-D cube, 24 x 30 x 5 x 4: summed values by hour, day and user; I holds all events, Q, U and V one type each."""
    cents = F.round(F.col("value") * 100).cast("long")
    kind = F.col("event_type")
    planes = F.array(F.lit(0), F.when(kind == "click", 1).when(kind == "purchase", 2).when(kind == "view", 3))
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y"), (F.col("user_id") % 5).alias("z"), cents.alias("c"), F.explode(planes).alias("s")).where("s is not null")
    t = e.groupBy("x", "y", "z", "s").agg(F.sum("c").alias("c"))
    return complete(pixels(t, F.col("x"), F.col("y"), F.col("c") / 100.0, F.col("z"), F.col("s")), *EV)
