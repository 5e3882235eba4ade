"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of [\x20\x09-\x0D]; everything between them is a word.
SPACE = " \t\n\x0b\x0c\r"
#: A key with more than 1/HEAVY of all rows is heavy, so there are fewer than HEAVY heavy keys.
HEAVY = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; set here only where it is unset (local runs)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "lumencube-checkpoints")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = "4m"


def text_batches(spark: SparkSession) -> None:
    """Arrow batches for rows that hold texts, bounded by bytes instead of Spark's default of 64 MB, which a task holds several times over.

    A setting of the session's own is kept. Results do not depend on it. Longer single rows make a batch of their own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


def text_parts(batches, limit: int = 6_000_000):
    """Lists of (id, text bytes) of about `limit` bytes from Arrow batches of (id, text)."""
    part, size = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = (t.as_py() or "").encode()
            part.append((i, data))
            size += len(data)
            if size >= limit:
                yield part
                part, size = [], 0
    if part:
        yield part


class Scope:
    """Broadcasts and intermediate tables made within a `with` block, to be dropped by release() once nothing reads them.

    A block knows of what its own thread makes, so that sessions and threads never release each other's.
    """

    _local = threading.local()

    def __init__(self):
        self.shared: list = []
        self.tables: list[DataFrame] = []

    @classmethod
    def active(cls) -> list[Scope]:
        """The blocks that this thread is in, the innermost last."""
        if not hasattr(cls._local, "scopes"):
            cls._local.scopes = []
        return cls._local.scopes

    def __enter__(self) -> Scope:
        Scope.active().append(self)
        return self

    def __exit__(self, *_) -> None:
        Scope.active().remove(self)

    def release(self) -> None:
        for b in self.shared:
            b.unpersist()
        for t in self.tables:
            drop_stored(t)
        self.shared, self.tables = [], []


def share(spark: SparkSession, value):
    """A broadcast of a value of bounded size; the scope at hand, if any, can release it."""
    b = spark.sparkContext.broadcast(value)
    for scope in Scope.active()[-1:]:
        scope.shared.append(b)
    return b


def lean(run):
    """A mapInArrow or applyInArrow function (of a group or a cogroup, without the key) after which the worker gives freed memory back to the system.

    Workers are reused and wait idle between stages; without this each of them keeps the most that it has ever used.
    """
    import ctypes
    import inspect

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    if inspect.isgeneratorfunction(run):

        def batches_then_back(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return batches_then_back

    def group_then_back(table):
        try:
            return run(table)
        finally:
            give_back()

    def cogroup_then_back(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return cogroup_then_back if len(inspect.signature(run).parameters) == 2 else group_then_back


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    for scope in Scope.active()[-1:]:
        scope.tables.append(written)
    return written


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/stored/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: Column, n_rows: int, how: str = "inner") -> DataFrame:
    """Join rows to one row per key of `groups` without letting a hot key meet in one task.

    Keys with more than n_rows / HEAVY rows number fewer than HEAVY by counting, so they are broadcast; the others
    go through a shuffled join. `rows` and `groups` are read twice: pass stored or cheap ones.
    """
    cut = max(1000, n_rows // HEAVY)
    heavy = F.broadcast(groups.where(size > cut))
    light = groups.where(size <= cut)
    keys = F.broadcast(groups.where(size > cut).select(key))
    hot = rows.join(heavy, key, "inner")
    cold = rows.join(keys, key, "left_anti").join(light, key, how)
    return hot.unionByName(cold)


def join_dealt(pairs: DataFrame, rows: DataFrame, key: str, other: str, n_pairs: int) -> DataFrame:
    """Join pairs to the one row that `rows` has for their `key`, without letting a hot key's pairs meet in one task.

    The pairs of a key are dealt by the hash of `other` over at most 1024 pieces, and the key's row is copied to those of
    them that have pairs: rows of any size, as they are never broadcast. `pairs` is read twice: pass a stored one.
    """
    pieces = min(1024, max(1, n_pairs // 512))
    dealt = pairs.withColumn("__piece", F.pmod(F.xxhash64(other), F.lit(pieces)))
    copies = dealt.select(key, "__piece").distinct().join(rows, key)
    return dealt.join(copies, [key, "__piece"]).drop("__piece")


def running_total(df: DataFrame, group: list[str], order: list[Column], spread: Column, value: Column, n_rows: int, out: str, rows_each: int = 4096) -> DataFrame:
    """Exclusive running total of `value` within each group, in the order of (spread, *order), without one task per group.

    `spread` is a long in [0, 2**62) that orders the rows and is spread evenly. The rows are dealt to slices of it;
    slice totals are summed over a small table, and the rows of a slice over a window of their own. n_rows: rows in all.
    """
    slices = max(1, min(2**20, n_rows // rows_each))
    df = df.withColumn("__slice", F.floor(spread.cast("double") * (slices / 2.0**62)).cast("long"))
    totals = df.groupBy(*group, "__slice").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__slice").alias("__at"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*group, "__slice").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col("__slice") == F.col("__at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return (
        local.join(offsets, same)
        .withColumn(out, (F.col("__local") + F.col("__offset")).cast("long"))
        .drop("__slice", "__local", "__offset", "__at", *[f"__{g}" for g in group])
    )


#: Bits of a Bloom filter that each key sets, bits per key, and bounds of the size (a filter is sent to every executor).
PROBES, BITS_PER_ROW = 4, 24
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28


class Bloom:
    """A Bloom filter over a key column, made by DataFrame aggregation and tested by a vectorised function.

    at_least=2 keeps only the bits that at least two rows set. The size is bounded by MAX_BITS; over more rows than that
    suits, more rows test true. Whoever uses it must be right whatever rows test true beyond those that must.
    """

    def __init__(self, keys: DataFrame, column: str, n_rows: int, at_least: int = 1):
        self.bits = int(min(MAX_BITS, max(MIN_BITS, 1 << int(np.ceil(np.log2(max(1, n_rows) * BITS_PER_ROW))))))
        bit = keys.select(F.explode(F.array(*self.positions(column))).alias("bit"))
        bit = bit.groupBy("bit").count().where(F.col("count") >= at_least).withColumn("bit", F.col("bit") + 1)  # Spark numbers bitmap bits from 1 on
        packed = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        self.field = np.zeros(self.bits // 8, np.uint8)
        for r in packed.toLocalIterator():  # at most MAX_BITS / 8 bytes in all
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            start = (r["bucket"] - 1) * len(part)
            end = min(start + len(part), len(self.field))
            self.field[start:end] |= part[: end - start]
        self.shared = share(keys.sparkSession, self.field)

    def positions(self, column: str) -> list[Column]:
        return [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(self.bits)).alias(f"__p{i}") for i in range(PROBES)]

    def mark(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows with a boolean column: whether the key may be in the filter. Only the positions go to Python, not the rows."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            field = shared.value
            found = np.ones(len(a), bool)
            for p in (a, b, c, d):
                p = p.to_numpy(np.int64)
                found &= (field[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            return pd.Series(found)

        return rows.withColumn(name, test(*self.positions(column)))


def without_ids(rows: DataFrame, id_col: str, dropped: DataFrame, n_dropped: int) -> DataFrame:
    """The rows whose id is not in dropped(id_col). Only rows that a Bloom filter of the dropped ids marks are shuffled."""
    hit = free_name(rows, "hit")
    marked = Bloom(dropped, id_col, n_dropped).mark(rows, id_col, hit)
    passed = marked.where(~F.col(hit)).drop(hit)
    return passed.unionByName(marked.where(hit).drop(hit).join(dropped.select(id_col), id_col, "left_anti"))
