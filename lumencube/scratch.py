"""The folder that driver and executors share, for intermediate tables and for files that several tasks write or read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_location(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, on any file system that Spark reaches; the machine's temporary folder only where the master is local and none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "lumencube-checkpoints")
    return where.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below it for files that tasks open by path; refused where that is not a mounted file system."""
    where = shared_location(spark)
    scheme, found, path = where.partition(":")
    if found and scheme != "file":
        raise ValueError(f"files that tasks open by path need a mounted folder in spark.checkpoint.dir, not one of {scheme}:")
    path = ("/" + path.lstrip("/")) if found else where
    path = os.path.join(path, f"lumencube-{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, so that a lost executor costs no recomputation."""
    path = f"{shared_location(df.sparkSession)}/stored/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
