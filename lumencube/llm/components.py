"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges(a, b): the smallest node that can be reached from it.

    Every round a node takes the smallest label around it and then the label of its label, so that paths shorten by
    halves. Rounds are cut by stored tables; labels never leave the executors.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        of = labels.select(F.col("node").alias("root"), F.col("label").alias("above"))
        moved = least.join(of, F.col("next") == F.col("root")).select("node", F.col("label").alias("old"), F.least("next", "above").alias("label"))
        moved = stored(moved, "labels")
        done = moved.where("label < old").limit(1).count() == 0
        drop_stored(labels)
        labels = moved.select("node", "label")
        if done:
            drop_stored(both)
            return labels


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after more edges: these connect components, so only the table of components is worked on."""
    if labels is None:
        return components(edges)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    lifted = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    roots = components(lifted.where("a <> b")).select(F.col("node").alias("root"), F.col("label").alias("above"))
    known = labels.join(roots, F.col("label") == F.col("root"), "left").select("node", F.coalesce("above", "label").alias("label"))
    fresh = roots.join(labels, F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("above").alias("label"))
    return stored(known.unionByName(fresh), "labels")
