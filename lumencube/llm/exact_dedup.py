"""Exact duplicates by two-pass Bloom filtering.

Pass 1 sets, for every text's hash, a few bits of a filter and keeps those bits that at least two rows have set.
Pass 2 tests each row against the kept bits: a row with a bit that no other row set has no equal and passes straight
through; the others, real repeats and a few false alarms, are shuffled by hash and grouped exactly.

The filter is broadcast, so its size is bounded (common.MAX_BITS). Over more rows than that suits, more rows are
shuffled; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, free_name, join_groups, stored

WHITE = r"[\x20\x09-\x0D]+"


def digest(text):
    """SHA-256 of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""), 256))


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __sha (its digest) and __points (code points)."""
    return docs.withColumns({"__sha": digest(F.col(text_col)), "__points": F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")})


def _best():
    """Sorts first: most code points, then the smallest id (a null id last)."""
    return F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when identical after all white space is deleted; null counts as empty, so empty and null
    texts form one group. Of a group, the row with the most code points stays, ties go to the smallest id (a null id
    last). Of rows repeated with that id and length, one is marked kept. Whole texts count, however long; other columns
    are ignored. An empty table gives an empty result.
    """
    n = docs.count()
    slim = with_digest(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    digests = stored(slim.select("__id", "__sha", "__points"), "digests")
    marked = Bloom(digests, "__sha", n, at_least=2).mark(digests, "__sha", "__again")
    single = marked.where("not __again").select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__sha")
    again = stored(marked.where("__again").groupBy("__id", "__sha", "__points").agg(F.count("*").alias("__rows")), "again")
    groups = again.groupBy("__sha").agg(F.min(_best()).alias("__best"), F.sum("__rows").alias("group_size"), F.count("*").alias("__members"))
    kept = F.col("__id").eqNullSafe(F.col("__best.i")) & (F.col("__points") == -F.col("__best.p")) & (F.col("__row") == 1)
    every = join_groups(again, groups, "__sha", F.col("__members"), n).withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), "__rows")))
    repeats = every.select("__id", F.col("__best.i").alias("keep_id"), "group_size", kept.alias("kept"), "__sha")
    return single.unionByName(repeats).select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called: exactly one per group, as duplicate_groups marks them.

    Rows without an equal are passed on where they were read; only possible repeats move, combined before the shuffle.
    Null counts as empty, so of null and empty texts one row stays. An empty table gives an empty result.
    """
    n = docs.count()
    sha, again = free_name(docs, "sha"), free_name(docs, "again")
    digests = with_digest(docs.select(F.col(text_col).alias("__text")), "__text").select("__sha")
    marked = Bloom(digests, "__sha", n, at_least=2).mark(docs.withColumn(sha, digest(F.col(text_col))), sha, again)
    single = marked.where(~F.col(again)).select(docs.columns)
    points = F.length(F.coalesce(F.col(text_col), F.lit("")))
    order = F.struct((-points).alias("p"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"))
    repeats = marked.where(again).groupBy(sha).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return single.unionByName(repeats)
