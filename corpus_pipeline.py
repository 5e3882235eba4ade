"""A corpus pipeline of five stages over `documents`; counted as part of lumencube.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencube.llm.common import Scope, drop_stored, stored, table
from lumencube.llm.exact_dedup import drop_duplicates
from lumencube.llm.jaccard import drop_near_duplicates
from lumencube.llm.mixing import mixed_documents
from lumencube.llm.quality import keep_quality
from lumencube.llm.queries import tokenizer_path
from lumencube.llm.sentencepiece_bpe import encode_documents

#: Rows that the classifier gives a lower probability of good quality go.
THRESHOLD = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; null and empty texts are scored as others are, repeats alike."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those whose texts are equal without white space: the longest, of these the one of smallest id."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at 0.75: that of smallest id. Texts without words stay."""
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its schedule; texts without words are no part of it, others may come up to three times."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_text and decoded of every row of the mix; rows that the mix repeats come out repeated."""
    return encode_documents(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained classifier nor the merges of the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read as the next one's documents.

    What a stage stored and broadcast on its way goes when its result is written, and so does the input that it has read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scope() as made:
            result = stage(spark, docs, sf_dir)
        docs = stored(result, f"pipeline-{name}")
        made.release()
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
