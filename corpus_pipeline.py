"""The corpus pipeline: quality rules, exact dedup, near-dedup, substring dedup, packing.

Every stage works on all that the one before it kept, returns the columns of `documents` (the last one: packed pieces), and
is written as Parquet and read again before the next one starts. A document that repeats another in its whole text or
nearly so goes; of repeated passages the copies go and their documents stay. SQL cannot express the distance tables, the
chunking and the packing, so there is no ORACLE_SQL; the tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from heddle.llm.common import read_table, scope, stage, unstage

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    out = substring_dedup.strip(docs, spans=spans)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return out.drop(spans)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("near dedup", near),
    ("substring dedup", substrings),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        with scope():  # what the stage staged on its way
            read, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{k}", keep=True)
        unstage(read)
    return docs
