"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, html_extract, near_dedup, packing, quality, sharding, sql, substring_dedup, token_count, toxicity
from .common import read_table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(read_table(spark, sf_dir, "documents"), near_dedup.Rule(words=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, spans, n_removed): every document without its repeated passages; n_removed counts bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return substring_dedup.strip(docs, spans="spans").withColumn("n_removed", removed)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also stores the map's first version, in a folder of its own, from which a later run can go on."""
    maps = sharding.map_folder(spark, f"op9-slot-maps-{uuid.uuid4().hex}")
    return sharding.shards(read_table(spark, sf_dir, "documents"), maps=maps)[0]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_codec, op2_toxicity, op3_near_dedup, op4_quality_rules, op5_html_extract, op6_token_count, op7_exact_dedup, op8_substring_dedup, op9_sharding, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": sql.OP3, "op4_quality_rules": sql.op4(), "op7_exact_dedup": sql.OP7, "op9_sharding": sql.OP9}
