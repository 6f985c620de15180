"""One query for each corpus operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op01_secrets,
    op02_substring_dedup,
    op03_topk,
    op04_mixing,
    op05_bpe,
    op06_toxicity,
    op07_chat,
    op08_exact_dedup,
    op09_pii,
    op11_hard_negatives,
    op12_whitening,
    op13_token_records,
)
from . import op10_near_dedup as near


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_secrets.scan(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_topk.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_mixing.mixture(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op05_bpe.encoded_documents(_table(spark, sf_dir, "documents"), vocabulary())
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op06_toxicity.toxicity(docs, op06_toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_chat.all_conversations(_table(spark, sf_dir, "conversations"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op09_pii.personal_data(docs, op09_pii.fit(docs))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(_table(spark, sf_dir, "documents"))


def op11_hard_negatives_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op12_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return op12_whitening.whitened(rows, op12_whitening.fit(rows))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_token_records.written_and_read(_table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_substring_dedup, op3_topk, op4_mixing, op5_bpe, op6_toxicity, op7_chat, op8_exact_dedup, op9_pii, op10_near_dedup, op11_hard_negatives_mined, op12_whitened, op13_token_files)
}

ORACLE: dict[str, str] = {
    "op1_secrets": op01_secrets.SQL,
    "op2_substring_dedup": op02_substring_dedup.SQL,
    "op3_topk": op03_topk.SQL,
    "op4_mixing": op04_mixing.SQL,
    "op7_chat": op07_chat.SQL,
    "op8_exact_dedup": op08_exact_dedup.SQL,
    "op11_hard_negatives_mined": op11_hard_negatives.SQL,
}
