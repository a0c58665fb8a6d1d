"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, divergence, embedding_dedup, exact_dedup, importance, jaccard_join, language_id, line_dedup, mixing, packing, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file() -> str:
    """The default of the tokenizer's path; any file of the same library does."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_perspectives(_read(spark, sf_dir, "conversations"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.line_dedup(_read(spark, sf_dir, "documents"), least=10, least_chars=1)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents")).drop("source", "copies")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_read(spark, sf_dir, "embeddings"), least=0.9)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = importance.importance_resampling(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed="42")
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_read(spark, sf_dir, "documents"), least_docs=3, smoothing=1, top=200)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.decontamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), gram=5, span=10)
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Query]:
    found = (
        op1_jaccard_join,
        op2_chat_perspectives,
        op3_best_fit_packing,
        op4_toxicity,
        op5_line_dedup,
        op6_url_filter,
        op7_language_id,
        op8_exact_dedup,
        op9_mixing,
        op10_embedding_dedup,
        op11_importance_resampling,
        op12_source_divergence,
        op13_decontamination,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
