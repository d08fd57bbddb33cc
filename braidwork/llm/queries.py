"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import chat_formatting, decontamination, embedding_dedup, langid, licenses, lm_scoring, packing, quality, simhash, substring_dedup
from braidwork.session import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def few_files(df: DataFrame) -> DataFrame:
    """A result of a few bytes a document, gathered so that it is not written as a small file for each input split."""
    return df.hint("rebalance")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(langid.identify(table(spark, sf_dir, "documents")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(licenses.recognise(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.format_chats(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_simhash, op3_packing, op4_langid, op5_lm_scoring, op6_quality,
                                 op7_embedding_dedup, op8_licenses, op9_decontamination, op10_chat_formatting)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op7_embedding_dedup": embedding_dedup.ORACLE, "op8_licenses": licenses.oracle(), "op10_chat_formatting": chat_formatting.ORACLE}
