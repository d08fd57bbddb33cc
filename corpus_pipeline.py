"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and its result is written as Parquet before the next one reads it.

Null and empty texts have no language and go with the first stage, and so do
columns other than those of documents.  Rows without doc_id pass the stages,
are never near copies or repeats of others, and are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import decontamination, langid, packing, simhash_similarity, substring_dedup
from braidwork.llm.queries import tokenizer_path
from braidwork.llm.scratch import cut
from braidwork.session import ship_package, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; lang becomes the prediction."""
    ship_package(spark)
    return langid.relabel_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: of each group of texts linked by a five-word similarity of 0.8 or more the document with the smallest doc_id stays."""
    ship_package(spark)
    return simhash_similarity.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences that start earlier in the corpus are taken out of the texts."""
    ship_package(spark)
    return substring_dedup.rewrite_documents(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Learned models, fingerprints and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
