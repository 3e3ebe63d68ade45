"""The training-data pipeline: stages that each take and return ``documents``; the last returns token digests.

Every stage works on all rows its predecessor kept, is written as Parquet to the shared folder and read back as the
next one's documents. Null texts pass the toxicity stage like any other text and end at the language stage,
which keeps only texts of a learned language. Repeated rows are judged alike up to the third stage, where one row an id
and one of each group of near copies stay. Extra columns pass all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lociary.llm import byte_bpe, edit_match, jaccard_join, language_id, toxicity
from lociary.llm.common import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts are judged like a text without words, so they stay where such a text does."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), and those no learned language describes better than raw bytes, go."""
    return language_id.keep_languages(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays; of rows with one id one; rows without an id stay."""
    return jaccard_join.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or with few edits, go; null and empty texts hold none."""
    return edit_match.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def digest_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row that is left; null and empty texts have no tokens."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.token_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", digest_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = store(docs, f"stage-{number}")
    return docs


#: The stages learn models and match with edits, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None
