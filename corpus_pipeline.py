"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and, but for the last, returns the
columns of documents with its decisions in effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from propspark.llm import bpe, decontamination, line_dedup, quality, similarity_join
from propspark.session import materialize

#: What the stages do together has no SQL form (keyed near-duplicate classes, token ids); the tests run a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that fail the counts or lose too much (operator 8)."""
    return quality.clean(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents of nothing else (operator 6)."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays (operator 9)."""
    return similarity_join.one_of_each(docs)


def benchmark_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that are mostly such (operator 10)."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token ids, checked by decoding them again (operator 5)."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    keep = [c for c in docs.columns if c != "text"]
    return bpe.encode_documents(docs, vocabulary, with_ids=True, keep=keep)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_words),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = materialize(docs, name.split()[0])
    return docs
