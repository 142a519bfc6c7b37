"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
import public_tokenizers
from propspark.llm import alignment, bpe, decontamination, line_dedup, pii, prefix_trie, quality, sharding, similarity_join, suffix_dedup
from propspark.llm import token_counts, token_files, topk
from propspark.llm.registry import ORACLE, QUERIES, documents, query
from propspark.llm.text import content
from propspark.session import materialize, new_path

__all__ = ["ORACLE", "QUERIES"]


@query("op3_sampled_splitters")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of near equal bytes; equal texts are neighbours in the order that is cut."""
    text = content(F.col("text"))
    narrow = materialize(documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash")), "sizes")
    out = sharding.range_shards(narrow, F.col("text_hash"), F.col("size"), 8, tie=[F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op7_digest_cache")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, behind a cache that this call starts empty."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, new_path(spark, "counts"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.drop("text")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to flat files and read back from them."""
    manifest = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest)


@query("op10_suffix_automaton", decontamination.FIND_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_line_rules", quality.MEASURE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.measure(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "clean_text")


@query("op6_line_winnowing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines of every document, and what is left without them."""
    cut = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed_lines", "runs", F.octet_length("clean_text").alias("kept_bytes"),
                      F.sha2(content(F.col("clean_text")), 256).alias("kept_sha256"))


@query("op9_bayesian_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return similarity_join.similar_documents(documents(spark, sf_dir)).drop("hi", "lo")


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by ranked merges and decoded again."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"])


@query("op2_two_stage_suffixes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 400 bytes that occur twice."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return pii.replace_entities(documents(spark, sf_dir).select("doc_id", "text"), key="corpus-v1")


@query("op11_pointer_jumping")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' ids of every document, aligned on their bytes."""
    return alignment.align_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def trie_of(turns: DataFrame) -> DataFrame:
    """The trie of conversations that take their first turns (0 to 8, by their id) from the first of each five."""
    c = F.col("conv_id")
    heads = F.crc32(c.cast("string")) % 9
    shared = prefix_trie.share_heads(prefix_trie.turn_sequences(turns), c - c % 5, heads, most=8)
    return prefix_trie.prefix_trie(shared)


@query("op12_sparse_table_trie", prefix_trie.TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of all conversations."""
    return trie_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op13_histogram_top_k", topk.TOP_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    return topk.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
