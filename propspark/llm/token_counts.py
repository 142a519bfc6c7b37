"""Token counts behind a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from propspark.llm.text import content, digest, free_shuffles, slices, whole

CACHE = "hi bigint, lo bigint, tokenizer string, n_bytes bigint, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: another version has other counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@functools.lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def fill_cache(df: DataFrame, cache: str, tokenizer: str, text: str = "text") -> None:
    """Encode the distinct contents that the cache lacks and append their counts.

    Each content is encoded once, whatever its number of copies: copies meet as equal digests, first inside each input
    partition and then across them. Rows already stored for this tokenizer are not encoded.
    """
    spark, version = df.sparkSession, tokenizer_digest(tokenizer)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("hi", "lo")
    held = whole(df, text).select(content(F.col(text)).alias("text"))
    held = held.select("text", digest(F.col("text")).alias("d")).select("text", "d.hi", "d.lo")
    misses = held.join(known, ["hi", "lo"], "left_anti").groupBy("hi", "lo").agg(F.first("text").alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("hi"), part.column("lo"), pa.array([version] * part.num_rows, pa.string()),
                     pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()),
                     pa.array(count(texts.to_pylist()), pa.int64())],
                    names=["hi", "lo", "tokenizer", "n_bytes", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    free_shuffles(spark)


def count_tokens(df: DataFrame, cache: str, tokenizer: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row of ``df``.

    ``tokenizer`` is a file all machines have: ``.model`` for sentencepiece, ``.json`` for tokenizers. Content is
    normalised only where no tokenizer can see it: null and empty text are one content with no bytes. No begin,
    end or added special tokens; strings of special tokens inside a text are handled as the library does by default.
    Empty tables give empty results; repeated rows all stay. Columns called like the new ones are an error.
    """
    clash = {"n_bytes", "n_tokens", "over_limit"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    fill_cache(df, cache, tokenizer, text)
    stored = read_cache(df.sparkSession, cache).filter(F.col("tokenizer") == tokenizer_digest(tokenizer))
    stored = stored.groupBy("hi", "lo").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))
    keyed = df.withColumn("__count_key", digest(content(F.col(f"`{text}`"))))
    joined = keyed.join(stored, (F.col("__count_key.hi") == stored.hi) & (F.col("__count_key.lo") == stored.lo), "left")
    return joined.select(*[keyed[f"`{c}`"] for c in df.columns], "n_bytes", "n_tokens",
                         (F.col("n_tokens") > limit).alias("over_limit"))
