"""Text as flat byte arrays, and word hashes computed on them without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters between words, as a Java and Python class.
BLANK = r"[\x20\x09-\x0D]"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def content(text: Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """128 bits of a text as two longs, made from two independently seeded 64-bit hashes of its SHA-256."""
    sha = F.sha2(text, 256)
    return F.struct(
        F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint").alias("hi"),
        F.conv(F.substring(sha, 16, 15), 16, 10).cast("bigint").alias("lo"))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that have ended; it does so when the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array in one piece and the offsets of its rows (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` text bytes (one row at least)."""
    _, at = utf8(batch.column(name))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one-to-one."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):
        x = x * (2 - a * x) % 2**64
    return x


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each maximal run of word bytes; no run crosses a row.

    ``is_word`` says for each byte value whether it belongs to a word.
    """
    inside = np.concatenate([[False], is_word[raw], [False]])
    change = inside[1:] != inside[:-1]
    cuts = offsets[1:-1]
    # a row border inside a run ends one word and begins another
    split = cuts[(cuts > 0) & (cuts < len(raw))]
    split = np.unique(split[inside[split] & inside[split + 1]])
    edge = np.flatnonzero(change)
    if len(split):
        edge = np.sort(np.concatenate([edge, split, split]))
    first, end = edge[0::2], edge[1::2]
    return first, end, np.searchsorted(offsets, first, side="right") - 1


def word_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, from running sums of byte * odd ** position."""
    if not len(first):
        return np.empty(0, np.uint64)
    n = len(raw)
    power, back = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return mix((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))


_tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd base and of its inverse."""
    global _tables
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_ODD, np.uint64(_inverse(int(_ODD)))):
            power = np.full(size, base, np.uint64)
            power[0] = 1
            made.append(np.multiply.accumulate(power))
        _tables = (made[0], made[1])
    return _tables[0][:n], _tables[1][:n]


def whole(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, as they are; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])
