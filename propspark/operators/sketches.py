"""Quantile (KLL) and distinct-count (HyperLogLog) sketches of columns as a table that can be stored and merged.

A state has one short row for each column. States of parts of a table add up to a state of the whole table, so new data
costs one scan of the new data. Sketches choose some of what they keep by chance: answers differ a little from run to run,
within the error that was asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from propspark.columns import to_long

SCHEMA = "feature string, quantiles binary, distinct binary, n bigint, missing bigint"
#: Bits of the number of registers: a relative standard error of 1.04 / sqrt(2 ** 12), 1.6 per cent.
REGISTER_BITS = 12


def kll_size(accuracy: float) -> int:
    """The size of a KLL sketch whose rank error is at most ``accuracy`` (a share of all values) for 99 of 100 questions."""
    if not 1e-4 <= accuracy <= 0.3:
        raise ValueError("accuracy is between 0.0001 and 0.3")
    # rank error of the published sketch, by its size
    return min(65535, max(8, math.ceil((2.296 / accuracy) ** (1 / 0.9021))))


def build(df: DataFrame, columns: Sequence[str], accuracy: float = 0.005) -> DataFrame:
    """State of the numeric columns of a table; null and NaN are missing. One scan, one short row from each task and column."""
    size = kll_size(accuracy)
    return to_long(df, columns).groupBy("feature").agg(
        F.kll_sketch_agg_double("value", size).alias("quantiles"), F.hll_sketch_agg(F.hash("value"), REGISTER_BITS).alias("distinct"),
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))


def merge(*states: DataFrame) -> DataFrame:
    """State of all rows behind the given states."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy("feature").agg(
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
        F.sum("n").alias("n"), F.sum("missing").alias("missing"))


def quantile_table(state: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``feature, q``: array of approximate quantiles, null for a column without values."""
    q = F.kll_sketch_get_quantile_double("quantiles", F.lit([float(p) for p in probs]))
    return state.select("feature", F.when(F.col("n") > 0, q).alias("q"))


def quantiles(state: DataFrame, probs: Sequence[float]) -> dict[str, list[float | None]]:
    return {r.feature: list(r.q) if r.q is not None else [None] * len(probs) for r in quantile_table(state, probs).collect()}


def distinct_counts(state: DataFrame) -> DataFrame:
    """``feature, distinct, n, missing``: estimated distinct values and exact counts."""
    return state.select("feature", F.hll_sketch_estimate("distinct").alias("distinct"), "n", "missing")
