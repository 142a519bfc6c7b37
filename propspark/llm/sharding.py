"""Shards of near equal size by sampled splitters (built-in functions only)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.session import materialize

TWO_32 = 4294967296.0


def _step(key: Column, splitters: Sequence[int], low: int = 0) -> Column:
    """Number of splitters up to ``key``, as a balanced tree of comparisons."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    return F.when(key < F.lit(splitters[mid]), _step(key, splitters[:mid], low)).otherwise(
        _step(key, splitters[mid + 1:], low + mid + 1))


def _pick(values: Sequence[int], index: Column) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])[index]


def range_shards(df: DataFrame, key: Column, size: Column, shards: int = 8, tie: Sequence[Column] = (), ranges: int = 256,
                 oversample: int = 32, piece_rows: int = 2_000_000, seed: int = 42) -> DataFrame:
    """Add ``shard`` and ``slot``: records range-partitioned by ``key`` into shards of near equal total size.

    About ``ranges * oversample`` keys are drawn, each record with a chance in proportion to its size, and their
    quantiles become the splitters of the ranges. Ranges that hold more than their share (or more than ``piece_rows``
    records) are subdivided by a hash of key and ``tie`` columns, so a key that holds a third of all rows is divided
    too. Running sums inside the pieces and the pieces' prefix sums give every record its place in the whole order;
    the shard is where the middle of the record falls. ``slot`` counts from 0 without gaps inside each shard.

    Only the sample, the totals of the ranges and of the shards come to the driver: their number does not depend on the
    number of records. ``key`` is a bigint spread over its whole range (a hash), null counts as the smallest. ``size``
    null or negative counts as 0; if all sizes are 0 the shards are filled by rows. Repeated rows each keep a
    place of their own; which of two equal rows gets which slot is not defined. An empty table gives an empty result.
    """
    own = {"shard", "slot"} & set(df.columns)
    if own:
        raise ValueError(f"columns already there: {sorted(own)}")
    if shards < 1:
        raise ValueError("shards must be positive")
    k, s, h, r, p = (f"__shard_{x}" for x in ("key", "size", "hash", "range", "piece"))
    base = df.withColumns({
        k: F.coalesce(key.cast("bigint"), F.lit(-2**63)),
        s: F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)),
    })
    base = base.withColumn(h, F.xxhash64(F.lit(seed), F.col(k), *tie))
    total, rows = base.agg(F.coalesce(F.sum(s), F.lit(0)), F.count(F.lit(1))).first()
    if not total:  # nothing to weigh: every record counts alike
        base, total = base.withColumn(s, F.lit(1).cast("bigint")), rows

    # draws in proportion to size: whole draws plus one with the chance of the rest
    uniform = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(h)), F.lit(2**32)) / F.lit(TWO_32)
    draws = F.floor(F.col(s) * F.lit(ranges * oversample / max(total, 1)) + uniform)
    sample = base.select(F.col(k), draws.alias("draws")).filter("draws > 0").groupBy(k).agg(F.sum("draws")).collect()
    splitters, passed, cut = [], 0, max(1, sum(n for _, n in sample) / ranges)
    for value, n in sorted((a, int(b)) for a, b in sample):
        if passed >= cut * (len(splitters) + 1) and len(splitters) < ranges - 1:
            splitters.append(value)
        passed += n

    ranged = base.withColumn(r, _step(F.col(k), splitters))
    totals = {x[0]: (x[1], x[2]) for x in ranged.groupBy(r).agg(F.sum(s), F.count(F.lit(1))).collect()}
    sizes = [totals.get(i, (0, 0)) for i in range(len(splitters) + 1)]
    share = max(1, total // ranges)
    parts = [max(1, -(-size // (2 * share)), -(-n // piece_rows)) for size, n in sizes]
    pieced = ranged.withColumn(p, F.pmod(F.col(h), _pick(parts, F.col(r))).cast("int"))

    piece_sum = Window.partitionBy(r).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    before = pieced.groupBy(r, p).agg(F.sum(s).alias("size"), F.count(F.lit(1)).alias("rows")).select(
        r, p, F.coalesce(F.sum("size").over(piece_sum), F.lit(0)).alias("__shard_size0"),
        F.coalesce(F.sum("rows").over(piece_sum), F.lit(0)).alias("__shard_rows0"))
    inside = Window.partitionBy(r, p).orderBy(k, h)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    range_size = [0, *accumulate(x for x, _ in sizes)][:-1]
    range_rows = [0, *accumulate(n for _, n in sizes)][:-1]
    placed = pieced.withColumns({
        "__shard_run": F.sum(s).over(up_to), "__shard_no": F.row_number().over(inside)}).join(before, [r, p])
    middle = (_pick(range_size, F.col(r)) + F.col("__shard_size0") + F.col("__shard_run")) * 2 - F.col(s)
    share_of = middle.cast("decimal(38,0)") * F.lit(shards) / F.lit(2 * max(total, 1)).cast("decimal(38,0)")
    placed = placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.least(F.floor(share_of).cast("int"), F.lit(shards - 1)).alias("shard"),
        (_pick(range_rows, F.col(r)) + F.col("__shard_rows0") + F.col("__shard_no") - 1).alias("__shard_place"))
    placed = materialize(placed, "shards")
    first = dict(placed.groupBy("shard").agg(F.min("__shard_place")).collect())
    start = _pick([first.get(i, 0) for i in range(shards)], F.col("shard"))
    return placed.withColumn("slot", F.col("__shard_place") - start).drop("__shard_place")
