"""Shards: near equal, gapless, whole, whatever the skew."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from propspark.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def check(rows, shards, largest):
    """Slots are gapless and the sizes differ by the largest record at most."""
    slots, sizes = defaultdict(list), Counter()
    for shard, slot, size in rows:
        slots[shard].append(slot)
        sizes[shard] += size
    for shard, found in slots.items():
        assert 0 <= shard < shards and sorted(found) == list(range(len(found)))
    total = sum(sizes.values())
    if total:
        assert all(abs(sizes[i] - total / shards) <= largest for i in range(shards))


@pytest.mark.parametrize("ranges, piece_rows", [(256, 2_000_000), (16, 100), (1, 50)])
def test_skewed_keys(spark, ranges, piece_rows):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("key"),
        F.when(F.col("id") % 1000 == 5, 4000).otherwise(F.col("id") % 40 + 1).alias("size"), F.lit("x").alias("piece"))
    out = sharding.range_shards(df, F.col("key"), F.col("size"), 8, [F.col("id")], ranges=ranges, piece_rows=piece_rows)
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(6000)) and out.columns[:4] == df.columns
    check([(r.shard, r.slot, r.size) for r in rows], 8, 4000)
    assert len({r.shard for r in rows if r.key == 7}) > 1  # the hot key is divided


def test_few_null_equal_and_empty(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, 5, None), (None, 5, 0)], "id int, key bigint, size int")
    rows = sharding.range_shards(df, F.col("key"), F.col("size"), 3, [F.col("id")]).collect()
    assert len(rows) == 4
    check([(r.shard, r.slot, r.size or 0) for r in rows], 3, 3)
    zero = sharding.range_shards(spark.range(30).withColumn("size", F.lit(0)), F.xxhash64("id"), F.col("size"), 3).collect()
    assert Counter(r.shard for r in zero) == {0: 10, 1: 10, 2: 10}
    assert sharding.range_shards(df.limit(0), F.col("key"), F.col("size")).count() == 0
    with pytest.raises(ValueError):
        sharding.range_shards(df.withColumn("slot", F.lit(1)), F.col("key"), F.col("size"))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_sampled_splitters"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in docs.items()}
    check([(r.shard, r.slot, r.size) for r in rows], 8, max(r.size for r in rows))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
