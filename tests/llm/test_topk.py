"""Exact search by histograms against plain scoring of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from propspark.llm import queries, topk

SF = "/root/testdata/sf0.001"


def plain(rows, k=5, scale=256, every=50):
    good = [(i, key, [math.floor(x * scale) for x in v]) for i, (key, v) in enumerate(rows)
            if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, v in good:
        if key % every:
            continue
        found = sorted((-max(-topk.MOST, min(topk.MOST, sum(map(int.__mul__, v, w)))), other) for j, other, w in good if j != i and len(w) == len(v))
        out += [(key, r, other, -s) for r, (s, other) in enumerate(found[:k], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("size,query_bytes", [(0.5, 1 << 20), (300.0, 60), (1e9, 1 << 20), (1e30, 200)])
def test_against_plain(spark, size, query_bytes):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(240)]
    rows += [(i, [size / 2, size, 0.0, -size]) for i in range(240, 400)]  # one vector that many rows share
    rows += [(i, [float(rng.randint(-1, 1)), 0.0, 0.0, 1.0]) for i in range(400, 500)]
    rows += [(500, [1.0, 2.0]), (550, [2.0, -1.0]), (501, [0.0, 3.0]), (600, []), (650, []), (700, [1.0])]
    rows += [(750, None), (751, [1.0, None, 0.0, 0.0]), (800, [math.nan] * 4), (801, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(50, [0.25, 0.5, 0.0, 0.0]), (50, [0.25, 0.5, 0.0, 0.0]), (-50, [0.0, -0.1, 0.2, 0.0]), (-50, [0.0, -0.1, 0.2, 0.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id bigint, embedding array<double>, rank string, row int").repartition(5)
    got = result(topk.top_products(df, F.col("vec_id") % 50 == 0, query_bytes=query_bytes))
    assert got == plain(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0])], "vec_id int, embedding array<float>")
    asked = F.col("vec_id") % 50 == 0
    assert result(topk.top_products(df, asked)) == [(0, 1, 1, 131072), (0, 2, 2, 65536)]
    assert result(topk.top_products(df.filter("vec_id = 0"), asked)) == []
    assert result(topk.top_products(df.filter("vec_id > 0"), asked)) == []
    assert result(topk.top_products(df.limit(0), asked)) == []
    with pytest.raises(ValueError):
        topk.top_products(df, asked, k=0)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert result(queries.QUERIES["op13_histogram_top_k"](spark, SF)) == plain(rows)
