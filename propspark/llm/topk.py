"""Exact nearest rows by inner product: global score histograms are refined until each query's k-th score is known.

Scores are whole numbers. A round scores every pair of query and row, counts the scores of each query by bins of the range
that can hold its k-th one, and keeps the bin in which it lies; after a few rounds bins are one number wide. Then all
rows above the k-th score are taken, and of those that have it the ones with the least keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.session import materialize, small_table

BINS = 1024
#: Bytes of the queries that are sent to all tasks at once; more queries take more passes.
QUERY_BYTES = 16 << 20
#: Pairs that a task scores at once, and rows of a chunk.
PAIRS, ROWS = 1 << 22, 1 << 13
#: Scores beyond this are given as this.
MOST = 1 << 61

PREPARED = "row bigint, key bigint, number bigint, dim int, norm double, v array<double>"


def _prepare(df: DataFrame, query: Column, key: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part, with whole numbers for components; queries are numbered within their partition from 0 on."""
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, number = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.floor(pc.fill_null(lists.flatten(), math.nan).to_numpy(zero_copy_only=False) * scale)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(owner, weights=~np.isfinite(flat), minlength=len(sizes)) == 0
            flat, owner = flat[good[owner]], owner[good[owner]]
            norm = np.sqrt(np.bincount(owner, weights=flat * flat, minlength=len(sizes))[good])
            asked = batch.column("q").to_numpy(zero_copy_only=False)[good].astype(bool)
            numbers = number + np.cumsum(asked) - 1
            dims, n = sizes[good], int(good.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + row + np.arange(n)), batch.column("key").filter(pa.array(good)), pa.array(numbers, mask=~asked),
                 pa.array(dims.astype(np.int32)), pa.array(norm), pa.ListArray.from_arrays(np.append(0, np.cumsum(dims)).astype(np.int32), flat)],
                names=["row", "key", "number", "dim", "norm", "v"])
            row, number = row + n, number + int(asked.sum())

    given = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(query, F.lit(False)).alias("q"),
                      F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return materialize(given.filter("key IS NOT NULL AND v IS NOT NULL").mapInArrow(whole, PREPARED), "vectors")


class Queries(NamedTuple):
    """Queries of one pass in order of their length; ``rows`` are ids of their own rows and ``bound`` limits every score."""

    rows: np.ndarray
    keys: np.ndarray
    dims: np.ndarray
    flat: np.ndarray
    bound: int


def _collected(table: pa.Table, bound: int) -> Queries:
    dims = table.column("dim").to_numpy()
    order = np.argsort(dims, kind="stable")
    table = table.take(pa.array(order))
    flat = table.column("v").combine_chunks().flatten().to_numpy()
    return Queries(table.column("row").to_numpy(), table.column("key").to_numpy(), dims[order], flat, bound)


def _product(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """Exact scores of two matrices of whole numbers as longs."""
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(q).astype(object) @ whole(c).astype(object).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _scored(asked: Queries, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All scores in blocks: places of the queries, keys of the rows, scores; a query's own row has the least long."""
    own_order = np.argsort(asked.rows)
    own_rows = asked.rows[own_order]
    starts = np.append(0, np.cumsum(asked.dims.astype(np.int64)))
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            some = batch.slice(first, ROWS)
            dims, rows, keys = (some.column(n).to_numpy() for n in ("dim", "row", "key"))
            lists = some.column("v")
            flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(dims.astype(np.int64)))
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                matrix = flat[(at[here][:, None] + np.arange(dim)).ravel()].reshape(len(here), dim)
                lo, hi = np.searchsorted(asked.dims, [dim, dim + 1])
                step = max(1, PAIRS // len(here))
                found = np.minimum(np.searchsorted(own_rows, rows[here]), len(own_rows) - 1)
                mine = np.flatnonzero(own_rows[found] == rows[here])
                place = own_order[found[mine]]
                for a in range(int(lo), int(hi), step):
                    b = min(a + step, int(hi))
                    scores = _product(asked.flat[starts[a]:starts[b]].reshape(b - a, dim), matrix, asked.bound)
                    inside = (place >= a) & (place < b)
                    scores[place[inside] - a, mine[inside]] = np.iinfo(np.int64).min
                    yield np.arange(a, b), keys[here], scores


def _histograms(vectors: DataFrame, asked: Broadcast, state: Broadcast) -> DataFrame:
    """How many scores of each query fall in each bin of its range, from the top until a task's rows fill the place asked for."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, need, width, wide = state.value
        for q, _, scores in _scored(asked.value, batches):
            at, j = np.nonzero(scores >= low[q][:, None])
            code = (scores[at, j] - low[q][at]) // width
            inside = code < -(-wide // width)
            counts = np.bincount(at[inside] * BINS + code[inside], minlength=len(q) * BINS).reshape(len(q), BINS)[:, ::-1]
            before = np.cumsum(counts, axis=1) - counts
            # scores below a task's own k-th one cannot be the k-th of all
            i, place = np.nonzero((counts > 0) & (before < need[q][:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[i]), pa.array((BINS - 1 - place).astype(np.int64)), pa.array(counts[i, place].astype(np.int64)), pa.array(need[q[i]])],
                names=["q", "bin", "n", "need"])

    counts = vectors.select("row", "key", "dim", "v").mapInArrow(count, "q bigint, bin bigint, n bigint, need bigint")
    counts = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("above", above).filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))) \
        .select("q", "bin", "above")


def _taken(vectors: DataFrame, asked: Broadcast, state: Broadcast, k: int) -> DataFrame:
    """Rows above the k-th score, and of those that have it the ones with the least keys of each task's rows."""
    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, need = state.value
        for q, keys, scores in _scored(asked.value, batches):
            at, j = np.nonzero(scores >= low[q][:, None])
            score, key = scores[at, j], keys[j]
            own = score == np.iinfo(np.int64).min
            at, score, key = at[~own], score[~own], key[~own]
            tie = score == low[q][at]
            order = np.lexsort((key, at))[tie[np.lexsort((key, at))]]
            first = np.searchsorted(at[order], at[order])
            keep = np.concatenate([np.flatnonzero(~tie), order[np.arange(len(order)) - first < need[q][at[order]]]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[at[keep]]), pa.array(asked.value.keys[q[at[keep]]]), pa.array(key[keep]), pa.array(score[keep])],
                names=["q", "query_id", "vec_id", "score"])

    rows = vectors.select("row", "key", "dim", "v").mapInArrow(take, "q bigint, query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(df: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
                 query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` rows of the highest inner products for every row of ``df`` that is a ``query``; columns ``query_id``, ``rank``
    (from 1), ``vec_id``, ``score``.

    Components become ``floor(scale * x)``. Candidates are all rows but the query's own, fewer than ``k`` if there are no more;
    ties go to the smaller key. Rows whose key or vector is null, or whose vector holds a null or a number that is not
    finite, take no part; vectors of different length are not compared (empty ones score 0 with each other). Rows of
    one key are different rows: each is a query and a candidate for the others. Scores beyond 2^61 in size are given as
    2^61. Other columns of ``df`` are not read; an empty table gives an empty result.

    Every round reads the rows where they are stored and shuffles at most ``k`` bins for each query and chunk of rows;
    neither vectors nor scores move. Queries are sent to the tasks in passes of ``query_bytes``, so what is broadcast and
    what comes back to the driver (one bin for each query of the pass) has a fixed bound. Chunks send at most ``k``
    tied rows for a query, so a vector that many rows share costs no more than another.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = df.sparkSession
    vectors = _prepare(df, query, key, vector, scale)
    part = F.shiftright("row", 40)
    asked = vectors.filter("number IS NOT NULL")
    stats = vectors.agg(F.max("norm").alias("all"), F.max(F.when(F.col("number").isNotNull(), F.col("norm"))).alias("asked"),
                        F.max("dim").alias("dim")).first()
    numbers = sorted(asked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not numbers:
        return empty
    product = stats["all"] * stats["asked"]
    bound = int(min(product * (1 + 1e-9) + 1, MOST)) if math.isfinite(product) else MOST
    at_once = max(1, query_bytes // (8 * max(1, stats["dim"])))
    base, rows = 0, []
    for p, n in numbers:
        rows.append((p, base))
        base += n
    bases = F.broadcast(small_table(spark, rows, part="bigint", base="bigint"))
    asked = asked.withColumn("part", part).join(bases, "part").withColumn("pass", F.floor((F.col("base") + F.col("number")) / at_once))
    if base > at_once:
        asked = materialize(asked, "queries")
    out = []
    for i in range(-(-base // at_once)):
        some = _collected(asked.filter(F.col("pass") == i).select("row", "key", "dim", "v").toArrow(), bound)
        shared = spark.sparkContext.broadcast(some)
        low, need = np.full(len(some.rows), -bound, np.int64), np.full(len(some.rows), k, np.int64)
        wide = 2 * bound + 1
        while wide > 1:
            width = -(-wide // BINS)
            state = spark.sparkContext.broadcast((low, need, width, wide))
            found = _histograms(vectors, shared, state).toArrow()
            q = found.column("q").to_numpy()
            few = np.ones(len(low), bool)
            few[q] = False
            low, need = low.copy(), need.copy()
            low[q] += found.column("bin").to_numpy() * width
            need[q] -= found.column("above").to_numpy()
            # fewer candidates than places: the lowest score there can be takes all
            low[few] = -bound
            wide = width
            state.unpersist()
        state = spark.sparkContext.broadcast((low, need))
        out.append(materialize(_taken(vectors, shared, state, k), "nearest"))
        shared.unpersist()
        state.unpersist()
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


#: The same search as SQL.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS at, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.at AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.at <> c.at AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
