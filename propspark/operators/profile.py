"""Column profiles, distributions and correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from propspark.columns import clean_double, numeric_columns, present, to_long
from propspark.functions import moments
from propspark.operators.quantiles import exact_quantiles
from propspark.session import small_table

STATS = ("feature", "count", "mean", "std", "min", "max", "missing", "missing_pct", "skewness", "kurtosis")
BLOCK = 64  # columns of one block of a matrix of pairs
MERGED_AT_ONCE = 64  # parts in which the tasks' moments of a pair of blocks are merged first


def profile_long(long: DataFrame) -> DataFrame:
    """One row of statistics per feature of a long table ``feature, value``."""
    v = F.col("value")
    n = F.count(v).cast("double")
    probs = [0.25, 0.5, 0.75]
    # plain aggregates only: a sketch among them would take all of them out of generated code
    stats = long.groupBy("feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        (F.count(F.lit(1)) - F.count(v)).alias("missing"),
        (F.lit(100.0) * (F.count(F.lit(1)) - F.count(v)) / F.count(F.lit(1))).alias("missing_pct"),
        moments.skewness(v, n).alias("skewness"), moments.kurtosis(v, n).alias("kurtosis"),
    ).collect()
    q = exact_quantiles(long, probs, n={r["feature"]: r["count"] for r in stats})
    none = [None] * len(probs)
    rows = [(*[r[c] for c in STATS], *q.get(r["feature"], none)) for r in stats]
    kinds = {"feature": long.schema["feature"].dataType.simpleString(), "count": "bigint", "missing": "bigint"}
    return small_table(long.sparkSession, rows, **{c: kinds.get(c, "double") for c in (*STATS, "q25", "q50", "q75")})


def feature_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return profile_long(to_long(df, list(columns or numeric_columns(df))))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return feature_stats(df, columns).select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().orderBy(column)


def target_counts(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows with a value, per target."""
    row = df.agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(present(df, t)).alias(f"n{i}") for i, t in enumerate(targets)]).first()
    return df.sparkSession.createDataFrame(
        [(t, row[f"n{i}"], row["total"]) for i, t in enumerate(targets)], "target string, present long, total long")


def target_kind(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """``classification`` when the target has at most ``max_classes`` distinct values, else ``regression``.

    Looks for one value more than that: tasks pass on at most so many, whatever the table holds.
    """
    seen = df.where(F.col(target).isNotNull()).select(target).distinct().limit(max_classes + 1)
    return "classification" if len(seen.collect()) <= max_classes else "regression"


def problem_type(df: DataFrame, target: str, max_classes: int = 10, accuracy: float | None = None) -> tuple[str, int]:
    """``classification`` when the target has few distinct values, and their number.

    With ``accuracy`` (relative standard deviation, at least 0.001) the number of a target with many values is a
    HyperLogLog estimate; the kind is exact either way.
    """
    values = df.where(F.col(target).isNotNull())
    if accuracy is not None and target_kind(df, target, max_classes) == "regression":
        return "regression", values.select(F.approx_count_distinct(target, accuracy)).first()[0]
    distinct = values.select(F.count_distinct(target)).first()[0]
    return ("classification" if distinct <= max_classes else "regression"), distinct


def pick_target(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate that is a column of the table."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins, the last one closed: ``bin, lo, hi, count``; empty bins included."""
    x = clean_double(df, column)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if ends["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    lo, hi = ends["lo"], ends["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    spot = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(spot.alias("bin")).count()
    grid = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("hi"),
    )
    return grid.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))


def box_stats(df: DataFrame, columns: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends, points beyond them, mean and population std per column."""
    long = to_long(df, columns).where("value is not null")
    q = exact_quantiles(long, [0.25, 0.5, 0.75])
    rows = [(k, *v, v[0] - whisker * (v[2] - v[0]), v[2] + whisker * (v[2] - v[0])) for k, v in q.items()]
    fences = small_table(df.sparkSession, rows, feature="string", **dict.fromkeys(("q25", "median", "q75", "lo", "hi"), "double"))
    v = F.col("value")
    kept = v.between(F.col("lo"), F.col("hi"))
    return (
        long.join(F.broadcast(fences), "feature")  # one row per column
        .groupBy("feature", "q25", "median", "q75")
        .agg(F.min(F.when(kept, v)).alias("whisker_lo"), F.max(F.when(kept, v)).alias("whisker_hi"),
             F.count_if(~kept).alias("outliers"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | str):
    """Pearson matrix (NumPy) of complete numeric data, one pass for the Gramian.

    ``columns`` is a list of columns, or the name of one array column.
    """
    values = F.col(columns) if isinstance(columns, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    vec = df.select(array_to_vector(values.cast("array<double>")).alias("v"))
    return Correlation.corr(vec, "v").first()[0].toArray()


def _block_sums(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of all pairs of a left and a right column, over the rows that have both: n, sums, squares and products."""
    a, b = x[:, left], x[:, right]
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    ma, mb = ma.astype(float), mb.astype(float)
    return np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])


def _as_moments(sums: np.ndarray, left_at: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """n, means and centred squares and products of sums taken around the given points."""
    n, sa, sb, qa, qb, pr = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        ra, rb = np.where(n > 0, sa / n, 0.0), np.where(n > 0, sb / n, 0.0)
    return np.stack([n, ra + left_at[:, None], rb + right_at[None, :], qa - sa * ra, qb - sb * rb, pr - sa * rb])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.where(n > 0, b[0] / n, 0.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    both = a[0] * w
    return np.stack([n, a[1] + dx * w, a[2] + dy * w, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])


def pair_correlations(df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """``i, j, r`` of all pairs of a column and a later one (or of a column and one of ``others``), in one pass.

    Rows that lack a value drop out pair by pair; ``r`` is null where it is undefined. Each task sums the products of its
    rows block of columns by block of columns; the blocks' moments meet by block pair, first in parts by task number and then
    the parts, so neither the pairs nor the matrix nor all tasks' moments of a pair pass through one task or the driver.
    """
    columns, others_ = list(columns), list(columns if others is None else others)
    every = list(dict.fromkeys([*columns, *others_]))
    at = {c: i for i, c in enumerate(every)}
    left = [np.array([at[c] for c in columns[i:i + BLOCK]]) for i in range(0, len(columns), BLOCK)]
    right = [np.array([at[c] for c in others_[i:i + BLOCK]]) for i in range(0, len(others_), BLOCK)]
    pairs = [(i, j) for i in range(len(left)) for j in range(len(right)) if others is not None or i <= j]
    wide, triangle = len(every), others is None
    rows = df.select(F.array(*[clean_double(df, c) for c in every]).alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, total = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)
            if around is None:  # a value of the column as origin: sums stay small, and exact for a constant
                seen = np.isfinite(x)
                around = np.where(seen.any(axis=0), x[seen.argmax(axis=0), np.arange(wide)], 0.0)
            for k, (i, j) in enumerate(pairs):
                got = _block_sums(x - around, left[i], right[j])
                total[k] = total[k] + got if k in total else got
        task = TaskContext.get().partitionId()
        for k, got in total.items():
            i, j = pairs[k]
            yield moved(k, task % MERGED_AT_ONCE, _as_moments(got, around[left[i]], around[right[j]]))

    def moved(k: int, part: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["pair", "part", "moments"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Moments of neighbouring rows of one pair and part together."""
        now, held = None, None
        for batch in batches:
            for k, part, data in zip(*(batch.column(c).to_pylist() for c in ("pair", "part", "moments"))):
                m = np.frombuffer(data).reshape(6, len(left[pairs[k][0]]), len(right[pairs[k][1]]))
                if (k, part) == now:
                    held = _merged(held, m)
                    continue
                if held is not None:
                    yield *now, held
                now, held = (k, part), m
        if held is not None:
            yield *now, held

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, m in merged(batches):
            yield moved(k, 0, m)

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(k: int, m: np.ndarray) -> pa.RecordBatch:
            i, j = pairs[k]
            with np.errstate(invalid="ignore", divide="ignore"):
                r = m[5] / np.sqrt(m[3] * m[4])
            a, b = np.meshgrid(np.arange(len(left[i])) + i * BLOCK, np.arange(len(right[j])) + j * BLOCK, indexing="ij")
            keep = (a < b) if triangle else np.ones(a.shape, bool)
            bad = ~((m[3] > 0) & (m[4] > 0) & np.isfinite(r))
            return pa.RecordBatch.from_arrays(
                [pa.array(a[keep], pa.int32()), pa.array(b[keep], pa.int32()), pa.array(np.clip(r[keep], -1, 1), pa.float64(), mask=bad[keep])],
                names=["i", "j", "r"])

        for k, _, m in merged(batches):
            yield result(k, m)

    kind = "pair int, part int, moments binary"
    parts = rows.mapInArrow(sums, kind).repartition("pair", "part").sortWithinPartitions("pair", "part").mapInArrow(first_level, kind)
    return parts.repartition("pair").sortWithinPartitions("pair", "part").mapInArrow(correlate, "i int, j int, r double")


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson matrix with NaN where undefined; rows with gaps drop out pair by pair."""
    m = np.eye(len(columns))
    for r in pair_correlations(df, columns).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = np.nan if r["r"] is None else r["r"]
    return m


def correlation_table(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ("cid",)) -> DataFrame:
    """Strict lower triangle in long form: ``f1, f2, r`` with f1 after f2 in column order; it stays distributed."""
    columns = list(columns or numeric_columns(df, exclude))
    names = F.array(*[F.lit(c) for c in columns])
    return pair_correlations(df, columns).select(
        F.get(names, F.col("j")).alias("f1"), F.get(names, F.col("i")).alias("f2"), "r")


def top_correlated(df: DataFrame, target: str, top_n: int = 30, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlations among the features that follow the target most closely (target included)."""
    columns = list(columns or numeric_columns(df))
    others = [c for c in columns if c != target]
    strength = {target: 1.0}
    for r in pair_correlations(df, others, [target]).where("r is not null").collect():
        strength[others[r["i"]]] = abs(r["r"])
    chosen = sorted(strength, key=lambda c: (-strength[c], c))[:top_n]
    return correlation_table(df, chosen, exclude=())


def dataset_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"), *[F.avg(clean_double(df, c)).alias(f"avg_{c}") for c in columns])
