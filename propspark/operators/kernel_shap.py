"""Shapley values of any model by weighted least squares over feature coalitions.

A coalition takes some features from the row and the others from a background row; its worth is the mean prediction over the
background. Worths are fitted by a linear function of membership, weighted by the Shapley kernel and held to the
worths of the empty and the full coalition. All rows share the coalitions, so the normal equations are solved once, into a
matrix that turns a row's worths into its values; rows need nothing but sums of predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from propspark.errors import DataError
from propspark.operators.learning import ModelBundle, feature_array
from propspark.session import small_table

#: Parts of the background whose separate estimates give the standard error.
BATCHES = 10


def coalitions(features: int, samples: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Members (0 or 1) and kernel weights of at most ``samples`` coalitions, neither empty nor full.

    If all fit, all are taken with their exact weights. Otherwise sizes are taken whole from the outermost on (each with
    its complements) as long as they fit, and the rest is drawn with complements from the other sizes, whose weight it shares.
    """
    p = features
    size_weight = np.array([0.0] + [(p - 1) / (s * (p - s)) for s in range(1, p)] + [0.0])
    rows, weights, left = [], [], samples
    open_sizes = list(range(1, p // 2 + 1))
    while open_sizes:
        s = open_sizes[0]
        sizes = {s, p - s}
        count = sum(comb(p, k) for k in sizes)
        if count > left:
            break
        for k in sorted(sizes):
            for members in combinations(range(p), k):
                rows.append(np.isin(np.arange(p), members).astype(float))
                weights.append(size_weight[k] / comb(p, k))
        left -= count
        open_sizes.pop(0)
    if open_sizes and left >= 2:
        rng = np.random.default_rng(seed)
        share = np.array([size_weight[s] + (size_weight[p - s] if p - s != s else 0.0) for s in open_sizes])
        drawn: dict[tuple, int] = {}
        tries = 0
        while len(drawn) + 2 <= left and tries < 20 * samples:
            tries += 1
            s = open_sizes[rng.choice(len(open_sizes), p=share / share.sum())]
            members = np.zeros(p)
            members[rng.permutation(p)[:s]] = 1.0
            for row in (members, 1 - members):
                drawn[tuple(row)] = drawn.get(tuple(row), 0) + 1
        total = sum(drawn.values())
        rows += [np.array(r) for r in drawn]
        weights += [share.sum() * n / total for n in drawn.values()]
    return np.array(rows).reshape(-1, p), np.array(weights)


def solver(members: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix from the worths (empty, full, then each coalition) to the values.

    The last feature is what the others leave of the difference between full and empty, so the values always add up.
    """
    n, p = members.shape
    if p == 1:
        return np.array([[-1.0, 1.0]])
    last = members[:, -1]
    design = members[:, :-1] - last[:, None]
    normal = design.T @ (weights[:, None] * design)
    # worth - empty - last * (full - empty), as a function of all worths
    target = np.hstack([(last - 1)[:, None], -last[:, None], np.eye(n)])
    head = np.linalg.lstsq(normal, design.T @ (weights[:, None] * target), rcond=None)[0]
    ends = np.zeros(n + 2)
    ends[:2] = -1.0, 1.0
    return np.vstack([head, ends - head.sum(axis=0)])


def output_of(bundle: ModelBundle, label: int | None) -> Column:
    """What is explained: the prediction, or the probability of class ``label`` of a classifier."""
    if bundle.problem_type == "classification":
        return F.get(vector_to_array("probability"), F.lit(1 if label is None else label))
    return F.col("prediction")


def kernel_shap(df: DataFrame, key: str, bundle: ModelBundle, background: DataFrame, background_key: str, background_rows: int = 100,
                samples: int = 100, seed: int = 42, label: int | None = None) -> DataFrame:
    """``key, feature, shap, error`` for every row: the kernel estimate and its standard error.

    The background is ``background_rows`` rows chosen by key hash. ``samples`` bounds the number of coalitions; with all of
    them (up to ``2^p - 2``) only the background is a sample. The error is that of the mean over the background, from ten
    parts of it (null if there are fewer rows than two parts). Values add up to the prediction minus the mean
    background prediction; classifiers are explained by the probability of ``label``.

    Keys must be unique. A row becomes at most ``background_rows * coalitions + 1`` predictions (one for background rows
    that agree in all features outside a coalition), which are summed where they are made; a short row for each coalition and
    key is all that is shuffled.
    """
    names = list(bundle.feature_names)
    p = len(names)
    spark = df.sparkSession
    marks = background.select(F.md5(F.concat(F.col(background_key).cast("string"), F.lit(f"#{seed}"))).alias("_h"), feature_array(background, names).alias("z"))
    zs = [list(r["z"]) for r in marks.orderBy("_h").limit(background_rows).collect()]
    if not zs:
        raise DataError("background rows are required")
    members, weights = coalitions(p, samples, seed)
    every = np.vstack([np.zeros(p), np.ones(p), members])
    solve = solver(members, weights)
    few = min(BATCHES, len(zs))
    # the empty coalition is the same for all rows; of the others, background rows that agree outside it count as one
    mixes: list[tuple[int, list, list]] = []
    for s in range(1, len(every)):
        counts: dict[tuple, list[float]] = {}
        for b, z in enumerate(zs):
            rest = tuple(None if m else v for m, v in zip(every[s], z))
            counts.setdefault(rest, [0.0] * few)[b % BATCHES] += 1.0
        mixes += [(s, list(rest), w) for rest, w in counts.items()]
    bank = small_table(spark, [(i, *m) for i, m in enumerate(mixes)], _m="int", _s="int", z="array<double>", w="array<double>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    none = small_table(spark, list(enumerate(zs)), _b="int", v="array<double>")
    rows = df.select(F.col(key).alias("_k"), feature_array(df, names).alias("x")).repartition(parts, F.xxhash64("_k", "x"))
    # a short table (coalitions times background rows at most), matched by number
    rows = rows.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(len(mixes) - 1)))).join(F.broadcast(bank), "_m")
    mixed = rows.select("_k", "_s", "w", F.zip_with("z", "x", lambda z, v: F.coalesce(z, v)).alias("v"))

    def predicted(mixed: DataFrame) -> DataFrame:
        if bundle.scaler is not None:
            centers = F.lit([float(bundle.scaler.center.get(n, 0.0)) for n in names])
            scales = F.lit([float(bundle.scaler.scale.get(n, 1.0)) for n in names])
            mixed = mixed.withColumn("v", F.transform("v", lambda v, j: (v - F.get(centers, j)) / F.get(scales, j)))
        return bundle.model.transform(mixed.withColumn("features", array_to_vector("v"))).withColumn("y", output_of(bundle, label))

    empty = np.zeros(few)
    for r in predicted(none).select("_b", "y").collect():
        empty[r._b % BATCHES] += r.y
    sums = [F.sum(F.get("w", F.lit(i)) * F.col("y")) for i in range(few)]
    # the full coalition has one prediction a row, so it also counts the rows
    worth = predicted(mixed).groupBy("_k", "_s").agg(F.array(*sums).alias("sums"), F.count(F.lit(1)).alias("n"))
    sorted_worths = F.array_sort(F.collect_list(F.struct("_s", "sums")))
    per_row = worth.groupBy("_k").agg(F.flatten(F.transform(sorted_worths, lambda c: c["sums"])).alias("worths"), F.max(F.when(F.col("_s") == 1, F.col("n"))).alias("n"))
    sizes = np.bincount(np.arange(len(zs)) % BATCHES, minlength=few)
    enough = len(zs) >= 2 * BATCHES

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            told = batch.column("worths").flatten().to_numpy(zero_copy_only=False).reshape(n, len(every) - 1, few)
            rows = batch.column("n").to_numpy(zero_copy_only=False)
            sums = np.concatenate([(rows[:, None] * empty)[:, None, :], told], axis=1)
            phi = sums.sum(axis=2) / len(zs) @ solve.T
            ends = np.arange(n + 1, dtype=np.int32) * p
            out = [batch.column("_k"), pa.ListArray.from_arrays(ends, phi.ravel())]
            if enough:
                error = np.matmul(solve, sums / sizes).std(axis=2, ddof=1) / np.sqrt(BATCHES)
                out.append(pa.ListArray.from_arrays(ends, error.ravel()))
            else:
                out.append(pa.array([[None] * p] * n, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=["_k", "phi", "error"])

    kind = df.schema[key].dataType.simpleString()
    values = per_row.mapInArrow(solved, f"_k {kind}, phi array<double>, error array<double>")
    cell = F.inline(F.arrays_zip(F.lit(names).alias("feature"), F.col("phi").alias("shap"), F.col("error").alias("error")))
    return values.select(F.col("_k").alias(key), cell)
