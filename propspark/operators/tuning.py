"""Grid search over tree ensembles in which tree counts cost no fits of their own.

Points that differ only in the number of trees share one fit with the largest: the first trees of a forest are a forest and
the first rounds of boosting a boosted model. All points of a fold are scored in one pass over its held-out rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propspark.operators.tree_shap import TREE_MODELS
from propspark.session import new_path

#: Spark parameters that hold the number of trees.
COUNTS = ("numTrees", "maxIter")
#: Fits that run side by side.
AT_ONCE = 4


def tree_prefix(spark: SparkSession, model, n: int):
    """The model of the first ``n`` trees of a forest or boosted model, by way of its saved form."""
    if isinstance(model, OneVsRestModel):
        out = model.copy()
        out.models = [tree_prefix(spark, m, n) for m in model.models]
        return out
    if not isinstance(model, TREE_MODELS):
        raise TypeError(f"not a tree ensemble: {type(model).__name__}")
    if not 0 < n <= len(model.treeWeights):
        raise ValueError(f"the model has {len(model.treeWeights)} trees")
    if n == len(model.treeWeights):
        return model
    whole, part = new_path(spark, "trees"), new_path(spark, "prefix")
    model.write().save(whole)
    spark.read.parquet(f"{whole}/data").filter(F.col("treeID") < n).write.parquet(f"{part}/data")
    spark.read.parquet(f"{whole}/treesMetadata").filter(F.col("_1") < n).write.parquet(f"{part}/treesMetadata")
    meta = json.loads(spark.read.text(f"{whole}/metadata").first()["value"])
    meta["numTrees"] = n
    meta["paramMap"].update({k: n for k in COUNTS if k in meta["paramMap"]})
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{part}/metadata")
    return type(model).load(part)


def shared_fits(points: Sequence[dict]) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """Fits for a list of Spark parameter maps: the parameters, and the points each serves with their number of trees."""
    groups: dict[str, tuple[dict, list]] = {}
    for i, point in enumerate(points):
        count = next((k for k in COUNTS if k in point), None)
        rest = {k: v for k, v in point.items() if k != count}
        params, served = groups.setdefault(json.dumps([count, rest], sort_keys=True), (dict(point), []))
        served.append((i, None if count is None else int(point[count])))
        if count is not None:
            params[count] = max(params[count], point[count])
    return list(groups.values())


def _scored(df: DataFrame, models: dict[int, object]) -> DataFrame:
    """``label`` and for every point its prediction, in the order of ``models``."""
    for i, m in models.items():
        before = df.columns
        df = m.transform(df).select(*before, F.col("prediction").alias(f"_p{i}"))
    return df.select("label", *[f"_p{i}" for i in models])


def point_scores(scored: DataFrame, points: Sequence[int], kind: str) -> dict[int, float | None]:
    """R2 (regression) or the class-weighted F1 of every point in one pass; null where it is not defined."""
    cells = scored.select("label", F.inline(F.array(*[F.struct(F.lit(i).alias("point"), F.col(f"_p{i}").alias("p")) for i in points])))
    if kind == "regression":
        left = F.sum((F.col("label") - F.col("p")) ** 2)
        spread: Column = F.var_pop("label") * F.count(F.lit(1))
        rows = cells.groupBy("point").agg((1 - left / F.nullif(spread, F.lit(0.0))).alias("score")).collect()
        return {r.point: r.score for r in rows}
    counts: dict[int, dict[tuple[float, float], int]] = {}
    for r in cells.groupBy("point", "label", "p").count().collect():  # at most classes squared rows for each point
        counts.setdefault(r.point, {})[r.label, r.p] = r["count"]
    out: dict[int, float | None] = {}
    for i, table in counts.items():
        total = sum(table.values())
        score = 0.0
        for c in {label for label, _ in table}:
            support = sum(n for (label, _), n in table.items() if label == c)
            named = sum(n for (_, p), n in table.items() if p == c)
            hits = table.get((c, c), 0)
            score += support / total * (2 * hits / (support + named) if support + named else 0.0)
        out[i] = score
    return out


def grid_scores(table: DataFrame, points: Sequence[dict], fit: Callable[[DataFrame, dict], object], kind: str, folds: int) -> list[float | None]:
    """Mean score of every point over the folds of ``table`` (``label``, ``features``, ``fold``).

    ``fit`` fits one parameter map on a table. Every fold fits each group of points once and scores all points in one pass.
    Folds of few groups are worked on together, so that ``AT_ONCE`` fits run side by side.
    """
    spark, groups = table.sparkSession, shared_fits(points)
    totals: list[list[float]] = [[] for _ in points]
    together = max(1, AT_ONCE // max(len(groups), 1))
    with ThreadPool(AT_ONCE) as pool:
        for first in range(0, folds, together):
            part = range(first, min(folds, first + together))
            jobs = [(table.where(F.col("fold") != fold), params) for fold in part for params, _ in groups]
            fitted = pool.map(inheritable_thread_target(spark)(lambda job: fit(*job)), jobs)

            def score(j: int) -> dict[int, float | None]:
                held, models = table.where(F.col("fold") == part[j]), {}
                for model, (_, served) in zip(fitted[j * len(groups):], groups):
                    for i, n in served:
                        models[i] = model if n is None else tree_prefix(spark, model, n)
                ordered = dict(sorted(models.items()))
                return point_scores(_scored(held.select("label", "features"), ordered), list(ordered), kind)

            for scores in pool.map(inheritable_thread_target(spark)(score), range(len(part))):
                for i, value in scores.items():
                    if value is not None:
                        totals[i].append(value)
    return [sum(t) / len(t) if t else None for t in totals]
