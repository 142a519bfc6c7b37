"""Sorting, top-k and preference choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def sort_importance(table: DataFrame, score: str = "importance") -> DataFrame:
    return table.orderBy(F.desc(score), "feature")


def top_features(table: DataFrame, n: int = 20, score: str = "importance") -> DataFrame:
    return sort_importance(table, score).limit(n)


def top_per_row(long: DataFrame, key: str, n: int = 20, value: str = "shap") -> DataFrame:
    """The ``n`` largest contributions by absolute value per row key, with ``rank``."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs(value)), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def head(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_model(metrics: DataFrame, metric: str, by: Sequence[str] = ("target",)) -> DataFrame:
    """Model with the largest metric per target; the first name wins on ties."""
    rows = metrics.where((F.col("metric") == metric) & F.col("value").isNotNull())
    best = F.min(F.struct((-F.col("value")).alias("neg"), F.col("model_type"))).alias("b")
    return rows.groupBy(*by).agg(best).select(
        *by, F.col("b.model_type").alias("model_type"), (-F.col("b.neg")).alias("value"))


def preferred_model(catalogue: DataFrame) -> DataFrame:
    """One saved model per target: xgboost, then gradient boosting, then any other."""
    order = (F.when(F.col("model_type") == "xgboost", 0)
             .when(F.col("model_type") == "gradient_boosting", 1).otherwise(2))
    w = Window.partitionBy("target").orderBy(order, "model_type")
    return catalogue.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def contribution_share(table: DataFrame, score: str = "mean_shap", numerator_n: int = 10,
                       denominator_n: int = 20) -> DataFrame:
    """Share of the top features in the sum of the listed ones, in percent.

    ``table`` has one row per feature. The sum runs over the top
    ``denominator_n`` features, not over all.
    """
    listed = top_features(table, denominator_n, score)
    w = Window.orderBy(F.desc(score), "feature")
    ranked = listed.withColumn("rank", F.row_number().over(w))
    part = F.sum(F.when(F.col("rank") <= numerator_n, F.col(score)))
    whole = F.sum(score)
    return ranked.agg(
        F.count(F.lit(1)).alias("listed"), part.alias("top_sum"), whole.alias("listed_sum"),
        F.when(whole != 0, F.lit(100.0) * part / whole).alias("share_pct"),
        F.min_by("feature", "rank").alias("most_important"),
    )


def components_for_variance(variances: DataFrame, ratio: float = 0.95) -> DataFrame:
    """Cumulative explained variance over ``component, variance`` and the smallest
    number of components that reaches ``ratio``. One row per component, so the
    ordered window is as small as the feature count."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = variances.select("component", (F.sum("variance").over(w) / F.sum("variance").over(everything)).alias("cumulative"))
    return cum.agg(
        F.coalesce(F.min(F.when(F.col("cumulative") >= ratio, F.col("component"))), F.max("component")).alias("k"),
        F.count(F.lit(1)).alias("p"),
    )
