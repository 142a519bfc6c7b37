"""Metrics over a table with true and predicted columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

REGRESSION_METRICS = ("mse", "rmse", "mae", "r2", "mape")
CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1_score")


def _regression_columns(y: str, pred: str) -> dict[str, Column]:
    err = F.col(y).cast("double") - F.col(pred).cast("double")
    sst = F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))
    sse = F.sum(err * err)
    return {
        "mse": F.avg(err * err), "rmse": F.sqrt(F.avg(err * err)), "mae": F.avg(F.abs(err)),
        # a constant target: 1 when predicted perfectly, else 0
        "r2": F.when(sst > 0, F.lit(1.0) - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0)),
        "mape": F.avg(F.abs(err / (F.abs(F.col(y).cast("double")) + F.lit(1e-10)))) * 100,
    }


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2 and mape in one aggregate (per group of ``by``)."""
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in _regression_columns(y, pred).items()])


def confusion_counts(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).cast("double").alias("actual"), F.col(pred).cast("double").alias("predicted")).count()


def classification_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; division by zero gives 0."""
    cells = confusion_counts(df, y, pred, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("count").alias("support"), F.lit(0).cast("long").alias("called"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("count").alias("called"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select(*by, "s.*")
    per = sides.groupBy(*by, "label").agg(F.sum("support").alias("n"), F.sum("called").alias("c"), F.sum("tp").alias("tp"))
    p = F.when(F.col("c") > 0, F.col("tp") / F.col("c")).otherwise(0.0)
    r = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    per = per.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    n = F.sum("n")
    return per.withColumn("f", f1).groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("p") * F.col("n")) / n).alias("precision"),
        (F.sum(F.col("r") * F.col("n")) / n).alias("recall"),
        (F.sum(F.col("f") * F.col("n")) / n).alias("f1_score"),
    )


def evaluate(df: DataFrame, y: str, pred: str, problem: str, by: Sequence[str] = ()) -> DataFrame:
    if problem == "regression":
        return regression_metrics(df, y, pred, by)
    if problem == "classification":
        return classification_metrics(df, y, pred, by)
    raise ValueError(f"unknown problem type: {problem}")


def confusion_matrix(df: DataFrame, y: str, pred: str, max_labels: int = 1000) -> DataFrame:
    """All cells over the union of true and predicted labels, empty ones as 0, plus ``accuracy``.

    The table is labels x labels; a column with more than ``max_labels`` values is not a class and an error.
    """
    cells = confusion_counts(df, y, pred)
    values = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    labels = sorted(r["label"] for r in values.limit(max_labels + 1).collect())
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} labels: {y} and {pred} are not classes")
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "actual double, predicted double")
    full = grid.join(cells, ["actual", "predicted"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # one row per label pair
    everything = Window.orderBy("actual", "predicted").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).over(everything)
    return full.withColumn("accuracy", hits / F.sum("count").over(everything))


def residual_table(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(pred))


def value_range(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Common axis range and r2/rmse of the actual-versus-predicted view."""
    m = _regression_columns(y, pred)
    return df.agg(F.least(F.min(y), F.min(pred)).alias("lo"), F.greatest(F.max(y), F.max(pred)).alias("hi"),
                  m["r2"].alias("r2"), m["rmse"].alias("rmse"))


def comparison_grid(metrics: DataFrame, names: Sequence[str], rows: Sequence[str] = ("model_type",)) -> DataFrame:
    """Models by metrics; a missing metric shows as 0."""
    return metrics.groupBy(*rows).pivot("metric", list(names)).agg(F.first("value")).fillna(0.0)


def learning_curve_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of ``score`` per training size and split."""
    return scores.groupBy("train_size", "split").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n"))

