"""Feature selection: fit on a table, apply the stored result to any other."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, PCAModel, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, MatrixUDT, VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from propspark.columns import WIDE_AGG_LIMIT, clean_double, to_long
from propspark.errors import DataError
from propspark.functions import moments
from propspark.operators.profile import pair_correlations
from propspark.operators.quantiles import edges_upto, exact_quantiles, literal_edges, with_edges
from propspark.operators.split_scale import Scaler, fit_scaler
from propspark.session import materialize, new_path

METHODS = ("variance", "correlation", "mutual_info", "f_statistic", "rfe", "pca", "combined")
NEEDS_TARGET = ("mutual_info", "f_statistic", "rfe")


def variances(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Population variance per feature, one job."""
    if len(features) <= WIDE_AGG_LIMIT:
        row = df.agg(*[F.var_pop(clean_double(df, c)).alias(f"v{i}") for i, c in enumerate(features)]).first()
        return {c: row[f"v{i}"] for i, c in enumerate(features)}
    got = to_long(df, features).groupBy("feature").agg(F.var_pop("value").alias("v")).collect()
    return {r["feature"]: r["v"] for r in got}


def keep_varying(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> list[str]:
    v = variances(df, features)
    return [c for c in features if v[c] is not None and v[c] > threshold]


def keep_uncorrelated(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Drop a column when any earlier one (kept or not) correlates above the threshold."""
    if not features:
        return []
    # judged where the pairs are: a number for each dropped column is all that comes back; an undefined value is not above
    above = pair_correlations(df, features).where(F.abs("r") > threshold).select("j").distinct().collect()
    dropped = {r["j"] for r in above}
    return [c for j, c in enumerate(features) if j not in dropped]


def bin_edges(long: DataFrame, bins: int, binning: str) -> dict[str, list[float]]:
    """Ascending inner bin edges per feature."""
    if binning == "width":
        ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        return {r["feature"]: [r["lo"] + i * (r["hi"] - r["lo"]) / bins for i in range(1, bins)]
                for r in ends if r["lo"] is not None}
    if binning == "quantile":
        q = exact_quantiles(long, [i / bins for i in range(1, bins)])
        return {k: sorted(v) for k, v in q.items()}
    raise ValueError(f"unknown binning: {binning}")


def binned(long: DataFrame, edges: dict[str, list[float]], carry: Sequence[str]) -> DataFrame:
    """Bin number per value: how many edges lie at or below it."""
    rows, cols = with_edges(long.where("value is not null"), edges)
    return rows.select("feature", *carry, edges_upto(F.col("value"), cols).alias("bx"))


def _target_bin(df: DataFrame, target: str, problem: str, bins: int, binning: str) -> Column:
    if problem == "classification":
        return F.col(target).cast("double")
    edges = bin_edges(to_long(df, [target]), bins, binning)[target]
    return edges_upto(clean_double(df, target), literal_edges(edges)).cast("double")


def mutual_information(df: DataFrame, features: Sequence[str], target: str, problem: str = "regression",
                       bins: int = 10, binning: str = "quantile") -> DataFrame:
    """Plug-in mutual information (nats) of binned features with the target: ``feature, score``.

    All features share one shuffle of (feature, bin, target bin) counts.
    """
    df = df.where(F.col(target).isNotNull())
    with_bin = df.withColumn("_by", _target_bin(df, target, problem, bins, binning))
    long = to_long(with_bin, features, ["_by"])
    joint = binned(long, bin_edges(long, bins, binning), ["_by"]).groupBy("feature", "bx", "_by").count()
    # the joint table has at most bins x target bins rows per feature
    n = F.sum("count").over(Window.partitionBy("feature"))
    nx = F.sum("count").over(Window.partitionBy("feature", "bx"))
    ny = F.sum("count").over(Window.partitionBy("feature", "_by"))
    parts = joint.select("feature", (F.col("count") / n * F.log(F.col("count") * n / (nx * ny))).alias("part"))
    return parts.groupBy("feature").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("score"))


def f_statistic(df: DataFrame, features: Sequence[str], target: str, problem: str = "regression") -> DataFrame:
    """F value per feature: squared-correlation form for regression, one-way ANOVA for classes."""
    long = to_long(df.where(F.col(target).isNotNull()), features, [target]).where("value is not null")
    if problem == "regression":
        y = F.col(target).cast("double")
        r = long.groupBy("feature").agg(moments.correlation(F.col("value"), y).alias("r"), F.count(F.lit(1)).alias("n"))
        r2 = F.col("r") * F.col("r")
        return r.select("feature", F.when(r2 < 1, r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
                        .when(r2 >= 1, float("inf")).alias("score"))
    per = long.groupBy("feature", target).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    # `per` has one row per feature and class
    w = Window.partitionBy("feature")
    centred = F.col("m") - F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    sums = per.withColumn("d", centred).groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("d") * F.col("d")).alias("between"))
    k, n = F.col("k"), F.col("n")
    return sums.select("feature", F.when(
        (k > 1) & (n > k) & (F.col("within") > 0),
        (F.col("between") / (k - 1)) / (F.col("within") / (n - k))).alias("score"))


def _top_in_order(scores: dict[str, float], features: Sequence[str], k: int) -> list[str]:
    """The k best features in their original column order; earlier columns win ties."""
    def rank(c: str) -> float:
        s = scores.get(c)
        return -math.inf if s is None or s != s else s

    best = set(sorted(features, key=lambda c: -rank(c))[:k])
    return [c for c in features if c in best]


def recursive_elimination(df: DataFrame, features: Sequence[str], target: str, n_features: int,
                          problem: str = "regression", trees: int = 50, step: float = 0.1, max_depth: int = 5,
                          seed: int = 42) -> tuple[list[str], list[tuple[str, int, float]]]:
    """Drop the least important features round by round, ``step`` of the original count each.

    Returns the kept features and ``(feature, round dropped or 0, forest importance)``.
    """
    make = RandomForestClassifier if problem == "classification" else RandomForestRegressor
    estimator = make(numTrees=trees, maxDepth=max_depth, seed=seed, labelCol="label", featuresCol="part")
    table = materialize(df.select(
        F.col(target).cast("double").alias("label"),
        array_to_vector(F.array(*[F.coalesce(clean_double(df, c), F.lit(0.0)) for c in features])).alias("features"),
    ).where("label is not null"), "elimination")
    drop_n = max(1, int(step * len(features)))
    left, ranking, round_no = list(range(len(features))), [], 0
    while True:
        slicer = VectorSlicer(inputCol="features", outputCol="part", indices=left)
        weights = estimator.fit(slicer.transform(table)).featureImportances.toArray()
        by_weight = sorted(range(len(left)), key=lambda i: (weights[i], -i))
        cut = min(drop_n, len(left) - n_features)
        if cut <= 0:
            break
        round_no += 1
        ranking += [(features[left[i]], round_no, float(weights[i])) for i in by_weight[:cut]]
        gone = {left[i] for i in by_weight[:cut]}
        left = [i for i in left if i not in gone]
    kept = [features[i] for i in left]
    return kept, ranking + [(f, 0, float(w)) for f, w in zip(kept, weights)]


@dataclass
class PcaModel:
    """Standardisation plus projection with stored parameters."""

    scaler: Scaler
    model: PCAModel
    signs: list[float]
    explained: list[float]

    @property
    def names(self) -> list[str]:
        return [f"PC_{i + 1}" for i in range(len(self.signs))]

    def transform(self, df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        out = self.model.transform(_standardised(df, self.scaler, carry))
        scores = vector_to_array("pc")
        return out.select(*carry, *[(scores[i] * F.lit(s)).alias(n) for i, (s, n) in enumerate(zip(self.signs, self.names))])

    def variance_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(self.explained)], "component int, variance double")


def _first_components(spark: SparkSession, model: PCAModel, k: int) -> PCAModel:
    """The model of the first ``k`` components, by way of its saved form: rows are then multiplied with these only."""
    loadings = model.pc.toArray()
    if k >= loadings.shape[1]:
        return model
    whole, part = new_path(spark, "pca"), new_path(spark, "components")
    model.write().save(whole)
    meta = json.loads(spark.read.text(f"{whole}/metadata").first()["value"])
    meta["paramMap"]["k"] = k
    row = (DenseMatrix(loadings.shape[0], k, loadings[:, :k].ravel("F").tolist()), DenseVector(model.explainedVariance.toArray()[:k]))
    held = spark.createDataFrame([row], StructType([StructField("pc", MatrixUDT()), StructField("explainedVariance", VectorUDT())]))
    held.coalesce(1).write.parquet(f"{part}/data")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{part}/metadata")
    return PCAModel.load(part)


def _standardised(df: DataFrame, scaler: Scaler, carry: Sequence[str] = ()) -> DataFrame:
    """The scaled vector; a missing value stands at its column's mean."""
    return df.select(*carry, array_to_vector(F.array(*[
        F.coalesce(scaler.expr(c, clean_double(df, c)), F.lit(0.0)) for c in scaler.columns])).alias("z"))


def fit_pca(df: DataFrame, features: Sequence[str], k: int | None = None, variance_ratio: float = 0.95) -> PcaModel:
    """PCA of the standardised features; ``k`` or the fewest components reaching the ratio.

    Signs are fixed so that the largest loading of each component is positive, of equal ones the first.
    """
    scaler = fit_scaler(df, features, "standard")
    z = _standardised(df, scaler)
    full = PCA(k=len(features) if k is None else k, inputCol="z", outputCol="pc").fit(z)
    explained = full.explainedVariance.toArray()
    if k is None:  # the first components of the one fit
        reach = np.cumsum(explained) >= variance_ratio - 1e-12
        k = int(np.argmax(reach)) + 1 if reach.any() else len(features)
        explained = explained[:k]
    loadings = full.pc.toArray()[:, :k]
    size = np.abs(loadings)
    peak = loadings[(size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0), range(loadings.shape[1])]
    return PcaModel(scaler, _first_components(df.sparkSession, full, k or len(features)), [1.0 if x >= 0 else -1.0 for x in peak], [float(x) for x in explained])


@dataclass
class SelectorModel:
    """A fitted selection: ``transform`` keeps the chosen columns or projects."""

    features: list[str]
    selected: list[str]
    scores: dict[str, float] = field(default_factory=dict)
    pca: PcaModel | None = None
    ranking: list[tuple[str, int, float]] = field(default_factory=list)

    def transform(self, df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        if self.pca is not None:
            return self.pca.transform(df, carry)
        return df.select(*carry, *self.selected)

    def score_table(self, spark) -> DataFrame:
        """``feature, score, selected``, best first."""
        rows = [(f, s, f in self.selected) for f, s in self.scores.items()]
        return spark.createDataFrame(rows, "feature string, score double, selected boolean").orderBy(F.desc("score"), "feature")

    def ranking_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.ranking, "feature string, round_dropped int, importance double")


class FeatureSelector:
    def __init__(self, method: str = "combined", n_features: int = 100, variance_threshold: float = 0.01,
                 correlation_threshold: float = 0.95, problem_type: str = "regression", bins: int = 10,
                 binning: str = "quantile", pca_components: int | None = None):
        if method not in METHODS:
            raise ValueError(f"unknown method: {method}; use one of {METHODS}")
        self.method, self.n_features, self.problem_type = method, n_features, problem_type
        self.variance_threshold, self.correlation_threshold = variance_threshold, correlation_threshold
        self.bins, self.binning, self.pca_components = bins, binning, pca_components

    def fit(self, df: DataFrame, features: Sequence[str], target: str | None = None) -> SelectorModel:
        features = list(features)
        if self.method in NEEDS_TARGET and target is None:
            raise DataError(f"a target is required for {self.method} selection")
        k = min(self.n_features, len(features))
        if self.method == "variance":
            return SelectorModel(features, keep_varying(df, features, self.variance_threshold))
        if self.method == "correlation":
            return SelectorModel(features, keep_uncorrelated(df, features, self.correlation_threshold))
        if self.method == "mutual_info":
            return self._by_score(self._mutual_info(df, features, target), features, features, k)
        if self.method == "f_statistic":
            return self._by_score(f_statistic(df, features, target, self.problem_type), features, features, k)
        if self.method == "rfe":
            kept, ranking = recursive_elimination(df, features, target, k, self.problem_type)
            return SelectorModel(features, kept, {f: w for f, _, w in ranking}, ranking=ranking)
        if self.method == "pca":
            pca = fit_pca(df, features, self.pca_components)
            return SelectorModel(features, pca.names, pca=pca)
        left = keep_varying(df, features, self.variance_threshold)
        left = keep_uncorrelated(df, left, self.correlation_threshold)
        if target is not None and len(left) > self.n_features:
            return self._by_score(self._mutual_info(df, left, target), features, left, self.n_features)
        return SelectorModel(features, left)

    def _mutual_info(self, df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
        return mutual_information(df, features, target, self.problem_type, self.bins, self.binning)

    def _by_score(self, table: DataFrame, features: list[str], among: Sequence[str], k: int) -> SelectorModel:
        scores = {r["feature"]: r["score"] for r in table.collect()}
        return SelectorModel(features, _top_in_order(scores, among, k), scores)
