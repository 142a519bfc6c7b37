"""Tree-ensemble training, tuning, scoring and persistence on Spark ML."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propspark.columns import WIDE_AGG_LIMIT, numeric_columns
from propspark.errors import DataError, NotFittedError
from propspark.functions.hashing import keyed_fold, keyed_uniform
from propspark.operators import forest_growth
from propspark.operators.evaluation import (
    CLASSIFICATION_METRICS, REGRESSION_METRICS, evaluate,
)
from propspark.operators.joins import ordered_features
from propspark.operators.split_scale import Scaler
from propspark.operators.tuning import grid_scores
from propspark.operators.validation import record_errors
from propspark.session import materialize

MODEL_TYPES = ("random_forest", "gradient_boosting", "xgboost")
PROBLEM_TYPES = ("regression", "classification")
MAX_DEPTH = 30  # deepest tree Spark ML grows; stands for "no limit" (None)

# fixed values: default parameters per model type
DEFAULTS = {
    "random_forest": {"n_estimators": 200, "max_depth": 15, "min_samples_split": 5, "min_samples_leaf": 2,
                      "max_features": "sqrt"},
    "gradient_boosting": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 5, "min_samples_split": 5,
                          "subsample": 0.9},
    "xgboost": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 6, "subsample": 0.9,
                "colsample_bytree": 0.9, "reg_alpha": 0.1, "reg_lambda": 1.0},
}
# fixed values: tuning grids per model type
GRIDS = {
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [10, 15, 20, None],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting": {"n_estimators": [100, 200, 300], "learning_rate": [0.05, 0.1, 0.2],
                          "max_depth": [3, 5, 7], "subsample": [0.8, 0.9, 1.0]},
    "xgboost": {"n_estimators": [100, 200, 300], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7],
                "subsample": [0.8, 0.9], "colsample_bytree": [0.8, 0.9, 1.0]},
}
# A small setting for quick runs; the defaults above stay the defaults.
FAST = {"n_estimators": 10, "max_depth": 5}


def _have_xgboost() -> bool:
    try:
        import xgboost.spark  # noqa: F401
        return True
    except ImportError:
        return False


def _spark_params(engine: str, params: dict) -> tuple[dict, list[str]]:
    """Spark ML parameters for the given names, and the names without a counterpart."""
    forest = engine == "random_forest"
    names = {"n_estimators": "numTrees" if forest else "maxIter", "max_depth": "maxDepth",
             "min_samples_leaf": "minInstancesPerNode", "subsample": "subsamplingRate", "max_bins": "maxBins"}
    names["bootstrap" if forest else "learning_rate"] = "bootstrap" if forest else "stepSize"
    out, ignored = {}, []
    for k, v in params.items():
        if k == "max_depth":
            if v is not None and int(v) > MAX_DEPTH:
                raise ValueError(f"max_depth is at most {MAX_DEPTH}; None stands for no limit")
            out["maxDepth"] = MAX_DEPTH if v is None else int(v)
        elif k in ("max_features", "colsample_bytree"):
            out["featureSubsetStrategy"] = str(v)
        elif k in names:
            out[names[k]] = v
        else:
            ignored.append(k)
    return out, ignored


def feature_array(df: DataFrame, names: Sequence[str], scaler: Scaler | None = None) -> Column:
    """The named columns in order as one array; absent, null or NaN as 0, then scaled."""
    if len(names) <= WIDE_AGG_LIMIT:
        cols = ordered_features(df, names)
        if scaler is not None:
            cols = [scaler.expr(n, c) if n in scaler.scale else c for n, c in zip(names, cols)]
        return F.array(*cols)
    # many columns: a single expression over the array instead of one per column
    have = set(df.columns)
    raw = F.array(*[F.col(f"`{n}`").cast("double") if n in have else F.lit(0.0) for n in names])

    def filled(v: Column) -> Column:
        return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))

    if scaler is None:
        return F.transform(raw, filled)
    center = F.array(*[F.lit(scaler.center.get(n, 0.0)) for n in names])
    scale = F.array(*[F.lit(scaler.scale.get(n, 1.0)) for n in names])
    return F.transform(raw, lambda v, i: (filled(v) - F.get(center, i)) / F.get(scale, i))


def assemble(df: DataFrame, names: Sequence[str], scaler: Scaler | None = None) -> DataFrame:
    """Add the ``features`` vector."""
    return df.withColumn("features", array_to_vector(feature_array(df, names, scaler)))


def _importances(model, features: int) -> list[float]:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    # the optional engine names features by place and leaves out unused ones
    found = model.get_feature_importances(importance_type="gain")
    total = sum(found.values()) or 1.0
    return [found.get(f"f{i}", 0.0) / total for i in range(features)]


def fit_model(estimator, table: DataFrame):
    """The fitted model without its training summary.

    The summary of a classification forest holds the session, which would go to the tasks with the model and cannot be
    serialized once the session has, for example, observed a metric. A copy leaves it out. Deep regression forests are
    grown by ``forest_growth`` (from a written table, as they take several passes).
    """
    if forest_growth.grows(estimator):
        return forest_growth.grow(estimator, table)
    model = estimator.fit(table)
    return model.copy() if isinstance(model, RandomForestClassificationModel) else model


@dataclass
class ModelBundle:
    """A fitted model with everything needed to score raw columns."""

    target: str
    model_type: str
    engine: str
    problem_type: str
    feature_names: list[str]
    model: object
    scaler: Scaler | None = None
    metrics: dict[str, float] = field(default_factory=dict)
    best_params: dict | None = None
    ignored_params: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, output: str = "prediction", only: Column | None = None) -> DataFrame:
        """Add the prediction, null where ``only`` is false: their own values do not reach the model."""
        if self.model is None:
            raise NotFittedError("model not trained yet")
        keep = [c for c in df.columns if c != output]
        ready = assemble(df.select(*keep), self.feature_names, self.scaler)
        value = F.col("prediction")
        if only is not None:
            zeros = array_to_vector(F.array_repeat(F.lit(0.0), len(self.feature_names)))
            ready = ready.withColumn("features", F.when(only, F.col("features")).otherwise(zeros))
            value = F.when(only, value)
        return forest_growth.transform(self.model, ready).select(*keep, value.alias(output))

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        scored = self.predict(df.where(F.col(self.target).isNotNull()), "_pred")
        return evaluate(scored, self.target, "_pred", self.problem_type).first().asDict()

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, importance``, best first; mean over the sub-models of one-vs-rest."""
        last = self.model.stages[-1]
        parts = last.models if isinstance(last, OneVsRestModel) else [last]
        weights = [_importances(p, len(self.feature_names)) for p in parts]
        rows = [(n, float(sum(w[i] for w in weights) / len(weights))) for i, n in enumerate(self.feature_names)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, path: str) -> str:
        if self.model is None:
            raise NotFittedError("no model to save")
        self.model.write().overwrite().save(f"{path}/model")
        meta = {
            "target": self.target, "model_type": self.model_type, "engine": self.engine,
            "problem_type": self.problem_type, "feature_names": self.feature_names, "metrics": self.metrics,
            "best_params": self.best_params, "ignored_params": self.ignored_params,
            "scaler": None if self.scaler is None else self.scaler.to_json(), "path": path,
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ModelBundle":
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        scaler = None if meta["scaler"] is None else Scaler.from_json(meta["scaler"])
        return ModelBundle(
            meta["target"], meta["model_type"], meta["engine"], meta["problem_type"], meta["feature_names"],
            PipelineModel.load(f"{path}/model"), scaler, meta["metrics"], meta["best_params"], meta["ignored_params"])


class ModelTrainer:
    def __init__(self, model_type: str = "random_forest", problem_type: str = "regression",
                 hyperparameters: dict | None = None, cv_folds: int = 5, seed: int = 42, profile: str = "default"):
        if model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type: {model_type}")
        if problem_type not in PROBLEM_TYPES:
            raise ValueError(f"unknown problem type: {problem_type}")
        self.model_type, self.problem_type = model_type, problem_type
        self.engine = model_type
        if model_type == "xgboost" and not _have_xgboost():
            warnings.warn("xgboost is not installed, gradient boosting is used instead")
            self.model_type = self.engine = "gradient_boosting"
        self.params = {**DEFAULTS[self.engine], **(FAST if profile == "fast" else {}), **(hyperparameters or {})}
        self.cv_folds, self.seed = cv_folds, seed
        self.ignored: list[str] = []

    def estimator(self, classes: int = 2, **override):
        """The Spark ML estimator; boosting with more than two classes runs one-vs-rest."""
        params, self.ignored = _spark_params(self.engine, {**self.params, **override})
        if self.engine == "xgboost":
            return self._xgboost({**self.params, **override})
        common = {"labelCol": "label", "featuresCol": "features", "seed": self.seed, **params}
        if self.problem_type == "regression":
            return (RandomForestRegressor if self.engine == "random_forest" else GBTRegressor)(**common)
        if self.engine == "random_forest":
            return RandomForestClassifier(**common)
        booster = GBTClassifier(**common)
        return booster if classes <= 2 else OneVsRest(classifier=booster, labelCol="label", featuresCol="features")

    def _xgboost(self, params: dict):
        from xgboost.spark import SparkXGBClassifier, SparkXGBRegressor
        make = SparkXGBRegressor if self.problem_type == "regression" else SparkXGBClassifier
        return make(label_col="label", features_col="features", random_state=self.seed, **params)

    def _many_fits(self) -> bool:
        """A single fit keeps its own binned copy of the rows; one-vs-rest fits once per class."""
        return self.problem_type == "classification" and self.engine != "random_forest"

    @property
    def scoring(self) -> str:
        return "r2" if self.problem_type == "regression" else "f1_score"

    def _labelled(self, df: DataFrame, names: Sequence[str], target: str, scaler: Scaler | None) -> DataFrame:
        rows = df.where(F.col(target).isNotNull())
        if self.problem_type == "classification":
            rows = rows.withColumn("label", F.col(target).cast("int").cast("double"))
        else:
            rows = rows.withColumn("label", F.col(target).cast("double"))
        return assemble(rows, names, scaler)

    def _classes(self, table: DataFrame) -> int:
        if self.problem_type == "regression":
            return 0
        top = table.agg(F.max("label")).first()[0]
        return 0 if top is None else int(top) + 1

    def train(self, train: DataFrame, features: Sequence[str], target: str, val: DataFrame | None = None,
              scaler: Scaler | None = None, key: str | None = None, tune: bool = False, grid: dict | None = None,
              tune_rows: int | None = None) -> ModelBundle:
        """Fit on all training rows; metrics come from ``val``, or from the training rows without one."""
        table = self._labelled(train, features, target, scaler).select(*([key] if key else []), "label", "features")
        if key:  # many passes follow: an even spread is worth one shuffle of the narrow table
            table = table.repartition(F.xxhash64(key, "features"))
        if written := tune or self._many_fits() or forest_growth.grows(self.estimator()):
            table = materialize(table, "fit")
        classes = self._classes(table)
        best, fitted = self._search(table, key, grid, tune_rows, classes) if tune else (None, None)
        if fitted is None:
            fitted = fit_model(self.estimator(classes, **(best or {})), table)
        bundle = ModelBundle(target, self.model_type, self.engine, self.problem_type, list(features),
                             PipelineModel([fitted]), scaler, best_params=best, ignored_params=list(self.ignored))
        if val is None and written and self.problem_type == "regression":
            # the written table has the rows and labels of ``train`` already
            bundle.metrics = evaluate(forest_growth.transform(bundle.model, table), "label", "prediction", self.problem_type).first().asDict()
        else:
            bundle.metrics = bundle.evaluate(val if val is not None else train)
        return bundle

    def _search(self, table: DataFrame, key: str | None, grid: dict | None, tune_rows: int | None, classes: int) -> tuple[dict, object]:
        """Best grid point by cross-validation and the model fitted with it on all rows.

        Points that mean the same to Spark are tried once (the first stands for all). ``tune_rows`` tunes on about that
        many rows, chosen by key hash; the caller then fits on all rows.
        """
        whole = True
        if key is None:
            raise DataError("tuning needs a key column for the folds")
        grid = grid or GRIDS[self.engine]
        if tune_rows:
            n = table.count()
            if n > tune_rows:
                whole = False
                table = table.where(keyed_uniform(F.col(key), f"tune{self.seed}") < tune_rows / n)
        table = table.withColumn("fold", keyed_fold(F.col(key), self.cv_folds, self.seed))
        points = self.distinct_points(grid)
        maps = [p if self.engine == "xgboost" else _spark_params(self.engine, p)[0] for p in points]

        def fit(rows: DataFrame, params: dict):
            return fit_model(self._with(classes, params), rows)

        scores = grid_scores(table, maps, fit, self.problem_type, self.cv_folds)
        found = max(range(len(points)), key=lambda i: -math.inf if scores[i] is None else scores[i])
        return points[found], fit(table, maps[found]) if whole else None

    def _with(self, classes: int, params: dict):
        """The estimator with other Spark parameters; those of one-vs-rest belong to its classifier."""
        est = self.estimator(classes)
        inner = est.getClassifier() if isinstance(est, OneVsRest) else est
        changed = inner.copy({inner.getParam(k): v for k, v in params.items()})
        return changed if inner is est else est.copy({est.classifier: changed})

    def distinct_points(self, grid: dict) -> list[dict]:
        """The grid's points without those that give the same Spark parameters as an earlier one."""
        points: dict[str, dict] = {}
        for values in product(*grid.values()):
            point = dict(zip(grid, values))
            params = point if self.engine == "xgboost" else _spark_params(self.engine, point)[0]
            points.setdefault(json.dumps(params, sort_keys=True), point)
        return list(points.values())

    def cross_validate(self, df: DataFrame, features: Sequence[str], target: str, key: str,
                       scaler: Scaler | None = None) -> DataFrame:
        """``fold, score`` with folds from the key hash."""
        fold = keyed_fold(F.col(key), self.cv_folds, self.seed).alias("fold")
        table = self._labelled(df, features, target, scaler).select(key, "label", "features", fold)
        table = materialize(table.repartition(F.xxhash64(key, "features")), "folds")
        classes = self._classes(table)
        rows = []
        for i in range(self.cv_folds):
            fitted = fit_model(self.estimator(classes), table.where(F.col("fold") != i))
            got = evaluate(fitted.transform(table.where(F.col("fold") == i)), "label", "prediction", self.problem_type)
            rows.append((i, got.first()[self.scoring]))
        return df.sparkSession.createDataFrame(rows, "fold int, score double")


def cv_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("folds"))


def learning_curve(trainer: ModelTrainer, train: DataFrame, val: DataFrame, features: Sequence[str], target: str,
                   key: str, fractions: Sequence[float] = (0.2, 0.5, 1.0), repeats: int = 2) -> DataFrame:
    """``train_size, split, repeat, score`` of fits on nested key-hash samples; ``train_size`` is the sample's row count.

    The whole table is one sample, so a fraction of 1 is fitted once.
    """
    columns = list(dict.fromkeys([key, *features, target]))
    train, val = materialize(train.select(*columns), "curve"), materialize(val.select(*columns), "curve")
    rows = []
    for f in fractions:
        for r in range(repeats if f < 1 else 1):
            part = train.where(keyed_uniform(F.col(key), f"curve{r}") < f) if f < 1 else train
            bundle, size = trainer.train(part, features, target, val, key=key), part.count()
            rows += [(size, "train", r, bundle.evaluate(part)[trainer.scoring]), (size, "val", r, bundle.metrics[trainer.scoring])]
    return train.sparkSession.createDataFrame(rows, "train_size long, split string, repeat int, score double")


# --- many targets ---------------------------------------------------------------------------


@dataclass
class MultiTargetModel:
    bundles: dict[str, ModelBundle]

    def predict(self, df: DataFrame) -> DataFrame:
        for target, b in self.bundles.items():
            df = b.predict(df, f"pred_{target}")
        return df

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Long table ``target, model_type, metric, value``."""
        rows = [(t, b.model_type, m, float(v)) for t, b in self.bundles.items() for m, v in b.evaluate(df).items()]
        return df.sparkSession.createDataFrame(rows, "target string, model_type string, metric string, value double")

    def save(self, spark: SparkSession, base: str) -> dict[str, str]:
        return {t: b.save(spark, f"{base}/{t}__{b.model_type}") for t, b in self.bundles.items()}

    @staticmethod
    def load(spark: SparkSession, base: str) -> "MultiTargetModel":
        """Targets come from the stored metadata, not from the folder names."""
        chosen = {}
        for r in read_metadata(spark, base).select("target", "path").orderBy("path").collect():
            chosen[r["target"]] = ModelBundle.load(spark, r["path"])
        return MultiTargetModel(chosen)


def train_targets(train: DataFrame, features: Sequence[str], target_types: dict[str, str], val: DataFrame | None = None,
                  model_type: str = "random_forest", scaler: Scaler | None = None, **trainer_args) -> MultiTargetModel:
    """One model per target from one written feature table."""
    train = materialize(train.select(*dict.fromkeys([*features, *target_types])), "targets")
    return MultiTargetModel({
        t: ModelTrainer(model_type, kind, **trainer_args).train(train, features, t, val, scaler)
        for t, kind in target_types.items()
    })


META_SCHEMA = (
    "target string, model_type string, engine string, problem_type string, feature_names array<string>, "
    "metrics map<string,double>, path string"
)


def read_metadata(spark: SparkSession, base: str) -> DataFrame:
    """Metadata of every model saved below ``base``."""
    return spark.read.schema(META_SCHEMA).json(f"{base}/*/meta")


def model_catalogue(meta: DataFrame, metric_names: Sequence[str] = REGRESSION_METRICS + CLASSIFICATION_METRICS) -> DataFrame:
    """One line per saved model with its metrics as columns."""
    long = meta.select("target", "model_type", "problem_type", F.explode("metrics").alias("metric", "value"))
    return pivot_metrics(long, metric_names).withColumn("status", F.lit("loaded"))


def pivot_metrics(long: DataFrame, metric_names: Sequence[str], ids: Sequence[str] = ("target", "model_type", "problem_type")) -> DataFrame:
    return long.groupBy(*ids).pivot("metric", list(metric_names)).agg(F.first("value"))


def score_batch(df: DataFrame, bundles: Sequence[ModelBundle], smiles: str = "smiles",
                mass: str = "molecular_weight", key: str = "cid") -> DataFrame:
    """Validate and score every row; a failed row keeps its key, error text and null predictions.

    Valid and failed rows stay in one table, so the input is scanned once; only valid rows reach the models.
    """
    out = df.withColumn("error", F.array_join(record_errors(smiles, mass, key), "; "))
    ok = F.col("error") == ""
    for b in bundles:
        out = b.predict(out, f"pred_{b.target}", only=ok)
    return out.withColumns({
        "status": F.when(ok, "ok").otherwise("failed"),
        "error": F.when(ok, None).otherwise(F.col("error")),
    })


def batch_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("successful"),
                      F.count_if(F.col("status") == "failed").alias("failed"))


def training_table(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric projection of an uploaded table; the target must be one of its numeric columns."""
    if target not in df.columns:
        raise DataError(f"target column not found: {target}")
    numeric = numeric_columns(df, exclude)
    if target not in numeric:
        raise DataError(f"target column must be numeric: {target}")
    features = [c for c in numeric if c != target]
    if not features:
        raise DataError("no numeric feature columns")
    return df.select(*features, target), features


def metrics_table(bundle: ModelBundle, metrics: dict[str, float], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(bundle.target, bundle.model_type, m, float(v)) for m, v in metrics.items()],
                                 "target string, model_type string, metric string, value double")
