"""The whole study: select, split, scale, train, compare, explain, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from propspark.operators import attribution
from propspark.operators.cleaning import fill_zero
from propspark.operators.evaluation import evaluate
from propspark.operators.learning import MODEL_TYPES, ModelBundle, ModelTrainer
from propspark.operators.ranking import best_model
from propspark.operators.selection import FeatureSelector
from propspark.operators.split_scale import fit_scaler, split
from propspark.session import materialize
from propspark.sources.tables import slim, write_metrics_report


@dataclass
class RunSpec:
    key: str
    features: Sequence[str]
    target_types: dict[str, str]
    model_types: Sequence[str] = MODEL_TYPES
    n_features: int = 100
    test_size: float = 0.2
    val_size: float = 0.2
    seed: int = 42
    profile: str = "default"
    hyperparameters: dict = field(default_factory=dict)
    explain: bool = True


@dataclass
class RunResult:
    metrics: DataFrame
    best: DataFrame
    bundles: dict[tuple[str, str], ModelBundle]
    attributions: DataFrame | None = None
    base_value: float | None = None
    paths: dict[str, str] = field(default_factory=dict)


def run_study(df: DataFrame, spec: RunSpec, output: str | None = None) -> RunResult:
    """Train every model type for every target on the train split and compare on the test split.

    Selection and scaling are fitted on the train split only. The prepared table is
    written once; every fit and evaluation reads it.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys([spec.key, *spec.features, *spec.target_types]))
    table = fill_zero(df.select(*columns), list(spec.features))
    table = materialize(split(table, spec.key, spec.test_size, spec.val_size, spec.seed), "study")
    train, val, test = (table.where(F.col("split") == s) for s in ("train", "val", "test"))
    rows, bundles, paths, chosen_of = [], {}, {}, {}
    for target, kind in spec.target_types.items():
        selector = FeatureSelector("combined", spec.n_features, problem_type=kind)
        chosen = selector.fit(train, spec.features, target).selected
        scaler = fit_scaler(train, chosen)
        scored = test.where(F.col(target).isNotNull())
        chosen_of[target] = len(chosen)
        for m in spec.model_types:
            trainer = ModelTrainer(m, kind, spec.hyperparameters.get(m), seed=spec.seed, profile=spec.profile)
            m = trainer.model_type
            if (target, m) in bundles:  # a missing engine falls back to one that is trained already
                continue
            bundle = bundles[target, m] = trainer.train(train, chosen, target, val, scaler, spec.key)
            got = evaluate(bundle.predict(scored, "_p"), target, "_p", kind).first().asDict()
            rows += [(target, m, k, float(v)) for k, v in got.items()]
            if output:
                paths[f"{target}_{m}"] = bundle.save(spark, f"{output}/models/{target}__{m}")
    metrics = spark.createDataFrame(rows, "target string, model_type string, metric string, value double")
    by_kind = {"regression": "r2", "classification": "f1_score"}
    best = None
    for target, kind in spec.target_types.items():
        one = best_model(metrics.where(F.col("target") == target), by_kind[kind])
        best = one if best is None else best.unionByName(one)
    result = RunResult(metrics, best, bundles, paths=paths)
    first = next(iter(spec.target_types))
    top = best.where(F.col("target") == first).first()
    if spec.explain and top is not None:
        bundle = bundles[first, top["model_type"]]
        if attribution.has_tree_method(bundle):
            result.attributions, result.base_value = attribution.tree_shap(test, spec.key, bundle)
        else:
            result.attributions, result.base_value = attribution.explain(test, spec.key, bundle, train)
    if output:
        paths["table"] = f"{output}/features_slim"
        slim(df).write.mode("overwrite").parquet(paths["table"])
        paths["report"] = write_metrics_report(
            spark, f"{output}/metrics", metrics, n_rows=table.count(), n_features=chosen_of[first],
            best_model=top["model_type"], saved_models=dict(paths))
    return result
