import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from propspark.errors import DataError, NotFittedError
from propspark.operators import evaluation, learning, ranking
from propspark.operators.split_scale import fit_scaler, split
from propspark.plans.full_run import RunSpec, run_study
from propspark.session import new_path

SMALL = {"n_estimators": 8, "max_depth": 4}


def hashed(spark, n, columns):
    """Columns of hashed numbers in [-1, 1), functions of the row number alone."""
    cells = [(F.pmod(F.xxhash64("id", F.lit(f"column {i}")), F.lit(4096)) / 2048 - 1).alias(f"f{i}") for i in range(columns)]
    return spark.range(n).select("id", *cells), [f"f{i}" for i in range(columns)]


def regression(spark, n=100):
    """A step in one column, a slope in another, a product of two."""
    df, names = hashed(spark, n, 10)
    step = F.when(F.col("f0") > -0.25, 3.0).otherwise(-2.0)
    return df.withColumn("target", step + 2 * F.col("f1") + 0.5 * F.col("f2") * F.col("f3")), names


def classes(spark, n=100):
    """Inside or outside of a tilted band."""
    df, names = hashed(spark, n, 5)
    return df.withColumn("target", (F.abs(F.col("f0") - 0.5 * F.col("f1")) < 0.45).cast("int")), names


@pytest.mark.parametrize("model", learning.MODEL_TYPES)
@pytest.mark.filterwarnings("ignore")
def test_learns(spark, model):
    df, names = regression(spark)
    b = learning.ModelTrainer(model, "regression", SMALL).train(df, names, "target")
    assert b.metrics["r2"] > 0.3 and set(b.metrics) == set(evaluation.REGRESSION_METRICS)
    df, names = classes(spark)
    b = learning.ModelTrainer(model, "classification", SMALL).train(df, names, "target")
    assert b.metrics["accuracy"] > 0.7 and set(b.metrics) == set(evaluation.CLASSIFICATION_METRICS)


def test_bad_names():
    with pytest.raises(ValueError):
        learning.ModelTrainer("oracle")
    with pytest.raises(ValueError):
        learning.ModelTrainer("random_forest", "guessing")


@pytest.mark.filterwarnings("ignore")
def test_fallback_and_parameters():
    t = learning.ModelTrainer("xgboost")
    assert t.model_type == t.engine and t.engine in ("xgboost", "gradient_boosting")
    f = learning.ModelTrainer("random_forest")
    est = f.estimator()
    assert (est.getNumTrees(), est.getMaxDepth(), est.getMinInstancesPerNode(), est.getFeatureSubsetStrategy()) == (200, 15, 2, "sqrt")
    assert f.ignored == ["min_samples_split"]
    with pytest.raises(ValueError):
        f.estimator(max_depth=31)
    assert not f.estimator(bootstrap=False).getBootstrap()
    assert len(f.distinct_points(learning.GRIDS["random_forest"])) == 36
    g = learning.ModelTrainer("gradient_boosting").estimator(max_depth=None)
    assert (g.getMaxIter(), g.getStepSize(), g.getSubsamplingRate(), g.getMaxDepth()) == (200, 0.1, 0.9, learning.MAX_DEPTH)


def test_missing_values_count_as_zero(spark):
    df, names = regression(spark)
    for some in (names, names + [f"more{i}" for i in range(30)]):
        wide = df.select("*", *[F.lit(0.5).alias(c) for c in some if c not in df.columns])
        b = learning.ModelTrainer("gradient_boosting", "regression", SMALL).train(wide, some, "target")
        odd = wide.limit(1).drop("f0").crossJoin(spark.createDataFrame([(float("nan"),), (None,), (0.0,)], "f0 double"))
        assert len({r["prediction"] for r in b.predict(odd).collect()}) == 1


def test_unfitted_use_is_an_error(spark):
    b = learning.ModelBundle("target", "random_forest", "random_forest", "regression", ["f0"], None)
    with pytest.raises(NotFittedError):
        b.predict(spark.range(2))
    with pytest.raises(NotFittedError):
        b.save(spark, "nowhere")


def test_save_and_reload(spark):
    df, names = regression(spark)
    scaler = fit_scaler(df, names)
    b = learning.ModelTrainer("random_forest", "regression", SMALL).train(df, names, "target", scaler=scaler)
    again = learning.ModelBundle.load(spark, b.save(spark, new_path(spark, "m")))
    got = again.predict(b.predict(df, "a"), "b").select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert got == 0.0 and again.metrics == b.metrics and again.scaler == scaler and again.feature_names == names


def test_raw_columns_missing_count_as_zero(spark):
    df, names = regression(spark)
    b = learning.ModelTrainer("random_forest", "regression", SMALL).train(df, names, "target")
    gone = b.predict(df.drop("f3").withColumn("extra", F.lit(1)), "p").orderBy("id").collect()
    zero = b.predict(df.withColumn("f3", F.lit(0.0)), "p").orderBy("id").collect()
    assert [r["p"] for r in gone] == [r["p"] for r in zero]
    shuffled = b.predict(df.select(*reversed(df.columns)), "p").orderBy("id").collect()
    assert [r["p"] for r in shuffled] == [r["p"] for r in b.predict(df, "p").orderBy("id").collect()]


@pytest.mark.filterwarnings("ignore")
def test_three_classes_boosting_and_importance(spark):
    df, names = classes(spark, 150)
    df = df.withColumn("target", F.when(F.col("f0") > 0.6, 2).otherwise(F.col("target")))
    b = learning.ModelTrainer("gradient_boosting", "classification", {"n_estimators": 4, "max_depth": 3}).train(df, names, "target")
    assert b.metrics["accuracy"] > 0.7
    table = b.importance(spark).collect()
    assert len(table) == 5 and sum(r["importance"] for r in table) == pytest.approx(1.0)
    assert [r["importance"] for r in table] == sorted((r["importance"] for r in table), reverse=True)


def test_cross_validation_and_tuning(spark):
    df, names = regression(spark)
    t = learning.ModelTrainer("random_forest", "regression", SMALL, cv_folds=3)
    scores = t.cross_validate(df, names, "target", "id")
    assert scores.count() == 3
    s = learning.cv_summary(scores).first()
    values = [r["score"] for r in scores.collect()]
    assert s["mean"] == pytest.approx(np.mean(values)) and s["std"] == pytest.approx(np.std(values))
    b = t.train(df, names, "target", key="id", tune=True, grid={"max_depth": [1, 4], "n_estimators": [5]})
    assert b.best_params == {"max_depth": 4, "n_estimators": 5}
    with pytest.raises(DataError):
        t.train(df, names, "target", tune=True)


def test_targets(spark):
    df, names = regression(spark)
    df = df.withColumn("second", F.when(F.col("f2") > 0, 1).otherwise(0)).withColumn("a_b_c", -F.col("f3"))
    model = learning.train_targets(df, names, {"target": "regression", "second": "classification", "a_b_c": "regression"}, hyperparameters=SMALL)
    out = model.predict(df)
    assert {"pred_target", "pred_second", "pred_a_b_c"} <= set(out.columns) and out.count() == 100
    base = new_path(spark, "targets")
    model.save(spark, base)
    again = learning.MultiTargetModel.load(spark, base)
    assert set(again.bundles) == {"target", "second", "a_b_c"}
    assert sorted(map(tuple, again.evaluate(df).collect())) == sorted(map(tuple, model.evaluate(df).collect()))
    cat = learning.model_catalogue(learning.read_metadata(spark, base)).collect()
    assert {r["target"] for r in cat} == set(again.bundles) and all(r["status"] == "loaded" for r in cat)


def test_metrics_closed_form(spark):
    reg = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 1.9, 3.2, 3.8, 5.1])), "y double, p double")
    m = evaluation.regression_metrics(reg, "y", "p").first()
    assert m["mse"] == pytest.approx(0.022) and m["mae"] == pytest.approx(0.14) and m["r2"] == pytest.approx(1 - 0.11 / 10)
    cls = spark.createDataFrame(list(zip([0, 1, 2, 0, 1, 2], [0, 1, 1, 0, 1, 2])), "y int, p int")
    m = evaluation.classification_metrics(cls, "y", "p").first()
    assert m["accuracy"] == pytest.approx(5 / 6) and m["recall"] == pytest.approx(5 / 6)
    assert m["precision"] == pytest.approx((1 + 2 / 3 + 1) / 3) and m["f1_score"] == pytest.approx((1 + 0.8 + 2 / 3) / 3)
    cells = {(r["actual"], r["predicted"]): r["count"] for r in evaluation.confusion_matrix(cls, "y", "p").collect()}
    assert len(cells) == 9 and cells[2.0, 1.0] == 1 and cells[0.0, 2.0] == 0
    with pytest.raises(ValueError):
        evaluation.evaluate(cls, "y", "p", "odd")


def test_zero_division_counts_as_zero(spark):
    m = evaluation.classification_metrics(spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "y int, p int"), "y", "p").first()
    assert m["precision"] == pytest.approx((0 + 1 / 3) / 3) and m["f1_score"] == pytest.approx(0.5 / 3)
    flat = evaluation.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double"), "y", "p").first()
    assert flat["r2"] == 0.0


def test_batch_scoring_isolates_bad_rows(spark):
    df, names = regression(spark)
    b = learning.ModelTrainer("random_forest", "regression", SMALL).train(df, names, "target")
    rows = df.select("id", *names).withColumn("smiles", F.when(F.col("id") % 10 == 0, "C1CC").otherwise("CCO")).withColumn("molecular_weight", F.lit(46.0))
    out = learning.score_batch(rows, [b], key="id")
    bad = out.where("status = 'failed'").collect()
    assert len(bad) == 10 and all("Invalid SMILES" in r["error"] and r["pred_target"] is None for r in bad)
    assert learning.batch_counts(out).first().asDict() == {"total": 100, "successful": 90, "failed": 10}


def test_training_table_checks(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert learning.training_table(df, "b")[1] == ["a"]
    for bad in ("c", "zzz"):
        with pytest.raises(DataError):
            learning.training_table(df, bad)
    with pytest.raises(DataError):
        learning.training_table(df.select("b"), "b")


@pytest.mark.filterwarnings("ignore")
def test_study(spark):
    df, names = regression(spark, 200)
    df = df.withColumn("kind", F.when(F.col("f2") > 0, 1).otherwise(0))
    spec = RunSpec("id", names, {"target": "regression", "kind": "classification"}, ("random_forest", "gradient_boosting"), n_features=6,
                   hyperparameters={m: {"n_estimators": 3, "max_depth": 3} for m in learning.MODEL_TYPES})
    out = new_path(spark, "study")
    r = run_study(df, spec, out)
    assert r.metrics.count() == 2 * (5 + 4) and r.best.count() == 2
    n_test = split(df, "id", 0.2, 0.2).where("split = 'test'").count()
    assert r.attributions.count() == n_test * 6
    report = json.loads(spark.read.text(f"{out}/metrics").first()["value"])
    assert report["n_rows"] == 200 and report["n_features"] == 6 and "target_random_forest" in report["metrics"]
    loaded = learning.ModelBundle.load(spark, r.paths["kind_random_forest"])
    assert len(loaded.feature_names) == 6


def test_model_choice(spark):
    rows = [("t", "random_forest", "r2", 0.5), ("t", "xgboost", "r2", 0.7), ("t", "gradient_boosting", "r2", 0.7), ("u", "random_forest", "r2", -1.0), ("u", "xgboost", "mae", 9.0)]
    best = {r["target"]: r["model_type"] for r in ranking.best_model(spark.createDataFrame(rows, "target string, model_type string, metric string, value double"), "r2").collect()}
    assert best == {"t": "gradient_boosting", "u": "random_forest"}


def test_learning_curve(spark):
    df, names = regression(spark, 300)
    t = learning.ModelTrainer("random_forest", "regression", SMALL)
    out = evaluation.learning_curve_summary(learning.learning_curve(t, df.where("id < 200"), df.where("id >= 200"), names, "target", "id", (0.3, 1.0)))
    assert out.where("train_size = 200").count() == 2
    assert all(30 < r["train_size"] < 90 for r in out.where("train_size < 200").collect())


def test_class_forest_after_observed_metric(spark):
    """What the session has done before does not reach the tasks with the model."""
    df, names = classes(spark)
    df.observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    b = learning.ModelTrainer("random_forest", "classification", SMALL).train(df, names, "target")
    assert b.predict(df).count() == df.count() and b.metrics["accuracy"] > 0.7
    assert not b.model.stages[-1].hasSummary
