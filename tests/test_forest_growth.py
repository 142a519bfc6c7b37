import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from propspark.operators import attribution, forest_growth as fg, learning
from propspark.session import new_path

NAMES = ["a", "b", "c"]
#: Every tree sees all rows and features, so Spark ML and this library grow the same tree.
SAME = {"n_estimators": 2, "max_depth": 12, "bootstrap": False, "max_features": "all", "subsample": 1.0, "min_samples_leaf": 2}


def frame(spark, n=4000, values=20):
    rng = np.random.default_rng(5)
    f = pd.DataFrame(rng.integers(0, values, (n, 3)).astype(float), columns=NAMES)
    f["y"] = f["a"] * 3 + (f["b"] > 7) * f["c"] + rng.normal(size=n)
    f["id"] = range(n)
    return f, spark.createDataFrame(f)


def predictions(bundle, df):
    return np.array([r["prediction"] for r in bundle.predict(df).orderBy("id").collect()])


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("node_rows", [1 << 20, 1000])
def test_same_trees_as_spark(spark, monkeypatch, node_rows):
    """Grown in one task, and with nodes of more than 1,000 rows split by sums over all rows."""
    monkeypatch.setattr(fg, "NODE_ROWS", node_rows)
    f, df = frame(spark)
    trainer = learning.ModelTrainer("random_forest", "regression", SAME)
    b = trainer.train(df, NAMES, "y", key="id")
    assert isinstance(b.model.stages[-1], fg.GrownRandomForest)
    table = learning.assemble(df.withColumn("label", F.col("y")), NAMES)
    spark_model = trainer.estimator().fit(table)
    want = np.array([r["prediction"] for r in spark_model.transform(table).orderBy("id").collect()])
    np.testing.assert_allclose(predictions(b, df), want, atol=1e-9)
    assert b.metrics["rmse"] == pytest.approx(np.sqrt(np.mean((want - f["y"]) ** 2)))
    # the loaded model of Spark ML, and what it is saved as
    model = b.model.stages[-1]
    assert model._loaded is None
    assert [t.numNodes for t in model.trees] == [t.numNodes for t in spark_model.trees] and model.totalNumNodes == spark_model.totalNumNodes
    assert model.trees[0].depth == spark_model.trees[0].depth
    np.testing.assert_allclose(model.featureImportances.toArray(), spark_model.featureImportances.toArray(), atol=1e-4)
    again = learning.ModelBundle.load(spark, b.save(spark, new_path(spark, "model")))
    assert not isinstance(again.model.stages[-1], fg.GrownRandomForest)
    np.testing.assert_allclose(predictions(again, df), want, atol=1e-9)


def test_no_pass_for_each_level(spark):
    """A level more is no job more: the rows of a small node go to one task, which grows all levels below."""
    _, df = frame(spark, values=500)
    made = {d: jobs(spark, f"depth{d}", lambda: learning.ModelTrainer("random_forest", "regression", {"n_estimators": 3, "max_depth": d}).train(
        df, NAMES, "y", key="id")) for d in (10, 20)}
    assert made[10] == made[20]


def test_driver_loads_no_nodes_to_explain(spark):
    _, df = frame(spark, 500, 100)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 4}).train(df, NAMES, "y", key="id")
    rows, base = attribution.tree_shap_rows(df, "id", b)
    got = {r["id"]: base + sum(r["phi"]) for r in rows.collect()}
    np.testing.assert_allclose([got[i] for i in range(500)], predictions(b, df), atol=1e-9)
    assert b.model.stages[-1]._loaded is None


def test_trees_differ_and_learn(spark):
    f, df = frame(spark, values=300)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 6}).train(df, NAMES, "y", key="id")
    covers = [r["n"] for r in spark.read.parquet(f"{b.model.stages[-1]._saved_at}/data").where("nodeData.id = 0").select(
        F.col("nodeData.impurityStats")[0].alias("n")).collect()]
    assert len(set(covers)) > 1 and all(abs(n - 4000) < 400 for n in covers)
    spark_fit = RandomForestRegressor(numTrees=6, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42).fit(
        learning.assemble(df.withColumn("label", F.col("y")), NAMES))
    other = spark_fit.transform(learning.assemble(df, NAMES)).select(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("e")).first()["e"]
    assert b.metrics["mse"] == pytest.approx(other, rel=0.15)


def test_large_models_of_spark_are_walked(spark, monkeypatch):
    monkeypatch.setattr(fg, "WALKED", 1)
    _, df = frame(spark, 400)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 3, "max_depth": 6}).train(df, NAMES, "y", key="id")
    table = learning.assemble(df, NAMES)
    want = [r["prediction"] for r in b.model.transform(table).orderBy("id").collect()]
    assert predictions(b, df).tolist() == want
    assert hasattr(b.model.stages[-1], "_walk")


def test_what_spark_refuses(spark):
    _, df = frame(spark, 50)
    for bad in (df.withColumn("a", F.lit(float("inf"))), df.withColumn("y", F.lit(float("nan"))), df.where("id < 0")):
        with pytest.raises(Exception):
            learning.ModelTrainer("random_forest", "regression", {"n_estimators": 2}).train(bad, NAMES, "y", key="id")


def test_constant_columns_and_labels(spark):
    _, df = frame(spark, 60)
    for flat in (df.withColumn("y", F.lit(0.1)), df.withColumns({c: F.lit(2.5) for c in NAMES})):
        b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 3}).train(flat, NAMES, "y", key="id")
        assert b.model.stages[-1].totalNumNodes == 3 and len(set(predictions(b, flat).round(9))) == 1


def test_trees_that_draw_no_row(spark):
    _, df = frame(spark, 1)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 12}).train(df, NAMES, "y", key="id")
    model = b.model.stages[-1]
    assert model.totalNumNodes == 12 and [t.numNodes for t in model.trees] == [1] * 12
    y = df.first()["y"]
    assert 0 < predictions(b, df)[0] / y < 1


def test_deep_grid(spark):
    _, df = frame(spark, 300)
    b = learning.ModelTrainer("random_forest", "regression", {"min_samples_leaf": 1}, cv_folds=2).train(
        df, NAMES, "y", key="id", tune=True, grid={"n_estimators": [2, 3], "max_depth": [11]})
    assert b.best_params["n_estimators"] in (2, 3) and b.metrics["r2"] > 0.9
    assert len(b.model.stages[-1].copy().trees) == b.best_params["n_estimators"]


def test_thresholds():
    assert fg.thresholds(np.array([3.0, 1.0, 3.0, 2.0]), 31).tolist() == [1.5, 2.5]
    assert fg.thresholds(np.full(9, 4.0), 31).tolist() == []
    got = fg.thresholds(np.arange(100.0), 3)
    assert got.tolist() == [24.5, 49.5, 74.5]


def test_which_estimators():
    trainer = learning.ModelTrainer("random_forest", "regression")
    assert fg.grows(trainer.estimator())
    assert not fg.grows(trainer.estimator(max_depth=9)) and not fg.grows(trainer.estimator(n_estimators=1))
    assert not fg.grows(learning.ModelTrainer("random_forest", "classification").estimator())
    assert not fg.grows(learning.ModelTrainer("gradient_boosting").estimator(max_depth=12))


def test_weighted_rows_count_as_often(spark):
    """A row of weight three stands for three rows."""
    rng = np.random.default_rng(3)
    bins, weight, label = rng.integers(0, 6, (2, 300)).astype(np.uint8), rng.integers(1, 4, 300).astype(np.uint8), rng.normal(size=300)
    plan = fg.Plan(1, 10, 2, 2, 0, None, [np.arange(5.0)] * 2, 0.0, 1.0)
    once = fg.grow_node(bins, weight, label, plan, 10, np.random.default_rng(0))
    often = fg.grow_node(np.repeat(bins, weight, axis=1), np.ones(weight.sum(), np.uint8), np.repeat(label, weight), plan, 10, np.random.default_rng(0))
    for k in ("feature", "cut", "left"):
        assert once[k].tolist() == often[k].tolist()
    np.testing.assert_allclose(once["sums"], often["sums"])
    assert len(once["feature"]) > 20
