"""Grid points that share fits, and their scores, against models and evaluators of Spark."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from propspark.operators import learning, tuning


def table(spark, n=300):
    rng = np.random.default_rng(2)
    f = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"])
    f["label"] = 2 * f["a"] - f["b"] ** 2 + rng.normal(scale=0.2, size=n)
    f["id"], f["fold"] = range(n), np.arange(n) % 3
    return spark.createDataFrame(f).withColumn("features", array_to_vector(F.array("a", "b", "c"))).cache()


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])


def test_boosting_prefix_is_the_shorter_model(spark):
    df = table(spark)
    whole = GBTRegressor(maxIter=6, maxDepth=3, seed=4, subsamplingRate=0.8).fit(df)
    part = tuning.tree_prefix(spark, whole, 4)
    short = GBTRegressor(maxIter=4, maxDepth=3, seed=4, subsamplingRate=0.8).fit(df)
    np.testing.assert_allclose(predictions(part, df), predictions(short, df), atol=1e-12)
    assert part.getNumTrees == 4 and part.getMaxIter() == 4


def test_forest_prefix_is_the_mean_of_its_trees(spark):
    df = table(spark)
    whole = RandomForestRegressor(numTrees=5, maxDepth=4, seed=4).fit(df)
    trees = [predictions(t, df) for t in whole.trees]
    for n in (1, 3, 5):
        np.testing.assert_allclose(predictions(tuning.tree_prefix(spark, whole, n), df), np.mean(trees[:n], axis=0), atol=1e-12)
    for wrong in (0, 6):
        with pytest.raises(ValueError):
            tuning.tree_prefix(spark, whole, wrong)
    with pytest.raises(TypeError):
        tuning.tree_prefix(spark, object(), 1)


def test_prefixes_of_classes(spark):
    df = table(spark).withColumn("label", (F.col("label") > 0).cast("double") + (F.col("label") > 1).cast("double"))
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(df)
    assert tuning.tree_prefix(spark, forest, 2).transform(df).select("prediction").distinct().count() > 1
    rest = OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=2, seed=1)).fit(df)
    short = OneVsRest(classifier=GBTClassifier(maxIter=2, maxDepth=2, seed=1)).fit(df)
    np.testing.assert_array_equal(predictions(tuning.tree_prefix(spark, rest, 2), df), predictions(short, df))


def test_points_share_fits():
    points = [{"numTrees": n, "maxDepth": d} for n in (100, 200, 300) for d in (3, 5)]
    groups = tuning.shared_fits(points)
    assert [(g["numTrees"], g["maxDepth"]) for g, _ in groups] == [(300, 3), (300, 5)]
    assert [s for _, s in groups] == [[(0, 100), (2, 200), (4, 300)], [(1, 100), (3, 200), (5, 300)]]
    assert len(tuning.shared_fits([{"maxDepth": 2}, {"maxDepth": 3}])) == 2


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_scores_are_those_of_spark(spark, kind):
    df = table(spark)
    if kind == "classification":
        df = df.withColumn("label", (F.col("label") > 0).cast("double") + (F.col("label") > 1).cast("double"))
    make = RandomForestRegressor if kind == "regression" else RandomForestClassifier
    scorer = RegressionEvaluator(metricName="r2") if kind == "regression" else MulticlassClassificationEvaluator(metricName="f1")
    points = [{"numTrees": n, "maxDepth": d} for n in (2, 4) for d in (2, 3)]
    got = tuning.grid_scores(df, points, lambda rows, p: make(seed=3, **p).fit(rows), kind, 3)
    for i in (2, 3):  # the points with the largest number of trees are fitted as they are
        each = []
        for fold in range(3):
            model = make(seed=3, **points[i]).fit(df.where(F.col("fold") != fold))
            each.append(scorer.evaluate(model.transform(df.where(F.col("fold") == fold))))
        assert got[i] == pytest.approx(np.mean(each), abs=1e-9)


def test_default_grid_needs_few_fits():
    for engine, fits in (("random_forest", 12), ("gradient_boosting", 27)):
        trainer = learning.ModelTrainer(engine)
        maps = [learning._spark_params(engine, p)[0] for p in trainer.distinct_points(learning.GRIDS[engine])]
        assert len(tuning.shared_fits(maps)) == fits and len(maps) == 3 * fits


def test_folds_of_few_groups_are_fitted_together(spark):
    """With one fit for each fold, four folds wait for each other; more fits than that never start at once."""
    df = table(spark).withColumn("fold", F.col("id") % 5)
    meet, started = threading.Barrier(4, timeout=120), []

    def fit(rows, params):
        started.append(rows)
        if len(started) <= 4:
            meet.wait()
        return RandomForestRegressor(seed=3, **params).fit(rows)

    got = tuning.grid_scores(df, [{"numTrees": 2, "maxDepth": 2}], fit, "regression", 5)
    assert len(started) == 5 and got[0] is not None
