"""How many predictions the estimates ask for, and that the values stay those of all walks and coalitions."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from propspark.operators import attribution, learning


class Product:
    """A model that keeps the tables it scores: 3 a + 5 b + 2 a b."""

    def __init__(self):
        self.tables = []

    def transform(self, df):
        self.tables.append(df)
        v = vector_to_array("features")
        return df.withColumn("prediction", 3 * v[0] + 5 * v[1] + 2 * v[0] * v[1])


def bundle():
    return learning.ModelBundle("y", "any", "any", "regression", ["a", "b"], Product())


def frame(spark, n=40):
    return spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("double").alias("b"))


def check(got, df, bank, tolerance):
    def f(a, b):
        return 3 * a + 5 * b + 2 * a * b

    found = {(r.id, r.feature): r.shap for r in got.collect()}
    rows = df.collect()
    assert len(found) == 2 * len(rows)
    for r in rows:
        each = [((f(r.a, z.b) - f(z.a, z.b) + f(r.a, r.b) - f(z.a, r.b)) / 2, (f(z.a, r.b) - f(z.a, z.b) + f(r.a, r.b) - f(r.a, z.b)) / 2) for z in bank]
        want = np.mean(each, axis=0)
        np.testing.assert_allclose([found[r.id, "a"], found[r.id, "b"]], want, atol=tolerance)


def test_few_walks_are_walked_once(spark):
    df, b = frame(spark), bundle()
    one = df.where("id = 7")
    got = attribution.sampled_shap(df, "id", b, one, "id", background_rows=1)
    check(got, df, one.collect(), 0.6)  # orders are drawn
    scored, = b.model.tables
    assert scored.count() <= 40 * 2 * 3
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_many_walks(spark):
    """More possible walks than samples: every sample is a walk of its own."""
    df, b = frame(spark), bundle()
    got = attribution.sampled_shap(df, "id", b, df, "id", background_rows=20, samples=10)
    assert b.model.tables[0].count() == 40 * 10 * 3 and got.count() == 80


def test_equal_mixes_are_predicted_once(spark):
    df, b = frame(spark), bundle()
    got = attribution.kernel_shap(df, "id", b, df, "id", background_rows=40)
    check(got, df, df.collect(), 1e-9)
    assert sum(t.count() for t in b.model.tables) == 40 + 40 * (1 + 2 + 2)


def test_more_features_than_samples(spark):
    """Orders are far too many to list, however few the samples and background rows are."""
    names = ["a", "b"] + [f"c{i}" for i in range(10)]
    df = frame(spark).select("id", "a", "b", *[F.lit(float(i)).alias(n) for i, n in enumerate(names[2:])])
    b = learning.ModelBundle("y", "any", "any", "regression", names, Product())
    got = attribution.sampled_shap(df, "id", b, df, "id", background_rows=1, samples=1)
    assert b.model.tables[0].count() == 40 * 13 and got.count() == 40 * 12
