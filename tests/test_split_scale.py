import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propspark.errors import DataError
from propspark.operators import split_scale


@pytest.mark.parametrize("n", [10, 101, 5000])
def test_exact_sizes(spark, n):
    out = split_scale.split(spark.range(n), "id", 0.2, 0.1, exact=True)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    test = math.ceil(n * 0.2)
    val = math.ceil((n - test) * (0.1 / (1 - 0.2)))
    assert got == {"test": test, "val": val, "train": n - test - val}


def test_exact_split_needs_unique_keys(spark):
    same = spark.range(50).select((F.col("id") * 0).alias("id"))
    with pytest.raises(DataError):
        split_scale.split(same, "id", exact=True)
    assert split_scale.split(same.limit(0), "id", exact=True).count() == 0


def test_split_does_not_depend_on_partitions(spark):
    a, b = (split_scale.split(spark.range(3000).repartition(p), "id") for p in (1, 13))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    other = split_scale.split(spark.range(3000), "id", seed=7)
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, other.collect()))


def frame(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"id": range(400), "a": rng.normal(5, 3, 400), "b": rng.exponential(2, 400), "k": 1.5})
    return f, split_scale.split(spark.createDataFrame(f), "id")


@pytest.mark.parametrize("kind", split_scale.SCALERS)
def test_scalers(spark, kind):
    f, df = frame(spark)
    train = df.where("split = 'train'").toPandas()
    out, scaler = split_scale.scale_features(df, ["a", "b", "k"], kind)
    got = out.toPandas().sort_values("id")
    for c in ("a", "b", "k"):
        x = train[c]
        center, scale = {"standard": (x.mean(), x.std(ddof=0)), "minmax": (x.min(), x.max() - x.min()),
                         "robust": (x.median(), x.quantile(0.75) - x.quantile(0.25))}[kind]
        np.testing.assert_allclose(got[c], (f[c] - center) / (scale or 1.0), atol=1e-9)
    again, _ = split_scale.scale_features(df, ["a"], kind, scaler)
    assert again.count() == 400
    assert split_scale.Scaler.from_json(scaler.to_json()) == scaler


def test_unknown_scaler(spark):
    with pytest.raises(ValueError):
        split_scale.fit_scaler(spark.range(3), ["id"], "odd")


def test_target_round_trip(spark):
    f, df = frame(spark)
    out, scaler = split_scale.scale_targets(df, {"a": "regression", "k": "classification"})
    got = out.select("id", scaler.inverse("a", F.col("a")).alias("a"), scaler.inverse("zzz", F.col("k")).alias("k")).toPandas().sort_values("id")
    np.testing.assert_allclose(got["a"], f["a"])
    assert (got["k"] == 1.5).all() and "k" not in scaler.scale


def test_exact_split_needs_a_unique_key(spark):
    from propspark.errors import DataError
    with pytest.raises(DataError):
        split_scale.split(spark.range(9000).selectExpr("id % 2 AS id"), "id", exact=True)
