"""Sketches against exact ranks and counts, merged and in one pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propspark.operators import cleaning, profile, sketches, split_scale
from propspark.session import new_path

PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


def frame(spark, n=40_000):
    rng = np.random.default_rng(8)
    f = pd.DataFrame({"a": rng.exponential(size=n), "b": rng.integers(0, 50, n).astype(float), "id": range(n)})
    f.loc[f["id"] % 10 == 0, "a"] = np.nan
    return f, spark.createDataFrame(f).repartition(6)


def rank_errors(values, q):
    """Distance of the wanted share to the shares of values below and up to each answer."""
    low, high = np.searchsorted(np.sort(values), q), np.searchsorted(np.sort(values), q, side="right")
    return [max(0.0, lo / len(values) - p, p - hi / len(values)) for p, lo, hi in zip(PROBS, low, high)]


@pytest.mark.parametrize("accuracy", [0.02, 0.002])
def test_error_bound_in_one_pass_and_merged(spark, accuracy):
    f, df = frame(spark)
    path = new_path(spark, "state")
    sketches.build(df.where("id < 30000"), ["a", "b"], accuracy).write.parquet(path)  # kept from an earlier day
    merged = sketches.merge(spark.read.parquet(path), sketches.build(df.where("id >= 30000"), ["a", "b"], accuracy))
    for state in (sketches.build(df, ["a", "b"], accuracy), merged):
        q = sketches.quantiles(state, PROBS)
        for c in ("a", "b"):
            assert max(rank_errors(f[c].dropna().to_numpy(), q[c])) <= accuracy
        counts = {r.feature: r for r in sketches.distinct_counts(state).collect()}
        assert (counts["a"].n, counts["a"].missing, counts["b"].n) == (36_000, 4_000, 40_000)
        assert counts["a"]["distinct"] == pytest.approx(36_000, rel=0.06) and counts["b"]["distinct"] == pytest.approx(50, abs=1)


def test_empty_columns_and_sizes(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert sketches.quantiles(sketches.build(df, ["a", "b"]), [0.5])["a"] == [None]
    assert sketches.build(df.limit(0), ["a"]).count() == 0
    assert sketches.kll_size(0.01) < sketches.kll_size(0.001)
    with pytest.raises(ValueError):
        sketches.kll_size(0)


def test_accuracy_options(spark):
    f, df = frame(spark, 8000)
    values = np.sort(f["a"].dropna())
    filled = cleaning.impute(df, accuracy=0.01).where("id = 0").first()["a"]
    assert abs(np.searchsorted(values, filled) / len(values) - 0.5) <= 0.01
    scaler = split_scale.fit_scaler(df, ["a"], "robust", accuracy=0.01)
    assert abs(np.searchsorted(values, scaler.center["a"]) / len(values) - 0.5) <= 0.01
    assert profile.problem_type(df, "b", 60) == ("classification", 50) == profile.problem_type(df, "b", 60, accuracy=0.02)
    kind, estimate = profile.problem_type(df.withColumn("c", F.col("id")), "c", accuracy=0.02)
    assert kind == "regression" == profile.target_kind(df, "id") and estimate == pytest.approx(8000, rel=0.1)
