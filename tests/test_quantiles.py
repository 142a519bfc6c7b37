import numpy as np
import pandas as pd
import pytest

from propspark.operators import cleaning, profile, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def numbers(kind, n=20_000):
    rng = np.random.default_rng(5)
    if kind == "normal":
        return rng.normal(size=n)
    if kind == "hot":  # one value holds most of the rows
        return np.where(rng.random(n) < 0.7, 3.0, rng.normal(size=n) * 100)
    if kind == "heavy":  # wildly different magnitudes
        return np.exp(rng.normal(size=n) * 40)
    if kind == "constant":
        return np.full(n, -2.5)
    if kind == "integers":
        return rng.integers(0, 7, n).astype(float)
    return np.sort(rng.random(n))


@pytest.mark.parametrize("kind", ["normal", "hot", "heavy", "constant", "integers", "sorted"])
@pytest.mark.parametrize("budget", [1 << 18, 300])
def test_matches_numpy(spark, kind, budget):
    x = numbers(kind)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(7)
    got = quantiles.column_quantiles(df, ["x"], PROBS, budget)["x"]
    np.testing.assert_allclose(got, np.quantile(x, PROBS), rtol=1e-12)


def test_narrowing_rounds(spark):
    """A budget far below the bracket sizes forces several rounds."""
    x = numbers("normal", 50_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x * 2}))
    got = quantiles.column_quantiles(df, ["x", "y"], [0.3, 0.5], 5)
    np.testing.assert_allclose(got["x"], np.quantile(x, [0.3, 0.5]), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile(x * 2, [0.3, 0.5]), rtol=1e-12)


def test_bad_brackets_do_not_matter(spark):
    x = numbers("normal")
    long = spark.createDataFrame(pd.DataFrame({"feature": "a", "value": x}))
    got = quantiles.order_statistics(long, {"a": [10, 9_999, 19_990]}, {"a": [50.0, 60.0]}, 200)
    s = np.sort(x)
    assert [got["a", r] for r in (10, 9_999, 19_990)] == [s[10], s[9_999], s[19_990]]


def test_missing_values_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double")
    got = quantiles.column_quantiles(df, ["a", "b"], [0.5])
    assert got == {"a": [2.0], "b": [None]}


def test_iqr_same_for_small_and_large_path(spark, monkeypatch):
    x = numbers("heavy", 5_000)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": np.log(x)}))
    want = sorted(r["a"] for r in cleaning.remove_outliers_iqr(df).collect())
    monkeypatch.setattr(quantiles.column_quantiles, "__defaults__", (100,))
    assert sorted(r["a"] for r in cleaning.remove_outliers_iqr(df).collect()) == want


def test_profile_moments(spark):
    x = pd.Series([1.0, 2.0, 3.0, 10.0, 4.0])
    row = profile.feature_stats(spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    assert row["skewness"] == pytest.approx(x.skew()) and row["kurtosis"] == pytest.approx(x.kurtosis())
    assert row["std"] == pytest.approx(x.std()) and row["q75"] == 4.0 and row["missing"] == 0


def test_profile_short_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (4.0, None, None)], "a double, b double, c double")
    got = {r["feature"]: r for r in profile.feature_stats(df).collect()}
    assert got["a"]["skewness"] is None and got["b"]["std"] is None and got["c"]["count"] == 0 and got["c"]["q50"] is None
    assert got["b"]["missing_pct"] == 50.0


def test_profile_of_constant_column(spark):
    row = profile.feature_stats(spark.createDataFrame([(2.0,)] * 6, "x double")).first()
    assert row["std"] == 0.0 and row["q25"] == 2.0 and row["skewness"] in (None, 0.0) and row["kurtosis"] is None


def test_distribution_tables(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    box = profile.box_stats(df, ["x"]).first()
    assert (box["whisker_lo"], box["whisker_hi"], box["outliers"], box["median"]) == (1.0, 4.0, 1, 3.0)
    hist = profile.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in hist] == [4, 0, 0, 1]
    flat = profile.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x", 2).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [0, 3]


def test_narrowing_adds_no_edges(spark, monkeypatch):
    """However many brackets are too full, no row is held against more edges than in the first pass."""
    long = spark.range(20_000).selectExpr("'a' AS feature", "CAST((id * 7919) % 20000 AS DOUBLE) AS value")
    ranks = [i * 2000 for i in range(1, 10)]
    edges = [float(r + s) for r in ranks for s in (-400, 400)]
    seen, with_bucket = [], quantiles._with_bucket
    monkeypatch.setattr(quantiles, "_with_bucket", lambda rows, e: (seen.append(max(map(len, e.values()))), with_bucket(rows, e))[1])
    got = quantiles.order_statistics(long, {"a": ranks}, {"a": edges}, 20)
    assert got == {("a", r): float(r) for r in ranks}
    assert len(seen) >= 3 and max(seen) == len(edges)
