import numpy as np
import pandas as pd
import pytest

from propspark.errors import DataError
from propspark.operators import cleaning, profile

SCHEMA = "cid long, a double, b int, s string"
ROWS = [(1, 1.0, 1, "x"), (1, 1.0, 1, "x"), (2, None, 2, "y"), (3, 3.0, None, None), (4, float("nan"), 5, "y"), (5, 100.0, 4, "x")]


def test_required_columns(spark):
    with pytest.raises(DataError):
        cleaning.clean(spark.createDataFrame(ROWS, SCHEMA), ["cid", "nope"])


def test_bad_options(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for kw in ({"handle_missing": "guess"}, {"outlier_method": "magic"}):
        with pytest.raises(ValueError):
            cleaning.clean(df, **kw)


def test_impute(spark):
    out = cleaning.clean(spark.createDataFrame(ROWS, SCHEMA), outlier_method=None)
    got = {r["cid"]: r for r in out.collect()}
    assert len(got) == out.count() == 5
    assert got[2]["a"] == got[4]["a"] == 3.0  # median of 1, 3, 100
    assert got[3]["b"] == 3.0  # median of 1, 2, 5, 4
    assert got[3]["s"] == "x"  # x and y tie: the smaller one


def test_drop(spark):
    out = cleaning.clean(spark.createDataFrame(ROWS, SCHEMA), handle_missing="drop", outlier_method=None)
    assert sorted(r["cid"] for r in out.collect()) == [1, 5]


def test_array_column_survives_dedup(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (1, ["b"])], "cid long, names array<string>")
    assert cleaning.clean(df, outlier_method=None).count() == 2


def sequential(frame, columns, t):
    for c in columns:
        q1, q3 = frame[c].quantile([0.25, 0.75])
        frame = frame[(frame[c] >= q1 - t * (q3 - q1)) & (frame[c] <= q3 + t * (q3 - q1))]
    return frame


@pytest.mark.parametrize("parts", [1, 9])
def test_sequential_iqr(spark, parts):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"cid": range(500), "charge": rng.normal(size=500) * 9, "a": rng.normal(size=500), "b": rng.exponential(size=500)})
    out = cleaning.remove_outliers_iqr(spark.createDataFrame(f).repartition(parts), threshold=0.7)
    assert sorted(r["cid"] for r in out.collect()) == sequential(f, ["a", "b"], 0.7)["cid"].tolist()


def test_zscore_and_constant_column(spark):
    f = pd.DataFrame({"a": [1.0] * 20 + [50.0], "k": [7.0] * 21})
    out = cleaning.remove_outliers_zscore(spark.createDataFrame(f))
    assert out.count() == 20


def test_all_missing_column_leaves_nothing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert cleaning.remove_outliers_iqr(df).count() == 0


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, pos int, v string")
    assert sorted(r["v"] for r in cleaning.dedup_by_key(df, ["k"], ["pos"]).collect()) == ["a", "c"]


def test_non_finite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,), (None,)], "v double")
    assert [r["v"] for r in cleaning.non_finite_to_zero(df).collect()] == [0.0, 0.0, 0.0, 1.5, None]


def test_correlations_pairwise_and_gramian_agree(spark):
    rng = np.random.default_rng(3)
    f = pd.DataFrame(rng.normal(size=(200, 40)), columns=[f"c{i}" for i in range(40)])
    f["c7"] = f["c3"] * 2 + 1
    got = profile.correlations(spark.createDataFrame(f), list(f))
    np.testing.assert_allclose(got, f.corr(), atol=1e-9)
    table = profile.correlation_table(spark.createDataFrame(f))
    assert table.count() == 780 and table.where("f1 = 'c7' AND f2 = 'c3'").first()["r"] == pytest.approx(1.0)
    f.loc[::5, "c1"] = np.nan
    np.testing.assert_allclose(profile.correlations(spark.createDataFrame(f), list(f)), f.corr(), atol=1e-9)
    f["flat"] = 2.0
    few = profile.correlation_table(spark.createDataFrame(f[["c0", "flat"]])).first()
    assert few["r"] is None
