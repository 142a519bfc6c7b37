"""Sequential outlier bounds over many columns, against pandas."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propspark.operators import cleaning, outlier_bounds
from propspark.session import shared_dir


def wide(spark, rows=3000, columns=64, seed=3):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({f"c{i}": rng.standard_t(4, size=rows) if i % 2 else rng.exponential(size=rows).round(2) for i in range(columns)})
    f.loc[rng.choice(rows, rows // 100, replace=False), "c5"] = np.nan
    f["id"] = range(rows)
    return f, spark.createDataFrame(f)


def left_over(f, columns, t):
    for c in columns:
        f = f[f[c].notna()]
        q1, q3 = f[c].quantile([0.25, 0.75])
        f = f[(f[c] >= q1 - t * (q3 - q1)) & (f[c] <= q3 + t * (q3 - q1))]
    return f["id"].tolist()


def files(spark):
    return sorted(x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if "narrow" in x)


def test_many_columns(spark):
    f, df = wide(spark)
    columns = [c for c in f if c != "id"]
    before = files(spark)
    bounds, scans = outlier_bounds.iqr_bounds(df, columns, 2.5)
    assert scans <= 64 + 64 / 8 and list(bounds) == columns
    assert files(spark) == before  # nothing stays behind
    out = cleaning.remove_outliers_iqr(df, columns, 2.5)
    want = left_over(f, columns, 2.5)
    assert sorted(r.id for r in out.select("id").collect()) == want and 100 < len(want) < 3000


@pytest.mark.parametrize("budget", [10, 300])
def test_brackets(spark, budget):
    """Tables that do not fit one aggregate: two scans a column, more only where a bracket is too full."""
    f, df = wide(spark, 2500, 10)
    columns = [c for c in f if c != "id"]
    small, _ = outlier_bounds.iqr_bounds(df, columns, 1.0)
    large, scans = outlier_bounds.iqr_bounds(df, columns, 1.0, budget)
    assert scans == 2 * 10 + 2
    for c in columns:
        assert large[c] == pytest.approx(small[c], abs=1e-12)


def test_nothing_left(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert outlier_bounds.iqr_bounds(df, ["a", "b"], 1.5)[0] is None
    assert cleaning.remove_outliers_iqr(df, ["a", "b"]).count() == 0
    assert cleaning.remove_outliers_iqr(df.limit(0), ["a"]).count() == 0
    assert cleaning.remove_outliers_iqr(df, []).count() == 2


def test_zscore(spark):
    f, df = wide(spark, 800, 20)
    columns = [c for c in f if c != "id"]
    found, scans = outlier_bounds.zscore_parameters(df, columns, 2.0)
    assert scans == 20 + 3
    for c in columns:
        f = f[f[c].notna()]
        assert found[c] == pytest.approx((f[c].mean(), f[c].std(ddof=0)), abs=1e-9)
        f = f[((f[c] - f[c].mean()) / f[c].std(ddof=0)).abs() < 2.0]
    out = cleaning.remove_outliers_zscore(df, columns, 2.0)
    assert sorted(r.id for r in out.select("id").collect()) == f["id"].tolist()
    assert cleaning.remove_outliers_zscore(df.withColumn("k", F.lit(3)), ["k"]).count() == 800
