"""Kernel estimates against Shapley values by all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from propspark.errors import DataError
from propspark.operators import attribution, kernel_shap, learning
from propspark.operators.split_scale import fit_scaler

NAMES = ["a", "b", "c", "d"]


def frame(spark, n=60):
    rng = np.random.default_rng(5)
    f = pd.DataFrame(rng.uniform(-2, 2, size=(n, 4)), columns=NAMES)
    f["y"] = np.where(f["a"] > 0, 3 * f["b"], -1.0) + 0.5 * f["c"]
    f["k"] = (f["y"] > 0).astype(int)
    f["id"] = range(n)
    return f, spark.createDataFrame(f)


def exact(values, p):
    """Shapley values of a set function given as a dict from frozensets."""
    phi = np.zeros(p)
    for j in range(p):
        for size in range(p):
            for s in combinations([i for i in range(p) if i != j], size):
                w = factorial(size) * factorial(p - size - 1) / factorial(p)
                phi[j] += w * (values[frozenset((*s, j))] - values[frozenset(s)])
    return phi


def test_all_coalitions_solve_exactly():
    rng = np.random.default_rng(0)
    for p in (1, 2, 3, 5):
        members, weights = kernel_shap.coalitions(p, 100)
        assert len(members) == 2**p - 2
        rows = [np.zeros(p), np.ones(p), *members]
        worth = rng.normal(size=len(rows))
        values = {frozenset(np.flatnonzero(m)): w for m, w in zip(rows, worth)}
        np.testing.assert_allclose(kernel_shap.solver(members, weights) @ worth, exact(values, p), atol=1e-9)


def test_drawn_coalitions():
    members, weights = kernel_shap.coalitions(12, 100)
    assert len(members) <= 100 and {tuple(1 - m) for m in members} == {tuple(m) for m in members}
    assert {1, 11} <= set(members.sum(axis=1).astype(int)) and members.sum(axis=1).max() < 12
    assert weights.sum() == pytest.approx(sum(11 / (s * (12 - s)) for s in range(1, 12)))
    linear = np.arange(12.0)  # a linear function is solved exactly by any set of coalitions that spans it
    worth = np.concatenate([[0.0, linear.sum()], members @ linear])
    np.testing.assert_allclose(kernel_shap.solver(members, weights) @ worth, linear, atol=1e-8)


@pytest.mark.parametrize("kind,target", [("regression", "y"), ("classification", "k")])
def test_against_all_subsets(spark, kind, target):
    f, df = frame(spark)
    b = learning.ModelTrainer("random_forest", kind, {"n_estimators": 4, "max_depth": 3}).train(df, NAMES, target, scaler=fit_scaler(df, NAMES))
    got = attribution.kernel_shap(df, "id", b, df.limit(20), "id").toPandas()
    bank = df.limit(20).toPandas()[NAMES].to_numpy()
    x = f.loc[9, NAMES].to_numpy(float)
    subsets = [frozenset(s) for size in range(5) for s in combinations(range(4), size)]
    mixed = np.vstack([np.where([i in s for i in range(4)], x, bank) for s in subsets])
    scored = b.model.transform(learning.assemble(spark.createDataFrame(pd.DataFrame(mixed, columns=NAMES)).coalesce(1), NAMES, b.scaler))
    out = scored.select(kernel_shap.output_of(b, None).alias("y")).toPandas()["y"].to_numpy().reshape(len(subsets), 20).mean(axis=1)
    want = exact(dict(zip(subsets, out)), 4)
    np.testing.assert_allclose(got[got.id == 9].set_index("feature")["shap"][NAMES], want, atol=1e-9)
    assert got["error"].notna().all() and (got["error"] >= 0).all() and len(got) == 240


def test_error_covers_the_background_sample(spark):
    """Estimates from 40 background rows differ from those of all rows by a few standard errors at most."""
    _, df = frame(spark, 400)
    b = learning.ModelTrainer("gradient_boosting", "regression", {"n_estimators": 5, "max_depth": 3}).train(df, NAMES, "y")
    some = df.where("id < 8")
    few = attribution.kernel_shap(some, "id", b, df, "id", background_rows=40).toPandas().set_index(["id", "feature"])
    full = attribution.kernel_shap(some, "id", b, df, "id", background_rows=400).toPandas().set_index(["id", "feature"])
    z = (few["shap"] - full["shap"]).abs() / few["error"].clip(lower=1e-6)
    assert (z < 4).mean() > 0.95


def test_dispatch(spark):
    _, df = frame(spark)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 2, "max_depth": 2}).train(df, NAMES, "y")
    tree, base = attribution.explain(df, "id", b)
    kernel, none = attribution.explain(df, "id", b, df, method="kernel", background_rows=5)
    assert base is not None and none is None and tree.columns == kernel.columns and tree.count() == kernel.count()
    with pytest.raises(DataError):
        attribution.explain(df, "id", b, method="kernel")
    with pytest.raises(ValueError):
        attribution.explain(df, "id", b, method="sampled")
