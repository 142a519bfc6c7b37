from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propspark.errors import DataError
from propspark.operators import attribution, learning, ranking, tree_shap
from propspark.operators.split_scale import fit_scaler
from propspark.session import new_path

NAMES = ["a", "b", "c"]


def frame(spark, n=120):
    rng = np.random.default_rng(11)
    f = pd.DataFrame(rng.normal(size=(n, 3)), columns=NAMES)
    f["y"] = np.where(f["a"] > 0, 2 * f["b"], -1.0) + 0.3 * f["c"]
    f["k"] = (f["y"] > 0).astype(int) + (f["y"] > 1).astype(int)
    f["id"] = range(n)
    return f, spark.createDataFrame(f)


def subset_value(nodes, shares, label, x, known):
    """Expected tree output when only the known features are followed; others split by cover."""
    def cover(n):
        s = n["impurityStats"]
        return sum(s) if shares else s[0]

    def walk(i):
        n = nodes[i]
        if n["leftChild"] < 0:
            return n["impurityStats"][label] / sum(n["impurityStats"]) if shares else n["prediction"]
        f, t = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return walk(n["leftChild"] if x[f] <= t else n["rightChild"])
        l, r = nodes[n["leftChild"]], nodes[n["rightChild"]]
        return (cover(l) * walk(n["leftChild"]) + cover(r) * walk(n["rightChild"])) / cover(n)

    return walk(0)


def saved_nodes(spark, model):
    path = new_path(spark, "nodes")
    model.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return trees, list(model.treeWeights)


def brute_force(spark, model, x, label=None):
    trees, weights = saved_nodes(spark, model)
    shares = label is not None
    forest = "RandomForest" in type(model).__name__
    p = len(x)
    phi = np.zeros(p)
    for t, nodes in trees.items():
        w = 1 / len(trees) if forest else weights[t]
        for j in range(p):
            rest = [i for i in range(p) if i != j]
            for size in range(p):
                for s in combinations(rest, size):
                    share = factorial(size) * factorial(p - size - 1) / factorial(p)
                    phi[j] += w * share * (subset_value(nodes, shares, label, x, {*s, j}) - subset_value(nodes, shares, label, x, set(s)))
    return phi


@pytest.mark.parametrize("model, kind, target, label", [
    ("random_forest", "regression", "y", None), ("gradient_boosting", "regression", "y", None), ("random_forest", "classification", "k", 2)])
def test_tree_shap_is_exact_and_additive(spark, model, kind, target, label):
    f, df = frame(spark)
    b = learning.ModelTrainer(model, kind, {"n_estimators": 4, "max_depth": 4}).train(df, NAMES, target)
    long, base = attribution.tree_shap(df, "id", b, label)
    got = long.toPandas().pivot(index="id", columns="feature", values="shap")[NAMES]
    for i in (0, 7, 50):
        np.testing.assert_allclose(got.loc[i], brute_force(spark, b.model.stages[-1], f.loc[i, NAMES].to_numpy(float), label), atol=1e-10)
    if kind == "regression":
        pred = b.predict(df, "p").toPandas().set_index("id")["p"]
        np.testing.assert_allclose(got.sum(axis=1) + base, pred.loc[got.index], atol=1e-9)
    else:
        from pyspark.ml.functions import vector_to_array
        prob = b.model.transform(learning.assemble(df, NAMES)).select("id", vector_to_array("probability")[label].alias("p")).toPandas().set_index("id")["p"]
        np.testing.assert_allclose(got.sum(axis=1) + base, prob.loc[got.index], atol=1e-9)


@pytest.mark.filterwarnings("ignore")
def test_tree_shap_one_vs_rest_and_scaler(spark):
    _, df = frame(spark)
    b = learning.ModelTrainer("gradient_boosting", "classification", {"n_estimators": 3, "max_depth": 2}).train(df, NAMES, "k", scaler=fit_scaler(df, NAMES))
    long, _ = attribution.tree_shap(df, "id", b, label=2)
    assert long.count() == 360 and long.where("isnan(shap)").count() == 0


def test_deep_trees_in_groups(spark):
    """Paths that test a feature many times, and trees that do not fit one group."""
    f, df = frame(spark, 400)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 6, "max_depth": 12, "min_samples_leaf": 1}).train(df, NAMES, "y")
    trees = tree_shap.flat_trees(spark, b.model.stages[-1])
    rows = df.select("id", F.array(*[F.col(n) for n in NAMES]).alias("x"))
    most = max(r.nodes for r in trees.collect())
    assert len(tree_shap._groups([(r.tree, r.nodes) for r in trees.collect()], most)) > 3
    some, base = tree_shap.add_tree_values(rows, trees, group_nodes=most)
    got = {r.id: r.phi for r in some.collect()}
    whole = {r.id: r.phi for r in tree_shap.add_tree_values(rows, trees)[0].collect()}
    pred = b.predict(df, "p").toPandas().set_index("id")["p"]
    for i in range(400):
        np.testing.assert_allclose(got[i], whole[i], atol=1e-12)
        assert abs(sum(got[i]) + base - pred[i]) < 1e-9
    for i in (3, 200):
        np.testing.assert_allclose(got[i], brute_force(spark, b.model.stages[-1], f.loc[i, NAMES].to_numpy(float)), atol=1e-10)


def test_a_single_leaf(spark):
    _, df = frame(spark, 30)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 2, "max_depth": 3}).train(df.withColumn("y", F.lit(2.5)), NAMES, "y")
    long, base = attribution.tree_shap(df, "id", b)
    assert base == pytest.approx(2.5) and {r.shap for r in long.collect()} == {0.0}
    assert attribution.tree_shap(df.limit(0), "id", b)[0].count() == 0


def test_not_a_tree(spark):
    with pytest.raises(DataError):
        tree_shap.flat_trees(spark, object())


def test_sampled_shap_adds_up(spark):
    f, df = frame(spark, 40)
    b = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 4, "max_depth": 3}).train(df, NAMES, "y", scaler=fit_scaler(df, NAMES))
    zero = df.where("id = 0")  # one background row: the sum is exactly the difference of two predictions
    out = attribution.sampled_shap(df, "id", b, zero, "id", samples=6)
    total = out.groupBy("id").agg(F.sum("shap").alias("s")).toPandas().set_index("id")["s"]
    pred = b.predict(df, "p").toPandas().set_index("id")["p"]
    np.testing.assert_allclose(total.sort_index(), (pred - pred[0]).sort_index(), atol=1e-9)
    again = attribution.sampled_shap(df.repartition(5), "id", b, zero, "id", samples=6).toPandas().sort_values(["id", "feature"])
    np.testing.assert_allclose(again["shap"], out.toPandas().sort_values(["id", "feature"])["shap"], atol=1e-12)


def long_table(spark):
    rows = [(1, "a", 1.0, 0.5), (1, "b", 2.0, -2.0), (1, "c", 3.0, 0.0), (2, "a", 4.0, 1.5), (2, "b", 5.0, 1.0), (2, "c", 6.0, -0.25)]
    return spark.createDataFrame(rows, "id long, feature string, feature_value double, shap double")


def test_tables(spark):
    long = long_table(spark)
    g = {r["feature"]: r["mean_shap"] for r in attribution.global_importance(long).collect()}
    assert g == {"a": 1.0, "b": 1.5, "c": 0.125}
    assert attribution.top_feature_names(long, 2) == ["b", "a"]
    local = attribution.local_explanation(long, "id", 10.0, 2).orderBy("id", "rank").collect()
    assert [(r["feature"], r["direction"], r["running"]) for r in local] == [
        ("b", "decreases", 8.0), ("a", "increases", 8.5), ("a", "increases", 11.5), ("b", "increases", 12.5)]
    share = ranking.contribution_share(attribution.global_importance(long), numerator_n=1, denominator_n=2).first()
    assert share["share_pct"] == pytest.approx(60.0) and share["most_important"] == "b"
    assert ranking.top_per_row(long, "id", 1).count() == 2


def test_dependence_and_report(spark):
    long = long_table(spark)
    d = attribution.dependence(long, "id", "a", "c").orderBy("id").collect()
    assert [(r["feature_value"], r["shap"], r["interaction_value"]) for r in d] == [(1.0, 0.5, 3.0), (4.0, 1.5, 6.0)]
    paths = attribution.explanation_report(long, "id", 0.0, new_path(spark, "report"), dependence_n=2)
    assert set(paths) == {"global", "local", "dependence_a", "dependence_b"}
    assert spark.read.parquet(paths["local"]).count() == 3


def random_tree(rng, features, depth):
    """Nodes of a random tree that tests features again and again, some thresholds twice."""
    rows = []

    def grow(cover, level):
        i = len(rows)
        rows.append(None)
        if level == depth or cover < 2 or rng.random() < 0.05:
            rows[i] = (i, -1, -1, -1, 0.0, float(cover), rng.normal())
            return i
        part = int(rng.integers(1, cover))
        left, right = grow(part, level + 1), grow(cover - part, level + 1)
        rows[i] = (i, left, right, int(rng.integers(features)) * 2, round(rng.normal(), 1), float(cover), 0.0)
        return i

    grow(5000, 0)
    return tree_shap.flatten(pd.DataFrame(rows, columns=["id", "left", "right", "feature", "cut", "cover", "value"]))[0]


def test_tables_of_tree_values(spark):
    """Rows of trees over few features look up sums over all leaves; wider trees visit their leaves."""
    rng = np.random.default_rng(5)
    for features in (1, 2, 4):
        trees = [random_tree(rng, features, 9) for _ in range(3)]
        x = rng.normal(size=(300, 8)).round(1)
        expected, got = np.zeros_like(x), np.zeros_like(x)
        for t in trees:
            tree_shap.tree_values(t, x, expected)
        tree_shap.Tables.fitting(trees).add(x, got)
        np.testing.assert_allclose(got, expected, atol=1e-9)
    assert tree_shap.Tables.fitting([random_tree(rng, 30, 9)]) is None
    assert tree_shap.Tables.fitting([random_tree(rng, 3, 0)]) is None
