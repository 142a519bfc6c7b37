import numpy as np
import pandas as pd
import pytest

from propspark.errors import DataError
from propspark.operators import selection


def frame(spark, n=300):
    rng = np.random.default_rng(8)
    f = pd.DataFrame({f"f{i}": rng.normal(size=n) for i in range(6)})
    f["flat"] = 1.0
    f["copy"] = f["f1"] * -3 + 0.5
    f["y"] = 3 * f["f0"] + 2 * f["f1"] + rng.normal(size=n) * 0.1
    f["label"] = (f["f2"] > 0).astype(int) + (f["f2"] > 1).astype(int)
    return f, spark.createDataFrame(f)


NAMES = [f"f{i}" for i in range(6)] + ["flat", "copy"]


def test_unknown_method_and_missing_target(spark):
    with pytest.raises(ValueError):
        selection.FeatureSelector("luck")
    for m in selection.NEEDS_TARGET:
        with pytest.raises(DataError):
            selection.FeatureSelector(m).fit(frame(spark)[1], NAMES)


def test_variance_and_correlation(spark):
    _, df = frame(spark)
    assert "flat" not in selection.FeatureSelector("variance").fit(df, NAMES).selected
    kept = selection.FeatureSelector("correlation").fit(df, NAMES).selected
    assert "f1" in kept and "copy" not in kept and "flat" in kept  # an undefined correlation never drops
    assert selection.FeatureSelector("correlation", correlation_threshold=0.0).fit(df, ["f0", "f1", "f2"]).selected == ["f0"]


def test_correlation_counts_dropped_columns(spark):
    """A column goes when any earlier one correlates, even one that was dropped itself."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=4000)
    f = pd.DataFrame({"a": a, "b": a + 0.3 * rng.normal(size=4000)})
    f["c"] = f["b"] + 0.3 * rng.normal(size=4000)
    r = f.corr()
    t = (abs(r.loc["a", "c"]) + min(abs(r.loc["a", "b"]), abs(r.loc["b", "c"]))) / 2
    assert selection.keep_uncorrelated(spark.createDataFrame(f), ["a", "b", "c"], t) == ["a"]


def test_f_regression(spark):
    f, df = frame(spark)
    got = {r["feature"]: r["score"] for r in selection.f_statistic(df, ["f0", "f1", "f5"], "y").collect()}
    for c in got:
        r2 = np.corrcoef(f[c], f["y"])[0, 1] ** 2
        assert got[c] == pytest.approx(r2 / (1 - r2) * (len(f) - 2))


def test_f_classes(spark):
    f, df = frame(spark)
    got = {r["feature"]: r["score"] for r in selection.f_statistic(df, ["f2", "f3"], "label", "classification").collect()}
    for c in got:
        groups = [g[c].to_numpy() for _, g in f.groupby("label")]
        between = sum(len(g) * (g.mean() - f[c].mean()) ** 2 for g in groups) / (len(groups) - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(f) - len(groups))
        assert got[c] == pytest.approx(between / within)


def test_selected_in_column_order(spark):
    _, df = frame(spark)
    for method in ("mutual_info", "f_statistic"):
        m = selection.FeatureSelector(method, 2).fit(df, ["f5", "f1", "f4", "f0"], "y")
        assert m.selected == ["f1", "f0"]
        assert m.score_table(spark).count() == 4
    m = selection.FeatureSelector("combined", 2).fit(df, NAMES, "y")
    assert m.selected == ["f0", "f1"]
    assert m.transform(df, ["y"]).columns == ["y", "f0", "f1"]
    assert len(selection.FeatureSelector("combined", 2).fit(df, NAMES).selected) == 6  # no target: no scoring step


def test_mutual_information_of_a_copy_is_entropy(spark):
    f, df = frame(spark)
    score = selection.mutual_information(df, ["label"], "label", "classification", 10, "width").first()["score"]
    p = f["label"].value_counts(normalize=True)
    assert score == pytest.approx(-(p * np.log(p)).sum())


def test_rfe(spark):
    _, df = frame(spark)
    m = selection.FeatureSelector("rfe", 2).fit(df, [f"f{i}" for i in range(6)], "y")
    assert set(m.selected) == {"f0", "f1"}
    ranking = {f: r for f, r, _ in m.ranking}
    assert len(ranking) == 6 and ranking["f0"] == 0 and max(ranking.values()) == 4


def test_pca_against_numpy(spark):
    f, df = frame(spark)
    names = [f"f{i}" for i in range(6)] + ["copy"]
    m = selection.fit_pca(df.withColumnRenamed("y", "id"), names, 3)
    z = ((f[names] - f[names].mean()) / f[names].std(ddof=0)).to_numpy()
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    order = values.argsort()[::-1][:3]
    np.testing.assert_allclose(m.explained, values[order] / len(names), atol=1e-9)
    loadings = vectors[:, order]
    size = np.abs(loadings)  # "copy" ties with its original: the first of equal loadings decides
    loadings *= np.sign(loadings[(size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0), range(3)])
    got = m.transform(df.withColumnRenamed("y", "id"), ["id"]).toPandas().set_index("id").loc[f["y"]]
    np.testing.assert_allclose(got[["PC_1", "PC_2", "PC_3"]].to_numpy(), z @ loadings, atol=1e-8)


def test_pca_auto_components_and_stored_scaling(spark):
    f, df = frame(spark)
    names = [f"f{i}" for i in range(6)]
    sel = selection.FeatureSelector("pca").fit(df, names)
    z = ((f[names] - f[names].mean()) / f[names].std(ddof=0)).to_numpy()
    share = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1].cumsum() / len(names)
    assert len(sel.selected) == int(np.argmax(share >= 0.95)) + 1
    whole = sel.transform(df, ["y"]).toPandas().set_index("y")
    part = sel.transform(df.limit(5), ["y"]).toPandas().set_index("y")
    np.testing.assert_allclose(whole.loc[part.index].to_numpy(), part.to_numpy())


def test_many_columns_with_gaps_are_judged_where_the_pairs_are(spark):
    """500 columns, every tenth a copy of an earlier one with gaps: what comes back is a number for each dropped column."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 500))
    for j in range(9, 500, 10):
        x[:, j] = 2 * x[:, j - 5] + 1
        x[rng.choice(60, 5, replace=False), j] = np.nan
    names = [f"c{i:03d}" for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(7)
    assert selection.keep_uncorrelated(df, names, 0.999) == [c for i, c in enumerate(names) if i % 10 != 9]


def test_components_kept_are_the_first_of_all(spark):
    rng = np.random.default_rng(13)
    f = pd.DataFrame(rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)), columns=list("abcdef"))
    df = spark.createDataFrame(f)
    whole, part = selection.fit_pca(df, list("abcdef"), k=6), selection.fit_pca(df, list("abcdef"), variance_ratio=0.8)
    k = len(part.names)
    assert 0 < k < 6 and part.model.getK() == k
    got = part.transform(df).toPandas().to_numpy()
    np.testing.assert_allclose(got, whole.transform(df).toPandas().to_numpy()[:, :k], atol=1e-9)
