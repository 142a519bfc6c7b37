"""Attributions with one row for each explained row: ``key, x, phi``, two arrays in the order of the features' names.

Rankings and pairs of features are made inside the arrays, so nothing is shuffled for a row's own explanation; the long form
appears only where rows are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propspark.functions import moments
from propspark.operators.quantiles import edges_upto, exact_quantiles, literal_edges


def _names(names: Sequence[str]) -> Column:
    return F.lit(list(names))


def to_long_form(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """``key, feature, feature_value, shap``."""
    return rows.select(key, F.inline(F.arrays_zip(_names(names).alias("feature"), F.col("x").alias("feature_value"), F.col("phi").alias("shap"))))


def importance(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature, mean_shap``: mean absolute attribution."""
    cells = rows.select(F.posexplode("phi").alias("i", "v"))
    sums = cells.groupBy("i").agg(F.avg(F.abs("v")).alias("mean_shap"))
    return sums.select(F.get(_names(names), F.col("i")).alias("feature"), "mean_shap")


def top_contributions(names: Sequence[str], n: int = 20) -> Column:
    """Array of the ``n`` largest contributions of a row by absolute value, ties by name: ``feature, value, shap``."""
    cells = F.transform(F.col("phi"), lambda v, i: F.struct(
        (-F.abs(v)).alias("order"), F.get(_names(names), i).alias("feature"), F.get(F.col("x"), i).alias("value"), v.alias("shap")))
    return F.transform(F.slice(F.array_sort(cells), 1, n), lambda c: F.struct(c["feature"], c["value"].alias("feature_value"), c["shap"]))


def local_explanation(rows: DataFrame, key: str, names: Sequence[str], base: float, n: int = 20) -> DataFrame:
    """Top contributions of every row with rank, direction and the running sum from the base value."""
    top = rows.select(key, top_contributions(names, n).alias("top"))
    step = F.aggregate(
        "top", F.struct(F.lit(float(base)).alias("sum"), F.array().cast("array<double>").alias("sums")),
        lambda acc, c: F.struct((acc["sum"] + c["shap"]).alias("sum"), F.array_append(acc["sums"], acc["sum"] + c["shap"]).alias("sums")),
        lambda acc: acc["sums"])
    cells = F.transform(F.arrays_zip(F.col("top").alias("c"), step.alias("running")), lambda z, i: F.struct(
        z["c"]["feature"].alias("feature"), z["c"]["feature_value"].alias("feature_value"), z["c"]["shap"].alias("shap"), (i + 1).alias("rank"),
        F.when(z["c"]["shap"] > 0, "increases").otherwise("decreases").alias("direction"), z["running"].alias("running")))
    return top.select(key, F.inline(cells))


def interaction_strength(rows: DataFrame, names: Sequence[str], feature: str, bins: int = 10) -> DataFrame:
    """``feature, strength`` of every other feature: over quantile bins of ``feature``, the sum of the absolute correlations
    between its attribution and the other feature's value. One shuffle, of a short row for each bin and feature.
    """
    at = list(names).index(feature)
    main = F.get("x", F.lit(at))
    q = exact_quantiles(rows.select(F.lit(feature).alias("feature"), main.alias("value")), [i / bins for i in range(1, bins)])
    if feature not in q:
        return rows.sparkSession.createDataFrame([], "feature string, strength double")
    cells = rows.select(edges_upto(main, literal_edges(q[feature])).alias("bin"), F.get("phi", F.lit(at)).alias("s"), F.posexplode("x").alias("i", "v"))
    per_bin = cells.where(F.col("i") != at).groupBy("i", "bin").agg(moments.correlation(F.col("v"), F.col("s")).alias("r"))
    sums = per_bin.groupBy("i").agg(F.sum(F.abs(F.coalesce("r", F.lit(0.0)))).alias("strength"))
    return sums.select(F.get(_names(names), F.col("i")).alias("feature"), "strength")


def dependence(rows: DataFrame, key: str, names: Sequence[str], feature: str, interaction: str | None = None) -> DataFrame:
    """``key, feature_value, shap, interaction, interaction_value`` of one feature and the one that goes with it most."""
    if interaction is None:
        best = interaction_strength(rows, names, feature).orderBy(F.desc("strength"), "feature").first()
        interaction = best["feature"] if best else feature
    i, j = list(names).index(feature), list(names).index(interaction)
    return rows.select(key, F.get("x", F.lit(i)).alias("feature_value"), F.get("phi", F.lit(i)).alias("shap"),
                       F.lit(interaction).alias("interaction"), F.get("x", F.lit(j)).alias("interaction_value"))


def report(rows: DataFrame, key: str, names: Sequence[str], base: float, out: str, n: int = 20, dependence_n: int = 5) -> dict[str, str]:
    """Write the importance, the first row's explanation and the dependence of the top features below ``out``; their paths.

    The rows are written once beside them, so an expensive source is evaluated a single time.
    """
    rows.select(key, "x", "phi").write.parquet(f"{out}/attributions")
    rows = rows.sparkSession.read.parquet(f"{out}/attributions")
    paths = {"global": f"{out}/importance", "local": f"{out}/local"}
    table = importance(rows, names).orderBy(F.desc("mean_shap"), "feature")
    table.coalesce(1).write.option("header", True).csv(paths["global"])
    first = rows.agg(F.min(key)).first()[0]
    local_explanation(rows.where(F.col(key) == first), key, names, base, n).write.parquet(paths["local"])
    for r in table.limit(dependence_n).collect():
        paths[f"dependence_{r.feature}"] = f"{out}/dependence/{r.feature}"
        dependence(rows, key, names, r.feature).write.parquet(paths[f"dependence_{r.feature}"])
    return paths
