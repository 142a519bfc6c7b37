"""Shapley-value attributions and the tables built on them."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, permutations
from operator import add

from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.errors import DataError
from propspark.functions import moments
from propspark.operators.kernel_shap import kernel_shap
from propspark.operators.learning import ModelBundle, feature_array
from propspark.operators.quantiles import edges_upto, exact_quantiles, literal_edges
from propspark.operators.ranking import sort_importance, top_features, top_per_row
from propspark.operators.tree_shap import TREE_MODELS, add_tree_values, flat_trees
from propspark.session import small_table

# --- tree ensembles -------------------------------------------------------------------------


def tree_shap(df: DataFrame, key: str, bundle: ModelBundle, label: int | None = None) -> tuple[DataFrame, float]:
    """Long table ``key, feature, feature_value, shap`` for every row, and the base value.

    For one-vs-rest models ``label`` picks the booster of that class.
    """
    names = list(bundle.feature_names)
    per_row, base = tree_shap_rows(df, key, bundle, label)
    label_array = F.array(*[F.lit(n) for n in names])
    cell = F.explode(F.arrays_zip(label_array.alias("feature"), F.col("x").alias("feature_value"), F.col("phi").alias("shap")))
    return per_row.select(key, cell.alias("c")).select(
        key, F.col("c.feature").alias("feature"), F.col("c.feature_value").alias("feature_value"), F.col("c.shap").alias("shap")), base


def tree_shap_rows(df: DataFrame, key: str, bundle: ModelBundle, label: int | None = None) -> tuple[DataFrame, float]:
    """The same with one row for each row of ``df``: ``key, x, phi``, two arrays in the order of the bundle's features."""
    last = bundle.model.stages[-1]
    if isinstance(last, OneVsRestModel):
        last = last.models[label or 0]
    trees = flat_trees(df.sparkSession, last, label)
    return add_tree_values(df.select(F.col(key), feature_array(df, list(bundle.feature_names), bundle.scaler).alias("x")), trees)


# --- any model ------------------------------------------------------------------------------


def sampled_shap(df: DataFrame, key: str, bundle: ModelBundle, background: DataFrame, background_key: str,
                 background_rows: int = 100, samples: int = 100, seed: int = 42) -> DataFrame:
    """Permutation-sampling Shapley estimate for any model: ``key, feature, shap``.

    Each (row, sample) walks one feature order from a background row to the row
    itself; both are chosen by key hash. The background is the reference set of
    ``background_rows`` rows. A step adds its prediction to the feature
    switched on and takes it from the next one, so one partial aggregate per
    (row, feature) finishes the job; contributions add up to the prediction minus
    the mean background prediction of the samples. Where fewer walks exist (orders
    times background rows) than samples are drawn, equal walks of a row are walked
    once and counted.
    """
    names = list(bundle.feature_names)
    p = len(names)
    marks = background.select(
        F.md5(F.concat(F.col(background_key).cast("string"), F.lit(f"#{seed}"))).alias("_h"),
        feature_array(background, names).alias("z"))
    zs = [list(r["z"]) for r in marks.orderBy("_h").limit(background_rows).collect()]
    if not zs:
        raise DataError("background rows are required")

    # every row becomes up to samples x (features + 1) predictions: spread rows evenly first
    # (over a number that is not made smaller: the rows are few bytes before they are multiplied)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    rows = df.select(F.col(key).alias("_k"), feature_array(df, names).alias("x")).repartition(parts, F.xxhash64("_k", "x"))
    numbers = F.sequence(F.lit(0), F.lit(p - 1))

    def text(s: Column) -> Column:
        return F.concat_ws("#", F.col("_k").cast("string"), s.cast("string"), F.lit(str(seed)))

    def place(t: Column) -> Column:
        return F.pmod(F.xxhash64(t, F.lit("row")), F.lit(len(zs))).cast("int") if len(zs) > 1 else F.lit(0)

    draws = F.sequence(F.lit(0), F.lit(samples - 1))
    if math.factorial(min(p, 20)) * len(zs) <= samples:
        # fewer walks exist than samples are drawn: a row counts its samples for each walk and takes every walk once;
        # an order is known by which of each two features comes first, so no sample sorts anything
        pairs = list(combinations(range(p), 2))

        def number(t: Column) -> Column:
            later = [F.when(F.xxhash64(t, F.lit(i)) > F.xxhash64(t, F.lit(j)), 1 << k).otherwise(0) for k, (i, j) in enumerate(pairs)]
            return reduce(add, later, F.lit(0)) * len(zs) + place(t)

        ways = []
        for o in permutations(range(p)):
            way = sum(1 << k for k, (i, j) in enumerate(pairs) if o.index(i) > o.index(j))
            ways += [(way * len(zs) + b, list(o), z) for b, z in enumerate(zs)]
        # each array is bound to a name before it is used more than once
        drawn = F.transform(F.transform(draws, text), number)
        known = F.lit([w for w, _, _ in ways])
        times = F.transform(F.array(drawn), lambda d: F.transform(known, lambda w: F.struct(
            w.alias("_w"), F.size(F.filter(d, lambda e: e == w)).alias("n"))))[0]
        walks = rows.select("_k", "x", F.inline(times)).where("n > 0")
        bank = small_table(df.sparkSession, ways, _w="int", ord="array<int>", z="array<double>")
        walks = walks.join(F.broadcast(bank), "_w")  # at most `samples` rows
    else:
        bank = small_table(df.sparkSession, list(enumerate(zs)), _b="int", z="array<double>")
        walks = rows.select("_k", "x", F.explode(draws).alias("s"))
        drawn = text(F.col("s"))
        hashed = F.transform(numbers, lambda j: F.struct(F.xxhash64(drawn, j).alias("h"), j.alias("j")))
        order = F.transform(F.array_sort(hashed), lambda c: c["j"])
        walks = walks.select("_k", "x", order.alias("ord"), place(drawn).alias("_b"), F.lit(1).alias("n"))
        walks = walks.join(F.broadcast(bank), "_b")  # at most `background_rows` rows
    # place of every feature in the order: computed once per walk, before the steps multiply the rows
    rank = F.transform(numbers, lambda j: F.array_position("ord", j))
    walks = walks.select("_k", "x", "z", "n", "ord", rank.alias("rank"))
    steps = walks.select("*", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("step"))
    mixed = F.transform("x", lambda v, j: F.when(F.get("rank", j) <= F.col("step"), v).otherwise(F.get("z", j)))
    raw = steps.select("_k", "step", "n", "ord", mixed.alias("v"))
    if bundle.scaler is not None:
        centers = F.array(*[F.lit(bundle.scaler.center.get(n, 0.0)) for n in names])
        scales = F.array(*[F.lit(bundle.scaler.scale.get(n, 1.0)) for n in names])
        raw = raw.withColumn("v", F.transform("v", lambda v, j: (v - F.get(centers, j)) / F.get(scales, j)))
    scored = bundle.model.transform(raw.withColumn("features", array_to_vector("v"))).select(
        "_k", "step", "ord", (F.col("n") * F.col("prediction")).alias("d"))
    shares = F.array_compact(F.array(
        F.when(F.col("step") >= 1, F.struct(F.element_at("ord", F.greatest(F.col("step"), F.lit(1))).alias("j"), F.col("d"))),
        F.when(F.col("step") < p, F.struct(F.element_at("ord", F.least(F.col("step") + 1, F.lit(p))).alias("j"), (-F.col("d")).alias("d"))),
    ))
    sums = scored.select("_k", F.explode(shares).alias("c")).groupBy("_k", F.col("c.j").alias("j")).agg(
        (F.sum("c.d") / F.lit(float(samples))).alias("shap"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return sums.select(F.col("_k").alias(key), label.alias("feature"), "shap")


def has_tree_method(bundle: ModelBundle) -> bool:
    """Whether the model is a tree ensemble of Spark ML, so that exact attributions exist."""
    last = bundle.model.stages[-1]
    return isinstance(last.models[0] if isinstance(last, OneVsRestModel) else last, TREE_MODELS)


def explain(df: DataFrame, key: str, bundle: ModelBundle, background: DataFrame | None = None, background_key: str | None = None,
            method: str = "auto", label: int | None = None, **sizes) -> tuple[DataFrame, float | None]:
    """``key, feature, shap`` by the exact tree method or the kernel estimate, and the base value of a tree model.

    ``auto`` takes the tree method wherever the model is a tree ensemble of Spark ML and the kernel estimate for any
    other, which needs ``background`` rows.
    """
    if method not in ("auto", "tree", "kernel"):
        raise ValueError(f"unknown method: {method}")
    if method == "tree" or method == "auto" and has_tree_method(bundle):
        long, base = tree_shap(df, key, bundle, label)
        return long.select(key, "feature", "shap"), base
    if background is None:
        raise DataError("background rows are required")
    return kernel_shap(df, key, bundle, background, background_key or key, label=label, **sizes).select(key, "feature", "shap"), None


# --- tables over attributions: long(key, feature, feature_value, shap) ------------------------


def global_importance(long: DataFrame) -> DataFrame:
    """``feature, mean_shap``: mean absolute attribution."""
    return long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_shap"))


def top_feature_names(long: DataFrame, n: int = 20) -> list[str]:
    return [r["feature"] for r in top_features(global_importance(long), n, "mean_shap").collect()]


def local_explanation(long: DataFrame, key: str, base: float, n: int = 20) -> DataFrame:
    """Top contributions per row with direction and the running sum from the base value."""
    top = top_per_row(long, key, n)
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    direction = F.when(F.col("shap") > 0, "increases").otherwise("decreases")
    return top.withColumn("direction", direction).withColumn("running", F.lit(float(base)) + F.sum("shap").over(w))


def interaction_strength(long: DataFrame, key: str, feature: str, bins: int = 10) -> DataFrame:
    """How strongly every other feature goes with the attribution of ``feature``.

    Rows are binned by the feature's value at its exact quantiles; the strength is
    the sum over bins of the absolute correlation between the attribution and the
    other feature's value.
    """
    main = long.where(F.col("feature") == feature)
    q = exact_quantiles(main.select("feature", F.col("feature_value").alias("value")), [i / bins for i in range(1, bins)])
    spot = edges_upto(F.col("feature_value"), literal_edges(q[feature]))
    main = main.select(key, spot.alias("bin"), F.col("shap").alias("s"))
    others = long.where(F.col("feature") != feature).select(key, "feature", F.col("feature_value").alias("v"))
    per_bin = others.join(main, key).groupBy("feature", "bin").agg(moments.correlation(F.col("v"), F.col("s")).alias("r"))
    return per_bin.groupBy("feature").agg(F.sum(F.abs(F.coalesce("r", F.lit(0.0)))).alias("strength"))


def dependence(long: DataFrame, key: str, feature: str, interaction: str | None = None) -> DataFrame:
    """``key, feature_value, shap, interaction, interaction_value`` for one feature."""
    if interaction is None:
        best = interaction_strength(long, key, feature).orderBy(F.desc("strength"), "feature").first()
        interaction = best["feature"] if best else feature
    main = long.where(F.col("feature") == feature).select(key, "feature_value", "shap")
    other = long.where(F.col("feature") == interaction).select(key, F.col("feature_value").alias("interaction_value"))
    return main.join(other, key).withColumn("interaction", F.lit(interaction))


def explanation_report(long: DataFrame, key: str, base: float, out: str, n: int = 20, dependence_n: int = 5) -> dict[str, str]:
    """Write the global, first-row and dependence tables below ``out``; returns their paths.

    The attributions are written once beside them, so an expensive source is evaluated a single time.
    """
    long.write.parquet(f"{out}/attributions")
    long = long.sparkSession.read.schema(long.schema).parquet(f"{out}/attributions")
    paths = {"global": f"{out}/importance", "local": f"{out}/local"}
    sort_importance(global_importance(long), "mean_shap").coalesce(1).write.option("header", True).csv(paths["global"])
    first = long.agg(F.min(key)).first()[0]
    local_explanation(long.where(F.col(key) == first), key, base, n).write.parquet(paths["local"])
    for f in top_feature_names(long, dependence_n):
        paths[f"dependence_{f}"] = f"{out}/dependence/{f}"
        dependence(long, key, f).write.parquet(paths[f"dependence_{f}"])
    return paths
