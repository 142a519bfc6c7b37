from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog.base import FEATURES, query, table
from catalog.modelling import INPUTS, order_study, small_forest
from catalog.profiling import SHAP_LONG, shap_long
from propspark.operators import attribution, learning, ranking, row_attribution
from propspark.session import new_path


def _additivity(df, long, base, predicted):
    """Largest gap between the prediction and base value plus attributions, over all rows."""
    total = long.groupBy("cid").agg(F.sum("shap").alias("s"))
    return predicted.join(total, "cid").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("s") - F.lit(base))).alias("max_gap"))


def _tree(model_type):
    def run(spark, sf_dir):
        df, bundle = small_forest(spark, sf_dir, model_type=model_type)
        long, base = attribution.tree_shap(df, "cid", bundle)
        return _additivity(df, long, base, bundle.predict(df, "p").select("cid", "p"))
    return run


query("tree_shap_forest")(_tree("random_forest"))
query("tree_shap_boosting")(_tree("gradient_boosting"))


@query("tree_shap_classes")
def tree_shap_classes(spark, sf_dir):
    df, bundle = small_forest(spark, sf_dir, "toxicity_category", "classification")
    long, _ = attribution.tree_shap(df, "cid", bundle, label=1)
    return ranking.sort_importance(attribution.global_importance(long), "mean_shap")


@query("tree_shap_deep", "SELECT count(*) AS n, true AS additive FROM orders")
def tree_shap_deep(spark, sf_dir):
    """Every row of the table explained by a forest of the default depth (15) and a tenth of the default trees (see the README)."""
    df = order_study(spark, sf_dir)
    bundle = learning.ModelTrainer("random_forest", "regression", {"n_estimators": 20}).train(df, INPUTS, "boiling_point", key="cid")
    rows, base = attribution.tree_shap_rows(df, "cid", bundle)
    gap = F.abs(F.col("p") - F.lit(base) - F.aggregate("phi", F.lit(0.0), lambda a, v: a + v))
    both = bundle.predict(df, "p").select("cid", "p").join(rows, "cid")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.max(gap) < 1e-6).alias("additive"))


@query("sampled_shap")
def sampled_shap(spark, sf_dir):
    df, bundle = small_forest(spark, sf_dir)
    long = attribution.sampled_shap(df, "cid", bundle, df, "cid", background_rows=20, samples=2)
    return attribution.global_importance(long)


@query("global_importance", f"WITH {SHAP_LONG} SELECT feature, round(avg(abs(shap)), 6) AS mean_shap FROM shap GROUP BY 1")
def global_importance(spark, sf_dir):
    return attribution.global_importance(shap_long(spark, sf_dir)).withColumn("mean_shap", F.round("mean_shap", 6))


@query("local_explanation", f"""WITH {SHAP_LONG}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(shap) DESC, feature) AS rank FROM shap QUALIFY rank <= 20)
  SELECT vec_id, feature, rank, CASE WHEN shap > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  round(0.5::DOUBLE + sum(shap) OVER (PARTITION BY vec_id ORDER BY rank), 5) AS running FROM t""")
def local_explanation(spark, sf_dir):
    out = attribution.local_explanation(shap_long(spark, sf_dir), "vec_id", 0.5)
    return out.select("vec_id", "feature", F.col("rank").cast("bigint").alias("rank"), "direction", F.round("running", 5).alias("running"))


STRENGTH = f"""WITH {SHAP_LONG}, m AS (SELECT vec_id, feature_value, shap FROM shap WHERE feature = 'e07'),
  q AS (SELECT quantile_cont(feature_value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM m),
  b AS (SELECT vec_id, shap AS s, feature_value, len(list_filter(e, lambda x: x <= feature_value)) AS bin FROM m, q),
  r AS (SELECT o.feature, b.bin, corr(o.feature_value, b.s) AS r FROM shap o JOIN b USING (vec_id) WHERE o.feature <> 'e07' GROUP BY 1, 2),
  st AS (SELECT feature, sum(abs(coalesce(r, 0))) AS strength FROM r GROUP BY 1)"""


@query("interaction_strength", f"{STRENGTH} SELECT feature, round(strength, 5) AS strength FROM st")
def interaction_strength(spark, sf_dir):
    return attribution.interaction_strength(shap_long(spark, sf_dir), "vec_id", "e07").withColumn("strength", F.round("strength", 5))


@query("dependence", f"""{STRENGTH}, best AS (SELECT feature FROM st ORDER BY strength DESC, feature LIMIT 1)
  SELECT m.vec_id, round(m.feature_value, 6) AS feature_value, round(m.shap, 6) AS shap, round(o.feature_value, 6) AS interaction_value, o.feature AS interaction
  FROM m JOIN shap o ON o.vec_id = m.vec_id JOIN best ON best.feature = o.feature""")
def dependence(spark, sf_dir):
    out = attribution.dependence(shap_long(spark, sf_dir), "vec_id", "e07")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("feature_value", "shap", "interaction_value")], "interaction")


# the same tables from one array for each row
def shap_rows(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rows.withColumn("phi", F.transform("x", lambda v, i: v * (i % 3 + 1)))


@query("top_contributions_rows", f"""WITH {SHAP_LONG} SELECT vec_id, feature, round(shap, 6) AS shap FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(shap) DESC, feature) AS rank FROM shap) WHERE rank <= 20""")
def top_contributions_rows(spark, sf_dir):
    top = shap_rows(spark, sf_dir).select("vec_id", F.inline(row_attribution.top_contributions(FEATURES)))
    return top.select("vec_id", "feature", F.round("shap", 6).alias("shap"))


@query("local_explanation_rows", f"""WITH {SHAP_LONG}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(shap) DESC, feature) AS rank FROM shap QUALIFY rank <= 20)
  SELECT vec_id, feature, rank, CASE WHEN shap > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  round(0.5::DOUBLE + sum(shap) OVER (PARTITION BY vec_id ORDER BY rank), 5) AS running FROM t""")
def local_explanation_rows(spark, sf_dir):
    out = row_attribution.local_explanation(shap_rows(spark, sf_dir), "vec_id", FEATURES, 0.5)
    return out.select("vec_id", "feature", F.col("rank").cast("bigint").alias("rank"), "direction", F.round("running", 5).alias("running"))


@query("interaction_strength_rows", f"{STRENGTH} SELECT feature, round(strength, 5) AS strength FROM st")
def interaction_strength_rows(spark, sf_dir):
    return row_attribution.interaction_strength(shap_rows(spark, sf_dir), FEATURES, "e07").withColumn("strength", F.round("strength", 5))


@query("dependence_rows", f"""{STRENGTH}, best AS (SELECT feature FROM st ORDER BY strength DESC, feature LIMIT 1)
  SELECT m.vec_id, round(m.feature_value, 6) AS feature_value, round(m.shap, 6) AS shap, round(o.feature_value, 6) AS interaction_value, o.feature AS interaction
  FROM m JOIN shap o ON o.vec_id = m.vec_id JOIN best ON best.feature = o.feature""")
def dependence_rows(spark, sf_dir):
    out = row_attribution.dependence(shap_rows(spark, sf_dir), "vec_id", FEATURES, "e07")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("feature_value", "shap", "interaction_value")], "interaction")


@query("explanation_report_tables", f"""WITH {SHAP_LONG}, g AS (SELECT feature, avg(abs(shap)) AS g FROM shap GROUP BY 1 ORDER BY g DESC, feature LIMIT 5)
  SELECT feature, count(*) AS n, round(sum(feature_value), 4) AS total, round(sum(shap), 4) AS shap FROM shap JOIN g USING (feature) GROUP BY 1""")
def explanation_report_tables(spark, sf_dir):
    """The dependence tables of the five most important features, read back from the report."""
    paths = row_attribution.report(shap_rows(spark, sf_dir), "vec_id", FEATURES, 0.0, new_path(spark, "explain"))
    parts = [spark.read.parquet(p).select(F.lit(n.removeprefix("dependence_")).alias("feature"), "feature_value", "shap")
             for n, p in paths.items() if n.startswith("dependence_")]
    every = reduce(DataFrame.unionAll, parts)
    return every.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("feature_value"), 4).alias("total"), F.round(F.sum("shap"), 4).alias("shap"))


@query("explanation_report", f"WITH {SHAP_LONG} SELECT feature, round(avg(abs(shap)), 6) AS mean_shap FROM shap GROUP BY 1")
def explanation_report(spark, sf_dir):
    paths = attribution.explanation_report(shap_long(spark, sf_dir), "vec_id", 0.0, new_path(spark, "explain"), dependence_n=2)
    return spark.read.schema("feature string, mean_shap double").option("header", True).csv(paths["global"]).withColumn("mean_shap", F.round("mean_shap", 6))
