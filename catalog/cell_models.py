"""Models whose predictions are means of cells, and principal components of two columns: both have SQL forms.

A forest without bootstrap over all features, grown to the end on a few binary columns, predicts the mean of each row's
cell; so does one boosting round of step 1. All queries read the whole table.
"""

from pyspark.sql import functions as F

from catalog import smiles_sql as sq  # noqa: F401
from catalog.base import ORDER_COMPOUNDS, proxy, proxy_sql, query
from catalog.cleaning import RECORD_ERRORS, RECORDS
from catalog.modelling import REG_DIGITS, REG_SQL, rounded
from catalog.streams import _stream
from propspark.operators import attribution, learning, selection
from propspark.operators.split_scale import split
from propspark.session import new_path
from propspark.streaming import jobs

CELL = {
    "pos": "o_orderkey", "b1": "CAST(o_orderkey % 2 AS DOUBLE)", "b2": "CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE)",
    "b3": "CAST(CASE WHEN o_custkey % 5 < 2 THEN 1 ELSE 0 END AS DOUBLE)",
    "y": "o_totalprice + 300000.0E0 * (o_orderkey % 2) + 100000.0E0 * (CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END)",
    "c": "CAST(CASE WHEN o_custkey % 7 = 0 THEN 1 - o_orderkey % 2 ELSE o_orderkey % 2 END AS BIGINT)",
}
ROWS = proxy_sql("orders", CELL)
INPUTS = ["b1", "b2", "b3"]
FOREST = {"n_estimators": 3, "max_depth": 6, "bootstrap": False, "max_features": "all", "min_samples_leaf": 1, "subsample": 1.0}
ROUND = {"n_estimators": 1, "max_depth": 6, "learning_rate": 1.0, "subsample": 1.0}
CELLS = f"SELECT *, avg(y) OVER (PARTITION BY b1, b2, b3) AS pred FROM ({ROWS})"
FIT_SQL = f"SELECT {REG_SQL} FROM ({CELLS})"


def cells(spark, sf_dir):
    return proxy(spark, sf_dir, "orders", CELL)


def forest(df, target="y", kind="regression"):
    return learning.ModelTrainer("random_forest", kind, FOREST).train(df, INPUTS, target, key="pos")


def _metrics(model_type, params):
    def run(spark, sf_dir):
        bundle = learning.ModelTrainer(model_type, "regression", params).train(cells(spark, sf_dir), INPUTS, "y", key="pos")
        return rounded(spark.createDataFrame([tuple(bundle.metrics[k] for k in REG_DIGITS)], ", ".join(f"{k} double" for k in REG_DIGITS)), REG_DIGITS)
    return run


query("cell_fit_forest", FIT_SQL)(_metrics("random_forest", FOREST))
query("cell_fit_boosting", FIT_SQL)(_metrics("gradient_boosting", ROUND))


@query("cell_fit_classes", f"""WITH x AS (SELECT *, CASE WHEN avg(c) OVER (PARTITION BY b1, b2, b3) > 0.5 THEN 1 ELSE 0 END AS pred FROM ({ROWS}))
  SELECT round(avg(CASE WHEN c = pred THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM x""")
def cell_fit_classes(spark, sf_dir):
    df = cells(spark, sf_dir)
    scored = forest(df, "c", "classification").predict(df)
    return scored.agg(F.round(F.avg(F.when(F.col("c") == F.col("prediction"), 1).otherwise(0)), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("cell_predict_raw", f"""WITH x AS (SELECT pos, b1, b2, b3, y FROM ({ROWS})), m AS (SELECT b1, b2, b3, avg(y) AS p FROM x GROUP BY ALL)
  SELECT pos, round(m.p, 4) AS prediction FROM x JOIN m ON m.b1 = x.b1 AND m.b3 = 0 AND m.b2 = CASE WHEN pos % 4 < 2 THEN 0 ELSE x.b2 END""")
def cell_predict_raw(spark, sf_dir):
    """Raw columns in another order, one absent, one with null and NaN: all of these count as 0."""
    df = cells(spark, sf_dir)
    raw = df.select("pos", F.expr("CASE pos % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE b2 END").alias("b2"), F.lit(9).alias("unknown"), "b1")
    return forest(df).predict(raw).select("pos", F.round("prediction", 4).alias("prediction"))


@query("cell_reload", "SELECT count(*) AS n, 0.0::DOUBLE AS largest FROM orders")
def cell_reload(spark, sf_dir):
    """Difference between the predictions of a model and of its reloaded copy."""
    df = cells(spark, sf_dir)
    bundle = forest(df)
    again = learning.ModelBundle.load(spark, bundle.save(spark, new_path(spark, "model")))
    both = again.predict(bundle.predict(df, "p"), "q")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 9).alias("largest"))


FOLD = "CAST((('0x' || substr(md5(CAST(pos AS VARCHAR) || '#fold42'), 1, 13))::BIGINT) % 5 AS INTEGER)"
FOLDS = f"""WITH x AS (SELECT *, {FOLD} AS fold FROM ({ROWS})),
  p AS (SELECT f.fold, b1, b2, b3, avg(y) AS pred FROM x, (SELECT DISTINCT fold FROM x) f WHERE x.fold <> f.fold GROUP BY ALL),
  s AS (SELECT x.fold, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS score FROM x JOIN p USING (fold, b1, b2, b3) GROUP BY 1)"""


@query("cell_cross_validate", f"{FOLDS} SELECT fold, round(score, 6) AS score FROM s")
def cell_cross_validate(spark, sf_dir):
    return learning.ModelTrainer("random_forest", "regression", FOREST).cross_validate(cells(spark, sf_dir), INPUTS, "y", "pos").withColumn("score", F.round("score", 6))


@query("cell_grid", f"SELECT 6 AS best_depth, round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse FROM ({CELLS})")
def cell_grid(spark, sf_dir):
    """The deepest of three trees wins by cross-validation; its final fit is on all rows."""
    t = learning.ModelTrainer("random_forest", "regression", FOREST)
    b = t.train(cells(spark, sf_dir), INPUTS, "y", key="pos", tune=True, grid={"max_depth": [1, 6], "min_samples_split": [2, 5]})
    return spark.createDataFrame([(b.best_params["max_depth"], round(b.metrics["rmse"], 4))], "best_depth int, rmse double")


@query("cell_importance", """SELECT f AS feature, CASE f WHEN 'b1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM (SELECT unnest(['b1', 'b2', 'b3']) AS f) WHERE (SELECT count(*) FROM orders) > 0""")
def cell_importance(spark, sf_dir):
    """A target that one column decides alone."""
    df = cells(spark, sf_dir).withColumn("only", F.col("b1") * 7.0)
    return learning.ModelTrainer("random_forest", "regression", FOREST).train(df, INPUTS, "only", key="pos").importance(spark).withColumn("importance", F.round("importance", 9))


@query("cell_rfe", "SELECT 'b1' AS feature, count(*) AS n FROM orders")
def cell_rfe(spark, sf_dir):
    df = cells(spark, sf_dir)
    kept = selection.FeatureSelector("rfe", 1).fit(df, INPUTS, "y").selected
    return df.agg(F.lit(kept[0]).alias("feature"), F.count(F.lit(1)).alias("n"))


@query("cell_targets", f"""SELECT target, round(sqrt(avg((v - pred) * (v - pred))), 4) AS rmse FROM (
    SELECT 'y' AS target, y AS v, avg(y) OVER (PARTITION BY b1, b2, b3) AS pred FROM ({ROWS})
    UNION ALL SELECT 'z', z, avg(z) OVER (PARTITION BY b1, b2, b3) FROM (SELECT *, -2.0E0 * y + b2 AS z FROM ({ROWS}))) GROUP BY 1""")
def cell_targets(spark, sf_dir):
    """Two targets trained, saved, loaded and evaluated."""
    df = cells(spark, sf_dir).withColumn("z", F.expr("-2.0E0 * y + b2"))
    base = new_path(spark, "targets")
    learning.train_targets(df, INPUTS, {"y": "regression", "z": "regression"}, hyperparameters=FOREST).save(spark, base)
    got = learning.MultiTargetModel.load(spark, base).evaluate(df)
    return got.where("metric = 'rmse'").select("target", F.round("value", 4).alias("rmse"))


@query("cell_catalogue", f"""SELECT 'y' AS target, 'random_forest' AS model_type, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2 FROM ({CELLS})""")
def cell_catalogue(spark, sf_dir):
    base = new_path(spark, "targets")
    learning.train_targets(cells(spark, sf_dir), INPUTS, {"y": "regression"}, hyperparameters=FOREST).save(spark, base)
    return learning.model_catalogue(learning.read_metadata(spark, base)).select("target", "model_type", F.round("r2", 6).alias("r2"))


BATCH = {**ORDER_COMPOUNDS, **RECORDS, **{k: CELL[k] for k in ("b1", "b2", "b3", "y")}}
BATCH_SQL = f"""SELECT pos, errors AS error, CASE WHEN errors = '' THEN round(avg(y) OVER (PARTITION BY b1, b2, b3), 4) END AS pred
  FROM (SELECT *, {RECORD_ERRORS} AS errors FROM ({proxy_sql('orders', BATCH)}))"""


@query("cell_score_batch", BATCH_SQL)
def cell_score_batch(spark, sf_dir):
    out = learning.score_batch(proxy(spark, sf_dir, "orders", BATCH), [forest(cells(spark, sf_dir))])
    return out.select("pos", F.coalesce("error", F.lit("")).alias("error"), F.round("pred_y", 4).alias("pred"))


@query("cell_stream_scoring", BATCH_SQL)
def cell_stream_scoring(spark, sf_dir):
    records = _stream(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in BATCH.items()])
    out = new_path(spark, "stream-score")
    jobs.run_to_end(jobs.score_stream(records, [forest(cells(spark, sf_dir))], out))
    both = [jobs.read_scored(spark, out, s).select("pos", F.coalesce("error", F.lit("")).alias("error"), F.round("pred_y", 4).alias("pred")) for s in ("scored", "quarantine")]
    return both[0].unionByName(both[1])


# two features; b1 moves the target more, so it is the root of every tree
TWO = ["b1", "b2"]
SHAP_SQL = f"""WITH x AS (SELECT pos, b1, b2, y FROM ({ROWS})), n AS (SELECT count(*)::DOUBLE AS t FROM x),
  m AS (SELECT b1, b2, avg(y) AS v, count(*) AS k FROM x GROUP BY ALL),
  e1 AS (SELECT b1, sum(v * k) / sum(k) AS v, sum(k) AS k FROM m GROUP BY 1),
  e2 AS (SELECT m.b2, sum(m.v * e1.k) / sum(e1.k) AS v FROM m JOIN e1 USING (b1) GROUP BY 1),
  z AS (SELECT sum(v * k) / sum(k) AS v FROM m)
  SELECT pos, 'b1' AS feature, round(((e1.v - z.v) + (m.v - e2.v)) / 2, 3) AS shap FROM x JOIN m USING (b1, b2) JOIN e1 USING (b1) JOIN e2 ON e2.b2 = x.b2, z
  UNION ALL SELECT pos, 'b2', round(((e2.v - z.v) + (m.v - e1.v)) / 2, 3) FROM x JOIN m USING (b1, b2) JOIN e1 USING (b1) JOIN e2 ON e2.b2 = x.b2, z"""


@query("cell_tree_shap", SHAP_SQL)
def cell_tree_shap(spark, sf_dir):
    df = cells(spark, sf_dir)
    bundle = learning.ModelTrainer("random_forest", "regression", FOREST).train(df, TWO, "y", key="pos")
    long, _ = attribution.tree_shap(df, "pos", bundle)
    return long.select("pos", "feature", F.round("shap", 3).alias("shap"))


@query("cell_sampled_shap", f"""WITH x AS (SELECT pos, b1, b2 FROM ({ROWS})), z AS (SELECT b1, b2 FROM x ORDER BY md5(CAST(pos AS VARCHAR) || '#42') LIMIT 1)
  SELECT pos, 'b1' AS feature, round(3 * (x.b1 - z.b1), 6) + 0.0 AS shap FROM x, z UNION ALL SELECT pos, 'b2', round(5 * (x.b2 - z.b2), 6) + 0.0 FROM x, z""")
def cell_sampled_shap(spark, sf_dir):
    """An additive target and one background row: every order gives the same contributions."""
    df = cells(spark, sf_dir).withColumn("sum", F.col("b1") * 3.0 + F.col("b2") * 5.0)
    bundle = learning.ModelTrainer("random_forest", "regression", FOREST).train(df, TWO, "sum", key="pos")
    long = attribution.sampled_shap(df, "pos", bundle, df, "pos", background_rows=1)
    return long.select("pos", "feature", (F.round("shap", 6) + 0.0).alias("shap"))


@query("cell_kernel_shap", f"""WITH x AS (SELECT pos, b1, b2 FROM ({ROWS})), z AS (SELECT b1, b2 FROM x ORDER BY md5(CAST(pos AS VARCHAR) || '#42') LIMIT 100),
  m AS (SELECT avg(b1) AS m1, avg(b2) AS m2 FROM z)
  SELECT pos, 'b1' AS feature, round(3 * (x.b1 - m1), 6) + 0.0 AS shap FROM x, m UNION ALL SELECT pos, 'b2', round(5 * (x.b2 - m2), 6) + 0.0 FROM x, m""")
def cell_kernel_shap(spark, sf_dir):
    """An additive target over 100 background rows: a feature's value is its distance from the background's mean."""
    df = cells(spark, sf_dir).withColumn("sum", F.col("b1") * 3.0 + F.col("b2") * 5.0)
    bundle = learning.ModelTrainer("random_forest", "regression", FOREST).train(df, TWO, "sum", key="pos")
    long = attribution.kernel_shap(df, "pos", bundle, df, "pos")
    return long.select("pos", "feature", (F.round("shap", 6) + 0.0).alias("shap"))


PAIR = f"""WITH x AS (SELECT pos, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS a, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS b
  FROM (SELECT pos, y, y / 1.0E5 + o AS d FROM (SELECT *, (pos % 97)::DOUBLE AS o FROM ({ROWS}))))"""


def _pair(spark, sf_dir):
    df = cells(spark, sf_dir).select("pos", "y", F.expr("y / 1.0E5 + CAST(pos % 97 AS DOUBLE)").alias("d"))
    return df, selection.fit_pca(df, ["y", "d"], k=2)


@query("pair_pca_variance", f"{PAIR} SELECT 1 AS component, round((1 + abs(corr(a, b))) / 2, 6) AS variance FROM x UNION ALL SELECT 2, round((1 - abs(corr(a, b))) / 2, 6) FROM x")
def pair_pca_variance(spark, sf_dir):
    return _pair(spark, sf_dir)[1].variance_table(spark).withColumn("variance", F.round("variance", 6))


@query("pair_pca_scores", f"{PAIR}, r AS (SELECT corr(a, b) AS r FROM x) SELECT pos, round(abs(a + b) / sqrt(2), 5) AS first, round(abs(a - b) / sqrt(2), 5) AS second FROM x, r WHERE r.r > 0")
def pair_pca_scores(spark, sf_dir):
    """The scores but for their sign: both loadings of a component are equally large."""
    df, model = _pair(spark, sf_dir)
    return model.transform(df, ["pos"]).select("pos", F.round(F.abs("PC_1"), 5).alias("first"), F.round(F.abs("PC_2"), 5).alias("second"))
