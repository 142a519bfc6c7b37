"""Training and scoring queries. Small forests keep them quick; they read the whole tables."""

import json

from pyspark.sql import functions as F

from catalog.base import EMB_LONG, FEATURES, ORDER_COMPOUNDS, embedding_wide, proxy, proxy_sql, query, table
from catalog import smiles_sql as sq
from catalog.cleaning import RECORD_ERRORS, RECORDS
from catalog.profiling import METRIC_ROWS, metric_rows
from propspark.operators import evaluation, learning, profile
from propspark.operators.split_scale import fit_scaler, split
from propspark.plans.full_run import RunSpec, run_study
from propspark.session import new_path
from propspark.sources import tables

PRED = {"l_orderkey": "l_orderkey", "y": "l_extendedprice", "pred": "l_extendedprice * (0.9E0 + 0.2E0 * l_discount)", "flag": "l_returnflag"}
PREDS = proxy_sql("lineitem", PRED)
REG_SQL = """round(avg((y - pred) * (y - pred)), 3) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 5) AS rmse, round(avg(abs(y - pred)), 5) AS mae,
  round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs((y - pred) / (abs(y) + 1e-10))) * 100, 6) AS mape"""
REG_DIGITS = {"mse": 3, "rmse": 5, "mae": 5, "r2": 6, "mape": 6}


def rounded(df, digits=None, default=6):
    return df.select(*[F.round(c, (digits or {}).get(c, default)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("regression_metrics", f"SELECT {REG_SQL} FROM ({PREDS})")
def regression_metrics(spark, sf_dir):
    return rounded(evaluation.regression_metrics(proxy(spark, sf_dir, "lineitem", PRED), "y", "pred"), REG_DIGITS)


@query("regression_metrics_by_group", f"SELECT flag, {REG_SQL} FROM ({PREDS}) GROUP BY 1")
def regression_metrics_by_group(spark, sf_dir):
    return rounded(evaluation.regression_metrics(proxy(spark, sf_dir, "lineitem", PRED), "y", "pred", ["flag"]), REG_DIGITS)


CLASS = {"vec_id": "vec_id", "y": "label", "pred": "(label + CAST(vec_id % 4 AS INT)) % 11"}
CLASS_SQL = f"""WITH x AS ({proxy_sql('embeddings', CLASS)}), l AS (SELECT y AS k FROM x UNION SELECT pred FROM x),
  per AS (SELECT k, (SELECT count(*) FROM x WHERE y = k) AS n, (SELECT count(*) FROM x WHERE pred = k) AS c, (SELECT count(*) FROM x WHERE y = k AND pred = k) AS tp FROM l),
  pr AS (SELECT n, tp, CASE WHEN c > 0 THEN tp / c ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS r FROM per)
  SELECT round(sum(tp) / sum(n), 6) AS accuracy, round(sum(p * n) / sum(n), 6) AS precision, round(sum(r * n) / sum(n), 6) AS recall,
  round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * n) / sum(n), 6) AS f1_score FROM pr"""


@query("classification_metrics", CLASS_SQL)
def classification_metrics(spark, sf_dir):
    return rounded(evaluation.classification_metrics(proxy(spark, sf_dir, "embeddings", CLASS), "y", "pred"))


@query("confusion_matrix", f"""WITH x AS ({proxy_sql('embeddings', CLASS)}), l AS (SELECT CAST(y AS DOUBLE) AS k FROM x UNION SELECT CAST(pred AS DOUBLE) FROM x)
  SELECT a.k AS actual, b.k AS predicted, count(x.y) AS count, (SELECT round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 6) FROM x) AS accuracy
  FROM l a CROSS JOIN l b LEFT JOIN x ON x.y = a.k AND x.pred = b.k GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return rounded(evaluation.confusion_matrix(proxy(spark, sf_dir, "embeddings", CLASS), "y", "pred"))


@query("residual_table", f"SELECT l_orderkey, y, round(pred, 4) AS pred, round(y - pred, 4) AS residual FROM ({PREDS})")
def residual_table(spark, sf_dir):
    out = evaluation.residual_table(proxy(spark, sf_dir, "lineitem", PRED), "y", "pred")
    return out.select("l_orderkey", "y", F.round("pred", 4).alias("pred"), (F.round("residual", 4) + 0.0).alias("residual"))


@query("value_range", f"SELECT round(least(min(y), min(pred)), 4) AS lo, round(greatest(max(y), max(pred)), 4) AS hi, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - pred) * (y - pred))), 5) AS rmse FROM ({PREDS})")
def value_range(spark, sf_dir):
    return rounded(evaluation.value_range(proxy(spark, sf_dir, "lineitem", PRED), "y", "pred"), {"lo": 4, "hi": 4, "rmse": 5})


@query("comparison_grid", f"""WITH m AS ({METRIC_ROWS}) SELECT model_type, coalesce(max(value) FILTER (WHERE metric = 'r2'), 0) AS r2, coalesce(max(value) FILTER (WHERE metric = 'mae'), 0) AS mae,
  CAST(0 AS DOUBLE) AS rmse, target FROM m GROUP BY 1, target""")
def comparison_grid(spark, sf_dir):
    return evaluation.comparison_grid(metric_rows(spark, sf_dir), ["r2", "mae", "rmse"], ["target", "model_type"])


@query("model_catalogue", f"""WITH m AS ({METRIC_ROWS}) SELECT target, model_type, max(value) FILTER (WHERE metric = 'r2') AS r2, max(value) FILTER (WHERE metric = 'mae') AS mae FROM m GROUP BY 1, 2""")
def model_catalogue(spark, sf_dir):
    return learning.pivot_metrics(metric_rows(spark, sf_dir), ["r2", "mae"], ("target", "model_type"))


@query("metrics_report", f"WITH m AS ({METRIC_ROWS}) SELECT target || '_' || model_type AS model, metric, value, (SELECT count(*) FROM orders) AS n_rows FROM m")
def metrics_report(spark, sf_dir):
    """Write the JSON report and flatten it again."""
    path = tables.write_metrics_report(spark, new_path(spark, "report"), metric_rows(spark, sf_dir), n_rows=table(spark, sf_dir, "orders").count())
    report = spark.read.schema("n_rows bigint, metrics map<string, map<string, double>>").json(path)
    models = report.select("n_rows", F.explode("metrics").alias("model", "m"))
    return models.select("model", "n_rows", F.explode("m").alias("metric", "value"))


@query("learning_curve_summary", """SELECT CAST(o_custkey % 20 AS BIGINT) AS train_size, o_orderstatus AS split, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY 1, 2""")
def learning_curve_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 AS train_size", "o_orderstatus AS split", "o_totalprice AS score")
    return rounded(evaluation.learning_curve_summary(scores), default=4)


@query("cv_summary", "SELECT o_orderstatus AS target, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS folds FROM orders GROUP BY 1")
def cv_summary(spark, sf_dir):
    return rounded(learning.cv_summary(table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS target", "o_totalprice AS score"), ["target"]), default=4)


@query("training_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def training_table(spark, sf_dir):
    return learning.training_table(table(spark, sf_dir, "orders"), "o_totalprice")[0]


# --- fits on whole tables -------------------------------------------------------------------------

SMALL = {"n_estimators": 5, "max_depth": 4}


def order_study(spark, sf_dir):
    """Numeric compound table with a formula target and a class target."""
    from propspark.operators.descriptors import attach_heuristic_targets
    df = attach_heuristic_targets(proxy(spark, sf_dir, "orders", ORDER_COMPOUNDS), "cid", noise_sd=20.0)
    return df.withColumn("solubility", F.col("tpsa") * 0.02 + F.coalesce("xlogp", F.lit(0.0)))


INPUTS = ["molecular_weight", "xlogp", "tpsa", "hbd", "hba", "rotatable_bonds"]


def _fit(model_type, kind, target):
    def run(spark, sf_dir):
        df = split(order_study(spark, sf_dir), "cid")
        parts = {s: df.where(F.col("split") == s) for s in ("train", "test")}
        trainer = learning.ModelTrainer(model_type, kind, SMALL)
        bundle = trainer.train(parts["train"], INPUTS, target, parts["test"], fit_scaler(parts["train"], INPUTS), "cid")
        return learning.metrics_table(bundle, bundle.metrics, spark)
    return run


for _m in learning.MODEL_TYPES:
    query(f"fit_{_m}_regression")(_fit(_m, "regression", "boiling_point"))
    query(f"fit_{_m}_classification")(_fit(_m, "classification", "toxicity_category"))


def small_forest(spark, sf_dir, target="boiling_point", kind="regression", model_type="random_forest"):
    df = order_study(spark, sf_dir)
    return df, learning.ModelTrainer(model_type, kind, SMALL).train(df, INPUTS, target, scaler=fit_scaler(df, INPUTS), key="cid")


@query("model_reload")
def model_reload(spark, sf_dir):
    """Largest difference between the predictions of a model and of its reloaded copy."""
    df, bundle = small_forest(spark, sf_dir)
    again = learning.ModelBundle.load(spark, bundle.save(spark, new_path(spark, "model")))
    both = again.predict(bundle.predict(df, "p1"), "p2")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_difference"))


@query("predict_raw", f"SELECT cid, true AS predicted FROM ({proxy_sql('orders', ORDER_COMPOUNDS)})")
def predict_raw(spark, sf_dir):
    """Score raw columns in another order, one of them absent and one unknown."""
    df, bundle = small_forest(spark, sf_dir)
    raw = df.select("tpsa", "cid", F.lit(1).alias("unknown"), "hba", "hbd", "molecular_weight", "xlogp")
    return bundle.predict(raw).select("cid", F.col("prediction").between(-100, 800).alias("predicted"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return small_forest(spark, sf_dir)[1].importance(spark)


@query("cross_validate")
def cross_validate(spark, sf_dir):
    return learning.ModelTrainer("random_forest", "regression", SMALL).cross_validate(order_study(spark, sf_dir), INPUTS, "boiling_point", "cid")


@query("grid_search")
def grid_search(spark, sf_dir):
    trainer = learning.ModelTrainer("random_forest", "regression", SMALL, cv_folds=3)
    bundle = trainer.train(order_study(spark, sf_dir), INPUTS, "boiling_point", key="cid", tune=True, grid={"n_estimators": [3, 5], "max_depth": [2, 4]})
    return learning.metrics_table(bundle, {**bundle.metrics, **{f"best_{k}": v for k, v in bundle.best_params.items()}}, spark)


@query("multi_target")
def multi_target(spark, sf_dir):
    df = order_study(spark, sf_dir)
    model = learning.train_targets(df, INPUTS, {"boiling_point": "regression", "solubility": "regression", "toxicity_category": "classification"}, hyperparameters=SMALL)
    base = new_path(spark, "models")
    model.save(spark, base)
    return learning.MultiTargetModel.load(spark, base).evaluate(df)


@query("saved_models")
def saved_models(spark, sf_dir):
    df = order_study(spark, sf_dir)
    base = new_path(spark, "models")
    learning.train_targets(df, INPUTS, {"boiling_point": "regression", "toxicity_category": "classification"}, hyperparameters=SMALL).save(spark, base)
    return learning.model_catalogue(learning.read_metadata(spark, base))


@query("learning_curve")
def learning_curve(spark, sf_dir):
    df = split(order_study(spark, sf_dir), "cid")
    trainer = learning.ModelTrainer("random_forest", "regression", SMALL)
    scores = learning.learning_curve(trainer, df.where("split = 'train'"), df.where("split = 'val'"), INPUTS, "boiling_point", "cid", (0.3, 1.0))
    return evaluation.learning_curve_summary(scores)


BATCH_SQL = f"""WITH c AS (SELECT *, {RECORD_ERRORS} AS errors FROM ({proxy_sql('orders', RECORDS)}))"""


def scored_batch(spark, sf_dir):
    _, bundle = small_forest(spark, sf_dir)
    records = proxy(spark, sf_dir, "orders", {**ORDER_COMPOUNDS, **RECORDS})
    return learning.score_batch(records, [bundle])


@query("score_batch", f"{BATCH_SQL} SELECT pos, CASE WHEN errors = '' THEN 'ok' ELSE 'failed' END AS status, errors AS error, errors = '' AS predicted FROM c")
def score_batch(spark, sf_dir):
    return scored_batch(spark, sf_dir).select("pos", "status", F.coalesce("error", F.lit("")).alias("error"), F.col("pred_boiling_point").isNotNull().alias("predicted"))


@query("batch_counts", f"{BATCH_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE errors = '') AS successful, count(*) FILTER (WHERE errors <> '') AS failed FROM c")
def batch_counts(spark, sf_dir):
    return learning.batch_counts(scored_batch(spark, sf_dir))


@query("full_study")
def full_study(spark, sf_dir):
    small = {m: {"n_estimators": 4, "max_depth": 3} for m in learning.MODEL_TYPES}
    spec = RunSpec("cid", INPUTS, {"solubility": "regression", "boiling_point": "regression", "toxicity_category": "classification"}, hyperparameters=small)
    out = new_path(spark, "study")
    result = run_study(order_study(spark, sf_dir), spec, out)
    report = json.loads(spark.read.text(f"{out}/metrics").first()["value"])
    return result.metrics.withColumn("best_model", F.lit(report["best_model"])).withColumn("n_rows", F.lit(report["n_rows"])).withColumn(
        "n_explained", F.lit(result.attributions.count()))
