from pyspark.sql import functions as F

from catalog.base import EMB_LONG, FEATURES, ORDER_COMPOUNDS, embedding_wide, proxy, proxy_sql, query, table
from catalog.cleaning import GAPS, GAPS_CTE, MESSY, NUMBERS, STATS_SQL, long_sql, messy, round_stats
from propspark.columns import array_to_long
from propspark.operators import cleaning, profile, sketches
from propspark.operators.quantiles import column_quantiles

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_stats", f"WITH g AS ({proxy_sql('orders', GAPS)}), {GAPS_CTE}, long AS ({long_sql('gaps', ['price', 'customer'])}) SELECT {STATS_SQL} FROM long GROUP BY feature")
def feature_stats(spark, sf_dir):
    return round_stats(profile.feature_stats(proxy(spark, sf_dir, "orders", GAPS), ["price", "customer"]))


@query("feature_stats_wide", f"WITH {EMB_LONG} SELECT {STATS_SQL} FROM emb GROUP BY feature")
def feature_stats_wide(spark, sf_dir):
    return round_stats(profile.feature_stats(embedding_wide(spark, sf_dir), FEATURES))


@query("feature_stats_array", f"WITH {EMB_LONG} SELECT {STATS_SQL.replace('feature,', 'CAST(substr(feature, 2) AS BIGINT) AS feature,')} FROM emb GROUP BY feature")
def feature_stats_array(spark, sf_dir):
    long = array_to_long(table(spark, sf_dir, "embeddings"), "embedding")
    return round_stats(profile.profile_long(long)).withColumn("feature", F.col("feature").cast("bigint"))


@query("describe", f"WITH long AS ({long_sql('lineitem', LINE_NUM)}), s AS (SELECT {STATS_SQL} FROM (SELECT feature, value + 0.0 AS value FROM long) GROUP BY feature) SELECT feature, count, mean, std, min, q25, q50, q75, max FROM s")
def describe(spark, sf_dir):
    return round_stats(profile.describe(table(spark, sf_dir, "lineitem"), LINE_NUM))


@query("sketch_quantiles", f"""WITH long AS ({long_sql('lineitem', LINE_NUM)}) SELECT feature, count(value) AS n, true AS within, true AS counted FROM long GROUP BY 1""")
def sketch_quantiles(spark, sf_dir):
    """Quartiles and distinct counts from merged sketches of two halves of the table, held against all rows: rank error at most
    a hundredth, distinct values within a tenth."""
    df = table(spark, sf_dir, "lineitem")
    halves = [df.where(F.col("l_orderkey") % 2 == i) for i in (0, 1)]
    state = sketches.merge(*[sketches.build(h, LINE_NUM, 0.01) for h in halves])
    q = sketches.quantiles(state, [0.25, 0.5, 0.75])
    counts = {r.feature: r["distinct"] for r in sketches.distinct_counts(state).collect()}
    rows = []
    for c in LINE_NUM:
        aggs = [F.count_if(F.col(c) < v).alias(f"lo{i}") for i, v in enumerate(q[c])] + [F.count_if(F.col(c) <= v).alias(f"hi{i}") for i, v in enumerate(q[c])]
        r = df.agg(F.count(c).alias("n"), F.count_distinct(c).alias("d"), *aggs).first()
        within = all(r[f"lo{i}"] / r.n - 0.01 <= p <= r[f"hi{i}"] / r.n + 0.01 for i, p in enumerate((0.25, 0.5, 0.75)))
        rows.append((c, r.n, within, abs(counts[c] - r.d) <= 0.1 * r.d))
    return spark.createDataFrame(rows, "feature string, n bigint, within boolean, counted boolean")


@query("value_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("target_counts", f"WITH {GAPS_CTE} SELECT 'price' AS target, count(price) AS present, count(*) AS total FROM gaps UNION ALL SELECT 'customer', count(customer), count(*) FROM gaps UNION ALL SELECT 'status', count(status), count(*) FROM gaps")
def target_counts(spark, sf_dir):
    return profile.target_counts(proxy(spark, sf_dir, "orders", GAPS), ["price", "customer", "status"])


@query("problem_type", """SELECT 'label' AS target, CASE WHEN count(DISTINCT label) <= 10 THEN 'classification' ELSE 'regression' END AS kind, count(DISTINCT label) AS classes FROM embeddings
  UNION ALL SELECT 'vec_id', CASE WHEN count(DISTINCT vec_id) <= 10 THEN 'classification' ELSE 'regression' END, count(DISTINCT vec_id) FROM embeddings""")
def problem_type(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    target = profile.pick_target(emb, ["solubility", "label"])
    rows = [(t, *profile.problem_type(emb, t)) for t in (target, "vec_id")]
    return spark.createDataFrame(rows, "target string, kind string, classes long")


def hist_sql(source: str, col: str, bins: int) -> str:
    return f"""WITH x AS (SELECT {col} AS v FROM {source} WHERE {col} IS NOT NULL), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM x),
  c AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM x, e GROUP BY 1)
  SELECT CAST(b AS BIGINT) AS bin, round(lo + b * w, 6) AS lo, round(lo + (b + 1) * w, 6) AS hi, coalesce(n, 0) AS count
  FROM e, range(0, {bins}) r(b) LEFT JOIN c ON c.bin = b"""


def _hist(df):
    return df.select(F.col("bin").cast("bigint").alias("bin"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


@query("histogram", hist_sql("lineitem", "l_extendedprice", 50))
def histogram(spark, sf_dir):
    return _hist(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("histogram_30", hist_sql("events", "value", 30))
def histogram_30(spark, sf_dir):
    return _hist(profile.histogram(table(spark, sf_dir, "events"), "value", 30))


@query("box_stats", f"""WITH long AS ({long_sql('events', ['value'])} UNION ALL {long_sql('orders', ['o_totalprice'])}),
  q AS (SELECT feature, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75,
    avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY 1)
  SELECT q.feature, round(any_value(q25), 6) AS q25, round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75,
    round(min(value) FILTER (WHERE value >= q25 - 1.5 * (q75 - q25)), 6) AS whisker_lo,
    round(max(value) FILTER (WHERE value <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_hi,
    count(*) FILTER (WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers,
    round(any_value(mean), 5) AS mean, round(any_value(std), 5) AS std FROM long JOIN q USING (feature) GROUP BY q.feature""")
def box_stats(spark, sf_dir):
    a = profile.box_stats(table(spark, sf_dir, "events"), ["value"])
    b = profile.box_stats(table(spark, sf_dir, "orders"), ["o_totalprice"])
    out = a.unionByName(b)
    return out.select(*[F.round(c, 5 if c in ("mean", "std") else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("correlation_matrix", """SELECT f1, f2, round(r, 6) AS r FROM (
  SELECT 'price' AS f2, 'customer' AS f1, corr(price, customer) AS r FROM gaps UNION ALL
  SELECT 'price', 'o_orderkey', corr(price, o_orderkey) FROM gaps UNION ALL
  SELECT 'o_orderkey', 'customer', corr(o_orderkey, customer) FROM gaps)""".replace("SELECT f1", f"WITH {GAPS_CTE} SELECT f1", 1)
       .replace("SELECT 'price', 'o_orderkey', corr(price, o_orderkey)", "SELECT 'o_orderkey', 'price', corr(price, o_orderkey)"))
def correlation_matrix(spark, sf_dir):
    out = profile.correlation_table(proxy(spark, sf_dir, "orders", GAPS))
    return out.withColumn("r", F.round("r", 6))


CORR64 = "SELECT a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS r FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND a.feature > b.feature GROUP BY 1, 2"


@query("correlation_matrix_wide", f"WITH {EMB_LONG} SELECT f1, f2, round(r, 6) AS r FROM ({CORR64})")
def correlation_matrix_wide(spark, sf_dir):
    return profile.correlation_table(embedding_wide(spark, sf_dir), FEATURES).withColumn("r", F.round("r", 6))


@query("top_correlated", """WITH l AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d, CAST(l_linenumber AS DOUBLE) AS e, CAST(l_suppkey AS DOUBLE) AS f FROM lineitem),
  s AS (SELECT unnest(['l_extendedprice', 'l_quantity', 'l_discount', 'l_tax', 'l_linenumber', 'l_suppkey']) AS feature, unnest([1.0, abs(corr(a, b)), abs(corr(c, b)), abs(corr(d, b)), abs(corr(e, b)), abs(corr(f, b))]) AS r FROM l),
  t AS (SELECT feature, row_number() OVER (ORDER BY r DESC, feature) AS k FROM s QUALIFY k <= 4),
  long AS (SELECT l_orderkey, rn, unnest(['l_extendedprice', 'l_quantity', 'l_discount', 'l_tax', 'l_linenumber', 'l_suppkey']) AS feature, unnest([l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber, l_suppkey]) AS v FROM (SELECT *, row_number() OVER () AS rn FROM lineitem))
  SELECT x.feature AS f1, y.feature AS f2, round(corr(x.v, y.v), 6) AS r FROM long x JOIN long y USING (rn) JOIN t tx ON tx.feature = x.feature JOIN t ty ON ty.feature = y.feature WHERE tx.k > ty.k GROUP BY 1, 2""")
def top_correlated(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    out = profile.top_correlated(table(spark, sf_dir, "lineitem"), "l_extendedprice", 4, cols)
    return out.withColumn("r", F.round("r", 6))


@query("dataset_means", f"SELECT count(*) AS count, round(avg(molecular_weight), 6) AS avg_molecular_weight, round(avg(xlogp), 6) AS avg_xlogp FROM ({proxy_sql('orders', ORDER_COMPOUNDS)})")
def dataset_means(spark, sf_dir):
    out = profile.dataset_means(proxy(spark, sf_dir, "orders", ORDER_COMPOUNDS), ["molecular_weight", "xlogp"])
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# --- ranking ------------------------------------------------------------------------------------

from propspark.operators import ranking  # noqa: E402


@query("sort_importance", f"WITH {EMB_LONG} SELECT feature, round(avg(abs(value)), 6) AS importance FROM emb GROUP BY 1")
def sort_importance(spark, sf_dir):
    long = _long(spark, sf_dir).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("importance"))
    return ranking.sort_importance(long)


def _long(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("e"), F.lpad(i.cast("string"), 2, "0")))
    emb = table(spark, sf_dir, "embeddings")
    cells = F.explode(F.arrays_zip(names.alias("feature"), F.col("embedding").cast("array<double>").alias("value")))
    return emb.select("vec_id", F.col("label").cast("bigint").alias("label"), cells.alias("c")).select(
        "vec_id", "label", F.col("c.feature").alias("feature"), F.col("c.value").alias("value"))


@query("top_features", f"WITH {EMB_LONG}, i AS (SELECT feature, round(avg(abs(value)), 6) AS importance FROM emb GROUP BY 1) SELECT * FROM i ORDER BY importance DESC, feature LIMIT 20")
def top_features(spark, sf_dir):
    long = _long(spark, sf_dir).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("importance"))
    return ranking.top_features(long, 20)


SHAP_LONG = f"{EMB_LONG}, shap AS (SELECT vec_id, feature, value AS feature_value, value * (1 + CAST(substr(feature, 2) AS INT) % 3) AS shap FROM emb)"


def shap_long(spark, sf_dir):
    factor = F.substring("feature", 2, 2).cast("int") % 3 + 1
    return _long(spark, sf_dir).select("vec_id", "feature", F.col("value").alias("feature_value"), (F.col("value") * factor).alias("shap"))


@query("top_contributions", f"""WITH {SHAP_LONG} SELECT vec_id, feature, round(shap, 6) AS shap, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(shap) DESC, feature) AS rank FROM shap) WHERE rank <= 20""")
def top_contributions(spark, sf_dir):
    out = ranking.top_per_row(shap_long(spark, sf_dir), "vec_id")
    return out.select("vec_id", "feature", F.round("shap", 6).alias("shap"), F.col("rank").cast("bigint").alias("rank"))


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def head_rows(spark, sf_dir):
    return ranking.head(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query("contribution_share", f"""WITH {SHAP_LONG}, g AS (SELECT feature, avg(abs(shap)) AS mean_shap FROM shap GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY mean_shap DESC, feature) AS k FROM g QUALIFY k <= 20)
  SELECT count(*) AS listed, round(sum(mean_shap) FILTER (WHERE k <= 10), 6) AS top_sum, round(sum(mean_shap), 6) AS listed_sum,
  round(100 * sum(mean_shap) FILTER (WHERE k <= 10) / sum(mean_shap), 4) AS share_pct, min_by(feature, k) AS most_important FROM r""")
def contribution_share(spark, sf_dir):
    from propspark.operators.attribution import global_importance
    out = ranking.contribution_share(global_importance(shap_long(spark, sf_dir)))
    return out.select("listed", F.round("top_sum", 6).alias("top_sum"), F.round("listed_sum", 6).alias("listed_sum"),
                      F.round("share_pct", 4).alias("share_pct"), "most_important")


@query("components_for_variance", f"""WITH {EMB_LONG}, v AS (SELECT feature, var_pop(value) AS variance FROM emb GROUP BY 1),
  c AS (SELECT row_number() OVER (ORDER BY feature) AS component, variance FROM v),
  s AS (SELECT component, sum(variance) OVER (ORDER BY component) / sum(variance) OVER () AS cum FROM c)
  SELECT min(component) FILTER (WHERE cum >= 0.95) AS k, count(*) AS p FROM s""")
def components_for_variance(spark, sf_dir):
    v = _long(spark, sf_dir).groupBy("feature").agg(F.var_pop("value").alias("variance"))
    comp = v.select((F.substring("feature", 2, 2).cast("bigint") + 1).alias("component"), "variance")
    return ranking.components_for_variance(comp)


METRIC_ROWS = """SELECT o_orderstatus AS target, o_orderpriority AS model_type, 'r2' AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2
  UNION ALL SELECT o_orderstatus, o_orderpriority, 'mae', round(stddev_pop(o_totalprice), 4) FROM orders GROUP BY 1, 2"""


def metric_rows(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("model_type"))
    return g.agg(F.round(F.avg("o_totalprice"), 4).alias("r2"), F.round(F.stddev_pop("o_totalprice"), 4).alias("mae")).unpivot(
        ["target", "model_type"], ["r2", "mae"], "metric", "value")


@query("best_model", f"WITH m AS ({METRIC_ROWS}) SELECT target, model_type, value FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY value DESC, model_type) AS k FROM m WHERE metric = 'r2') WHERE k = 1")
def best_model(spark, sf_dir):
    return ranking.best_model(metric_rows(spark, sf_dir), "r2")


TYPE_CASE = "CASE WHEN o_orderkey % 97 = 0 THEN 'xgboost' WHEN o_orderkey % 31 = 0 THEN 'gradient_boosting' ELSE 'random_forest' END"


@query("preferred_model", f"""SELECT target, model_type FROM (SELECT o_custkey AS target, {TYPE_CASE} AS model_type, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE {TYPE_CASE} WHEN 'xgboost' THEN 0 WHEN 'gradient_boosting' THEN 1 ELSE 2 END) AS k FROM orders) WHERE k = 1""")
def preferred_model(spark, sf_dir):
    return ranking.preferred_model(table(spark, sf_dir, "orders").selectExpr("o_custkey AS target", f"{TYPE_CASE} AS model_type"))


# the way of large tables: brackets of at most 200 values are sorted, fuller ones narrowed
BRACKETED = {"a": "o_totalprice", "b": "CAST(o_custkey AS DOUBLE)", "c": "CAST(o_orderkey % 3 AS DOUBLE)"}


@query("quantiles_bracketed", " UNION ALL ".join(
    f"SELECT '{k}' AS feature, round(quantile_cont({e}, 0.25), 6) AS q25, round(quantile_cont({e}, 0.5), 6) AS q50, round(quantile_cont({e}, 0.9), 6) AS q90 FROM orders"
    for k, e in BRACKETED.items()))
def quantiles_bracketed(spark, sf_dir):
    got = column_quantiles(proxy(spark, sf_dir, "orders", BRACKETED), list(BRACKETED), [0.25, 0.5, 0.9], budget=200)
    return spark.createDataFrame([(k, *[round(x, 6) for x in v]) for k, v in got.items()], "feature string, q25 double, q50 double, q90 double")
