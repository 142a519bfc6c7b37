from pyspark.sql import functions as F

from catalog.base import EMB_LONG, FEATURES, embedding_wide, query, table
from catalog.profiling import CORR64
from propspark.operators import selection

NUMS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
TARGET = "l_extendedprice"


def names_table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("select_variance", f"WITH {EMB_LONG} SELECT feature FROM emb GROUP BY 1 HAVING var_pop(value) > 0.0155")
def select_variance(spark, sf_dir):
    m = selection.FeatureSelector("variance", variance_threshold=0.0155).fit(embedding_wide(spark, sf_dir), FEATURES)
    return names_table(spark, m.selected)


@query("select_correlation", f"WITH {EMB_LONG} SELECT DISTINCT feature FROM emb WHERE feature NOT IN (SELECT f1 FROM ({CORR64}) WHERE abs(r) > 0.1)")
def select_correlation(spark, sf_dir):
    m = selection.FeatureSelector("correlation", correlation_threshold=0.1).fit(embedding_wide(spark, sf_dir), FEATURES)
    return names_table(spark, m.selected)


def edges_sql(source: str, binning: str) -> str:
    """Inner bin edges of a long table (feature, value), 10 bins."""
    if binning == "width":
        return f"""SELECT feature, list_transform(range(1, 10), lambda i: lo + i * (hi - lo) / 10) AS edges
  FROM (SELECT feature, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY 1)"""
    return f"SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM {source} GROUP BY 1"


MI_TAIL = """joint AS (SELECT feature, bx, by_, count(*) AS n FROM b GROUP BY 1, 2, 3),
  w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx,
    sum(n) OVER (PARTITION BY feature, by_) AS ny FROM joint),
  mi AS (SELECT feature, round(greatest(sum(n / t * ln(n * t / (nx * ny))), 0), 6) AS score FROM w GROUP BY 1)"""


def mi_class_sql(binning: str) -> str:
    return f"""WITH {EMB_LONG}, e AS ({edges_sql('emb', binning)}),
  b AS (SELECT feature, len(list_filter(edges, lambda x: x <= value)) AS bx, label AS by_ FROM emb JOIN e USING (feature)), {MI_TAIL}"""


@query("mutual_information_classes", mi_class_sql("quantile") + " SELECT * FROM mi")
def mutual_information_classes(spark, sf_dir):
    out = selection.mutual_information(embedding_wide(spark, sf_dir), FEATURES, "label", "classification")
    return out.withColumn("score", F.round("score", 6))


@query("mutual_information_width", mi_class_sql("width") + " SELECT * FROM mi")
def mutual_information_width(spark, sf_dir):
    out = selection.mutual_information(embedding_wide(spark, sf_dir), FEATURES, "label", "classification", binning="width")
    return out.withColumn("score", F.round("score", 6))


LINE_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, l_extendedprice AS y FROM lineitem" for c in NUMS) + ")"


@query("mutual_information_regression", f"""WITH {LINE_LONG}, e AS ({edges_sql('long', 'quantile')}),
  ey AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ye FROM lineitem),
  b AS (SELECT feature, len(list_filter(edges, lambda x: x <= value)) AS bx, len(list_filter(ye, lambda x: x <= y)) AS by_ FROM long JOIN e USING (feature), ey), {MI_TAIL} SELECT * FROM mi""")
def mutual_information_regression(spark, sf_dir):
    out = selection.mutual_information(table(spark, sf_dir, "lineitem"), NUMS, TARGET, "regression")
    return out.withColumn("score", F.round("score", 6))


@query("select_mutual_info", mi_class_sql("quantile") + " SELECT feature FROM mi ORDER BY score DESC, feature LIMIT 12")
def select_mutual_info(spark, sf_dir):
    m = selection.FeatureSelector("mutual_info", 12, problem_type="classification").fit(embedding_wide(spark, sf_dir), FEATURES, "label")
    return names_table(spark, m.selected)


@query("f_statistic_regression", f"""WITH {LINE_LONG} SELECT feature, round(r * r / (1 - r * r) * (n - 2), 4) AS score FROM
  (SELECT feature, corr(value, y) AS r, count(*) AS n FROM long GROUP BY 1)""")
def f_statistic_regression(spark, sf_dir):
    return selection.f_statistic(table(spark, sf_dir, "lineitem"), NUMS, TARGET).withColumn("score", F.round("score", 4))


ANOVA = f"""WITH {EMB_LONG}, g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM emb GROUP BY 1, 2),
  t AS (SELECT feature, avg(value) AS gm FROM emb GROUP BY 1),
  f AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g JOIN t USING (feature) GROUP BY 1)"""


@query("f_statistic_classes", f"{ANOVA} SELECT feature, round(f, 5) AS score FROM f")
def f_statistic_classes(spark, sf_dir):
    out = selection.f_statistic(embedding_wide(spark, sf_dir), FEATURES, "label", "classification")
    return out.withColumn("score", F.round("score", 5))


@query("select_f_statistic", f"{ANOVA}, k AS (SELECT feature, row_number() OVER (ORDER BY f DESC, feature) AS k, f FROM f) SELECT feature, round(f, 5) AS score, k <= 15 AS selected FROM k")
def select_f_statistic(spark, sf_dir):
    m = selection.FeatureSelector("f_statistic", 15, problem_type="classification").fit(embedding_wide(spark, sf_dir), FEATURES, "label")
    return m.score_table(spark).withColumn("score", F.round("score", 5))


@query("select_combined", f"""WITH {EMB_LONG}, v AS (SELECT feature FROM emb GROUP BY 1 HAVING var_pop(value) > 0.015),
  kept AS (SELECT feature FROM v WHERE feature NOT IN (SELECT f1 FROM ({CORR64.replace("GROUP BY", "WHERE a.feature IN (SELECT feature FROM v) AND b.feature IN (SELECT feature FROM v) GROUP BY")}) WHERE abs(r) > 0.15)),
  e AS ({edges_sql('emb', 'quantile')}), b AS (SELECT feature, len(list_filter(edges, lambda x: x <= value)) AS bx, label AS by_ FROM emb JOIN e USING (feature) JOIN kept USING (feature)), {MI_TAIL}
  SELECT feature FROM mi ORDER BY score DESC, feature LIMIT 10""")
def select_combined(spark, sf_dir):
    sel = selection.FeatureSelector("combined", 10, 0.015, 0.15, "classification")
    return names_table(spark, sel.fit(embedding_wide(spark, sf_dir), FEATURES, "label").selected)


@query("apply_selection", f"""WITH {EMB_LONG}, top AS (SELECT feature FROM emb GROUP BY 1 HAVING var_pop(value) > 0.0155)
  SELECT vec_id, round(sum(value), 6) AS total, count(*) AS kept FROM emb WHERE feature IN (SELECT feature FROM top) GROUP BY 1""")
def apply_selection(spark, sf_dir):
    wide = embedding_wide(spark, sf_dir)
    m = selection.FeatureSelector("variance", variance_threshold=0.0155).fit(wide, FEATURES)
    out = m.transform(wide, ["vec_id"])
    total = F.aggregate(F.array(*m.selected), F.lit(0.0), lambda a, b: a + b)
    return out.select("vec_id", F.round(total, 6).alias("total"), F.lit(len(m.selected)).cast("bigint").alias("kept"))


@query("select_rfe")
def select_rfe(spark, sf_dir):
    df = embedding_wide(spark, sf_dir)
    kept, ranking = selection.recursive_elimination(df, FEATURES, "label", 16, "classification")
    return selection.SelectorModel(FEATURES, kept, ranking=ranking).ranking_table(spark)


# every component kept: the scores of a row have the length of the standardised row
@query("pca_row_length", f"""WITH {EMB_LONG}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM emb GROUP BY 1)
  SELECT vec_id, round(sum(((value - m) / s) * ((value - m) / s)), 4) AS length2 FROM emb JOIN s USING (feature) GROUP BY 1""")
def pca_row_length(spark, sf_dir):
    wide = embedding_wide(spark, sf_dir)
    m = selection.fit_pca(wide, FEATURES, len(FEATURES))
    out = m.transform(wide, ["vec_id"])
    return out.select("vec_id", F.round(F.aggregate(F.array(*m.names), F.lit(0.0), lambda a, b: a + b * b), 4).alias("length2"))


@query("pca_scores")
def pca_scores(spark, sf_dir):
    wide = embedding_wide(spark, sf_dir)
    return selection.FeatureSelector("pca").fit(wide, FEATURES).transform(wide, ["vec_id"])


@query("pca_explained")
def pca_explained(spark, sf_dir):
    """Explained share per component next to the variance of its scores."""
    wide = embedding_wide(spark, sf_dir)
    m = selection.fit_pca(wide, FEATURES, 3)
    scores = m.transform(wide).unpivot([], m.names, "component", "value")
    measured = scores.groupBy("component").agg((F.var_pop("value") / len(FEATURES)).alias("measured"))
    named = m.variance_table(spark).select(F.concat(F.lit("PC_"), F.col("component")).alias("component"), F.col("variance").alias("explained"))
    return named.join(measured, "component")
