from pyspark.sql import functions as F

from catalog.base import ORDER_COMPOUNDS, proxy, proxy_sql, query, table
from propspark.functions.hashing import keyed_fold
from propspark.operators import split_scale


def hash_sql(key: str, salt: str, digits: int) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '#{salt}'), 1, {digits}))::BIGINT"


U = f"{hash_sql('o_orderkey', '42', 8)} / 4294967296.0::DOUBLE"
SPLIT = f"CASE WHEN {U} < 0.2 THEN 'test' WHEN {U} < 0.2 + 0.1 THEN 'val' ELSE 'train' END"


@query("split_rows", f"SELECT o_orderkey, o_totalprice, {SPLIT} AS split FROM orders")
def split_rows(spark, sf_dir):
    return split_scale.split(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("split_exact", f"""WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey', '42', 13)}, o_orderkey) AS k FROM orders),
  n AS (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE) AS t FROM orders)
  SELECT o_orderkey, CASE WHEN k <= t THEN 'test' WHEN k <= t + ceil((n - t) * (0.1::DOUBLE / (1 - 0.2::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM h, n""")
def split_exact(spark, sf_dir):
    return split_scale.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", exact=True)


@query("fold_assignment", f"SELECT CAST({hash_sql('o_orderkey', 'fold42', 13)} % 5 AS BIGINT) AS fold, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def fold_assignment(spark, sf_dir):
    fold = keyed_fold(F.col("o_orderkey"), 5).cast("bigint")
    return table(spark, sf_dir, "orders").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


LINE_SPLIT = SPLIT.replace("o_orderkey", "event_id")
COLS = ["value", "user"]
BASE = f"WITH x AS (SELECT event_id, value, CAST(user_id AS DOUBLE) AS \"user\", {LINE_SPLIT} AS split FROM events), t AS (SELECT * FROM x WHERE split = 'train')"
FITS = {
    "standard": "avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}",
    "minmax": "min({c}) AS c_{c}, max({c}) - min({c}) AS s_{c}",
    "robust": "median({c}) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}",
}


def scale_sql(kind: str) -> str:
    fits = ", ".join(FITS[kind].format(c=c).replace("(user)", '("user")') for c in COLS)
    return f"""{BASE}, f AS (SELECT {fits} FROM t) SELECT event_id, split, round((value - c_value) / s_value, 6) AS value,
  round(("user" - c_user) / s_user, 6) AS "user" FROM x, f"""


def _scaled(kind):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"))
        out, _ = split_scale.scale_features(split_scale.split(df, "event_id"), COLS, kind)
        return out.select("event_id", "split", F.round("value", 6).alias("value"), F.round("user", 6).alias("user"))
    return run


for _kind in FITS:
    query(f"scale_{_kind}", scale_sql(_kind))(_scaled(_kind))


@query("scale_targets", f"""{BASE}, f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM t)
  SELECT event_id, round((value - m) / s, 6) AS value, "user" FROM x, f""")
def scale_targets(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    out, _ = split_scale.scale_targets(split_scale.split(df, "event_id"), {"value": "regression", "user": "classification"})
    return out.select("event_id", F.round("value", 6).alias("value"), "user")


@query("inverse_target", 'SELECT event_id, round(value, 6) AS value, CAST(user_id AS DOUBLE) AS "user" FROM events')
def inverse_target(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    out, scaler = split_scale.scale_targets(split_scale.split(df, "event_id"), {"value": "regression"})
    return out.select("event_id", F.round(scaler.inverse("value", F.col("value")), 6).alias("value"), scaler.inverse("user", F.col("user")).alias("user"))
