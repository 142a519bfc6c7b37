from pyspark.sql import functions as F

from catalog.base import (
    FEATURES, LINE_COMPOUNDS, MOLECULES, ORDER_COMPOUNDS, molecule, proxy, proxy_sql, query, table,
)
from catalog import smiles_sql as sq
from propspark.functions import formulas, smiles as sm
from propspark.operators import cleaning, joins, profile, validation

# --- flagship: clean and profile ---------------------------------------------------------------

MESSY = {
    "cid": "l_orderkey", "charge": "l_linenumber",
    "quantity": "l_quantity",
    "price": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice END",
    "discount": "l_discount + 0.0",
    "flag": "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END",
}
NUMBERS = ["quantity", "price", "discount"]


def messy(spark, sf_dir):
    once = proxy(spark, sf_dir, "lineitem", MESSY)
    return once.unionAll(once)


MESSY_CLEAN = f"""
once AS ({proxy_sql('lineitem', MESSY)}),
messy AS (SELECT * FROM once UNION ALL SELECT * FROM once),
uniq AS (SELECT DISTINCT * FROM messy),
med AS (SELECT median(price) AS m FROM uniq),
top AS (SELECT flag AS f FROM uniq WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
full_rows AS (SELECT cid, charge, quantity, coalesce(price, (SELECT m FROM med)) AS price, discount,
  coalesce(flag, (SELECT f FROM top)) AS flag FROM uniq),
q1 AS (SELECT quantile_cont(quantity, 0.25) AS a, quantile_cont(quantity, 0.75) AS b FROM full_rows),
s1 AS (SELECT f.* FROM full_rows f, q1 WHERE quantity BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)),
q2 AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM s1),
s2 AS (SELECT f.* FROM s1 f, q2 WHERE price BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)),
q3 AS (SELECT quantile_cont(discount, 0.25) AS a, quantile_cont(discount, 0.75) AS b FROM s2),
cleaned AS (SELECT f.* FROM s2 f, q3 WHERE discount BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a))
"""


def long_sql(source: str, columns, carry: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {carry}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)


STATS_SQL = """feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) - count(value) AS missing,
  round(100.0 * (count(*) - count(value)) / count(*), 6) AS missing_pct,
  round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75"""


def round_stats(df):
    digits = {"skewness": 5, "kurtosis": 5}
    return df.select(*[
        F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


@query("clean_profile", f"WITH {MESSY_CLEAN}, long AS ({long_sql('cleaned', NUMBERS)}) SELECT {STATS_SQL} FROM long GROUP BY feature")
def clean_profile(spark, sf_dir):
    done = cleaning.clean(messy(spark, sf_dir), ["cid", "price"], True, "impute", "iqr", 0.2)
    return round_stats(profile.feature_stats(done, NUMBERS))


@query("clean_rows", f"""WITH {MESSY_CLEAN} SELECT cid, CAST(charge AS BIGINT) AS charge, quantity, round(price, 4) AS price,
  discount, flag FROM cleaned""")
def clean_rows(spark, sf_dir):
    done = cleaning.clean(messy(spark, sf_dir), outlier_threshold=0.2)
    return done.withColumn("charge", F.col("charge").cast("bigint")).withColumn("price", F.round("price", 4))


@query("clean_audit", f"""WITH {MESSY_CLEAN} SELECT 'duplicates' AS step, (SELECT count(*) FROM messy) AS rows_in, (SELECT count(*) FROM uniq) AS rows_out
  UNION ALL SELECT 'missing', (SELECT count(*) FROM uniq), (SELECT count(*) FROM full_rows)
  UNION ALL SELECT 'outliers', (SELECT count(*) FROM full_rows), (SELECT count(*) FROM cleaned)""")
def clean_audit(spark, sf_dir):
    return cleaning.clean_audit(messy(spark, sf_dir), outlier_threshold=0.2)


# --- rows ---------------------------------------------------------------------------------------

TWICE = "twice AS (SELECT * FROM events UNION ALL SELECT * FROM events)"


def twice(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.unionAll(ev)


@query("drop_duplicate_rows", f"WITH {TWICE} SELECT DISTINCT event_id, user_id, event_type, value, props FROM twice")
def drop_duplicate_rows(spark, sf_dir):
    return cleaning.drop_duplicate_rows(twice(spark, sf_dir)).drop("ts")


@query("dedup_by_key", """SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup_by_key(spark, sf_dir):
    out = cleaning.dedup_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


GAPS = {
    "o_orderkey": "o_orderkey",
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END",
    "priority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
    "status": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END",
    "customer": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END",
}
GAPS_CTE = f"gaps AS (SELECT * REPLACE (CASE WHEN isnan(price) THEN NULL ELSE price END AS price) FROM ({proxy_sql('orders', GAPS)}))"


@query("drop_missing_rows", f"WITH {GAPS_CTE} SELECT o_orderkey, price, priority FROM gaps WHERE price IS NOT NULL AND priority IS NOT NULL")
def drop_missing_rows(spark, sf_dir):
    return cleaning.drop_missing(proxy(spark, sf_dir, "orders", GAPS), ["price", "priority"]).select("o_orderkey", "price", "priority")


@query("impute_gaps", f"""WITH {GAPS_CTE}, m AS (SELECT median(price) AS p, median(customer) AS c FROM gaps),
  a AS (SELECT priority AS v FROM gaps WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  b AS (SELECT status AS v FROM gaps WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT o_orderkey, round(coalesce(price, m.p), 4) AS price, coalesce(priority, a.v) AS priority,
  coalesce(status, b.v) AS status, CAST(coalesce(customer, m.c) AS DOUBLE) AS customer FROM gaps, m, a, b""")
def impute_gaps(spark, sf_dir):
    return cleaning.impute(proxy(spark, sf_dir, "orders", GAPS)).withColumn("price", F.round("price", 4))


@query("outliers_iqr", """WITH q1 AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem),
  s1 AS (SELECT l.* FROM lineitem l, q1 WHERE l_quantity BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)),
  q2 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM s1),
  s2 AS (SELECT l.* FROM s1 l, q2 WHERE l_extendedprice BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)),
  q3 AS (SELECT quantile_cont(l_tax, 0.25) AS a, quantile_cont(l_tax, 0.75) AS b FROM s2)
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_tax + 0.0 AS l_tax FROM s2, q3
  WHERE l_tax BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)""")
def outliers_iqr(spark, sf_dir):
    out = cleaning.remove_outliers_iqr(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 0.2)
    return out.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", (F.col("l_tax") + 0.0).alias("l_tax"))


@query("outliers_iqr_joint", """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS b1,
  quantile_cont(l_extendedprice, 0.25) AS a2, quantile_cont(l_extendedprice, 0.75) AS b2 FROM lineitem)
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem, q WHERE l_quantity BETWEEN a1 - 0.3 * (b1 - a1) AND b1 + 0.3 * (b1 - a1)
  AND l_extendedprice BETWEEN a2 - 0.3 * (b2 - a2) AND b2 + 0.3 * (b2 - a2)""")
def outliers_iqr_joint(spark, sf_dir):
    out = cleaning.remove_outliers_iqr(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 0.3, mode="joint")
    return out.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("outliers_zscore", """WITH m1 AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders),
  s1 AS (SELECT o.* FROM orders o, m1 WHERE abs((o_totalprice - m) / s) < 1.2),
  m2 AS (SELECT avg(o_custkey) AS m, stddev_pop(o_custkey) AS s FROM s1)
  SELECT o_orderkey, o_custkey, o_totalprice FROM s1, m2 WHERE abs((o_custkey - m) / s) < 1.2""")
def outliers_zscore(spark, sf_dir):
    out = cleaning.remove_outliers_zscore(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], 1.2)
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


SPECIAL = {
    "event_id": "event_id",
    "value": """CASE WHEN event_id % 5 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 7 = 0 THEN CAST('-Infinity' AS DOUBLE)
      WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN NULL ELSE value END""",
}


@query("non_finite_to_zero", f"""SELECT event_id, CASE WHEN isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS value
  FROM ({proxy_sql('events', SPECIAL)})""")
def non_finite_to_zero(spark, sf_dir):
    return cleaning.non_finite_to_zero(proxy(spark, sf_dir, "events", SPECIAL))


@query("numeric_fill_zero", f"""WITH {GAPS_CTE} SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(customer, 0) AS customer FROM gaps""")
def numeric_fill_zero(spark, sf_dir):
    df = proxy(spark, sf_dir, "orders", GAPS)
    return cleaning.fill_zero(df.select(*profile.numeric_columns(df)))


@query("columns_without_missing", "SELECT o_orderkey FROM orders")
def columns_without_missing(spark, sf_dir):
    return cleaning.drop_columns_with_missing(proxy(spark, sf_dir, "orders", GAPS))


@query("prepare_features", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def prepare_features(spark, sf_dir):
    return joins.project_available(table(spark, sf_dir, "orders"), ["o_totalprice", "absent"], ["o_custkey", "gone"], "o_orderkey")[0]


@query("rename_columns", "SELECT o_orderkey AS cid, o_totalprice AS molecular_weight, o_orderstatus AS o_orderstatus FROM orders")
def rename_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").withColumnsRenamed(
        {"o_orderkey": "cid", "o_totalprice": "molecular_weight"})


# --- validation ---------------------------------------------------------------------------------

PART_MOL = {"mol_id": "p_partkey", "smiles": molecule("p_partkey"), "mass": "CASE WHEN p_partkey % 29 = 0 THEN 6000.0 WHEN p_partkey % 31 = 0 THEN -1.0 ELSE p_retailprice END"}


@query("validate_smiles", f"""SELECT mol_id, coalesce(smiles, '<null>') AS smiles, {sq.error('smiles', 'mass')} IS NULL AS valid,
  coalesce({sq.error('smiles', 'mass')}, '') AS error FROM ({proxy_sql('part', PART_MOL)})""")
def validate_smiles(spark, sf_dir):
    out = proxy(spark, sf_dir, "part", PART_MOL).withColumn("c", sm.check(F.col("smiles"), F.col("mass")))
    return out.select("mol_id", F.coalesce("smiles", F.lit("<null>")).alias("smiles"), "c.valid", F.coalesce("c.error", F.lit("")).alias("error"))


SIZE_TEXT = "CASE WHEN p_partkey % 9 = 0 THEN 'abc' WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR(9)) END"


@query("validate_range", f"""SELECT p_partkey, coalesce(CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 'size must be numeric, got ' || coalesce(v, 'null')
  WHEN try_cast(v AS DOUBLE) < 10 THEN 'size must be >= 10.0, got ' || v WHEN try_cast(v AS DOUBLE) > 40 THEN 'size must be <= 40.0, got ' || v END, 'size is valid') AS message
  FROM (SELECT p_partkey, {SIZE_TEXT} AS v FROM part)""")
def validate_range(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{SIZE_TEXT} AS v")
    return df.select("p_partkey", F.coalesce(validation.range_error(F.col("v"), "size", 10, 40), F.lit("size is valid")).alias("message"))


RECORDS = {
    "pos": "o_orderkey",
    "cid": "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_orderkey END",
    "smiles": molecule("o_orderkey"),
    "molecular_weight": "CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN -2.5 ELSE o_totalprice END",
}
RECORD_ERRORS = f"""concat_ws('; ', CASE WHEN cid IS NULL THEN 'Missing required field: cid' END,
  CASE WHEN smiles IS NULL THEN 'Missing required field: smiles' END,
  CASE WHEN molecular_weight IS NULL THEN 'Missing required field: molecular_weight' END,
  CASE WHEN smiles IS NOT NULL AND smiles <> '' THEN 'Invalid SMILES: ' || {sq.error('smiles')} END,
  CASE WHEN molecular_weight < 1 THEN 'molecular_weight must be >= 1.0, got ' || CAST(molecular_weight AS VARCHAR) END)"""
RECORDS_CTE = f"checked AS (SELECT *, {RECORD_ERRORS} AS errors FROM ({proxy_sql('orders', RECORDS)}))"


@query("validate_records", f"WITH {RECORDS_CTE} SELECT pos, errors, errors = '' AS valid FROM checked")
def validate_records(spark, sf_dir):
    out = validation.validate_records(proxy(spark, sf_dir, "orders", RECORDS))
    return out.select("pos", F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("valid"))


@query("quarantine_good", f"WITH {RECORDS_CTE} SELECT pos, cid, smiles, molecular_weight FROM checked WHERE errors = ''")
def quarantine_good(spark, sf_dir):
    return validation.quarantine(validation.validate_records(proxy(spark, sf_dir, "orders", RECORDS)))[0]


@query("quarantine_bad", f"WITH {RECORDS_CTE} SELECT pos, errors FROM checked WHERE errors <> ''")
def quarantine_bad(spark, sf_dir):
    bad = validation.quarantine(validation.validate_records(proxy(spark, sf_dir, "orders", RECORDS)))[1]
    return bad.select("pos", F.array_join("errors", "; ").alias("errors"))


@query("quarantine_summary", f"""WITH {RECORDS_CTE} SELECT count(*) AS total, count(*) FILTER (WHERE errors = '') AS successful,
  count(*) FILTER (WHERE errors <> '') AS failed FROM checked""")
def quarantine_summary(spark, sf_dir):
    return validation.quarantine_summary(validation.validate_records(proxy(spark, sf_dir, "orders", RECORDS)))


@query("safe_filename", r"""SELECT page_id, substr(regexp_replace(regexp_replace(url || ' <a>  b|c*', '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), 1, 255) AS name FROM pages""")
def safe_filename(spark, sf_dir):
    name = validation.safe_filename(F.concat("url", F.lit(" <a>  b|c*")))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


# --- formulas -----------------------------------------------------------------------------------

MASS = "coalesce(nullif(molecular_weight, 0), 200)"
TOX_SCORE = """(CASE WHEN coalesce(molecular_weight, 200) > 500 THEN 1 ELSE 0 END
  + CASE WHEN xlogp > 5 THEN 2 WHEN xlogp > 3 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(hbd, 0) + coalesce(hba, 0) > 12 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(complexity, 0) > 500 THEN 1 ELSE 0 END + CASE WHEN abs(coalesce(charge, 0)) > 1 THEN 1 ELSE 0 END)"""
TOX_PLAIN = """(CASE WHEN coalesce(molecular_weight, 200) > 500 THEN 1 ELSE 0 END
  + CASE WHEN xlogp > 5 THEN 2 WHEN xlogp > 3 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(hbd, 0) + coalesce(hba, 0) > 12 THEN 1 ELSE 0 END)"""


def tox_sql(score: str) -> str:
    return f"CAST(CASE WHEN {score} <= 1 THEN 0 WHEN {score} <= 3 THEN 1 WHEN {score} <= 5 THEN 2 ELSE 3 END AS BIGINT)"


D = "CAST({} AS DOUBLE)"
BOIL_SQL = f"""round(greatest(-100, least(800, CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {MASS} + CAST(10 AS DOUBLE) * coalesce(xlogp, 0)
  - CAST(15 AS DOUBLE) * (coalesce(hba, 0) + coalesce(hbd, 0)) + CAST(5 AS DOUBLE) * coalesce(rotatable_bonds, 0))), 2)"""
SOL_SQL = f"""round(greatest(1e-10, least(100, pow(10, CAST(0.8 AS DOUBLE) - CAST(0.01 AS DOUBLE) * ({MASS} - 100)
  - CAST(0.5 AS DOUBLE) * coalesce(xlogp, CAST(0.1 AS DOUBLE) * sqrt({MASS}) - 1) - CAST(0.01 AS DOUBLE) * coalesce(tpsa, 0)
  + CAST(0.3 AS DOUBLE) * (coalesce(hba, 0) + coalesce(hbd, 0))))), 6)"""
LINES = proxy_sql("lineitem", LINE_COMPOUNDS)


@query("toxicity_category", f"SELECT cid, {tox_sql(TOX_SCORE)} AS toxicity_category FROM ({LINES})")
def toxicity_category(spark, sf_dir):
    c = F.col
    return proxy(spark, sf_dir, "lineitem", LINE_COMPOUNDS).select("cid", formulas.toxicity_category(
        c("molecular_weight"), c("xlogp"), c("hbd"), c("hba"), c("complexity"), c("charge")).cast("bigint").alias("toxicity_category"))


@query("boiling_point", f"SELECT cid, {BOIL_SQL} AS boiling_point FROM ({LINES})")
def boiling_point(spark, sf_dir):
    c = F.col
    return proxy(spark, sf_dir, "lineitem", LINE_COMPOUNDS).select("cid", formulas.boiling_point(
        c("molecular_weight"), c("xlogp"), c("hba"), c("hbd"), c("rotatable_bonds"), noise_sd=0.0).alias("boiling_point"))


@query("solubility", f"SELECT cid, {SOL_SQL} AS solubility FROM ({LINES})")
def solubility(spark, sf_dir):
    c = F.col
    return proxy(spark, sf_dir, "lineitem", LINE_COMPOUNDS).select("cid", formulas.solubility_mol_per_l(
        c("molecular_weight"), c("xlogp"), c("hba"), c("hbd"), c("tpsa"), noise_sd=0.0).alias("solubility"))


def gauss_sql(key: str, seed: str, sd: str) -> str:
    def num(salt):
        return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '#{salt}'), 1, 8))::BIGINT"
    return (f"{sd} * sqrt(CAST(-2 AS DOUBLE) * ln(({num(seed + 'a')} + 1.0::DOUBLE) / 4294967297.0::DOUBLE)) "
            f"* cos(6.283185307179586::DOUBLE * ({num(seed + 'b')} / 4294967296.0::DOUBLE))")


@query("boiling_point_noise", f"""SELECT cid, round(greatest(-100, least(800, CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {MASS} + CAST(10 AS DOUBLE) * coalesce(xlogp, 0)
  - CAST(15 AS DOUBLE) * (coalesce(hba, 0) + coalesce(hbd, 0)) + CAST(5 AS DOUBLE) * coalesce(rotatable_bonds, 0) + {gauss_sql('cid', 'bp42', '20.0::DOUBLE')})), 2) AS boiling_point
  FROM ({proxy_sql('orders', ORDER_COMPOUNDS)})""")
def boiling_point_noise(spark, sf_dir):
    c = F.col
    return proxy(spark, sf_dir, "orders", ORDER_COMPOUNDS).select("cid", formulas.boiling_point(
        c("molecular_weight"), c("xlogp"), c("hba"), c("hbd"), c("rotatable_bonds"), c("cid")).alias("boiling_point"))
