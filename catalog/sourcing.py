from pyspark.sql import functions as F

from catalog import smiles_sql as sq
from catalog.base import ORDER_COMPOUNDS, molecule, proxy, proxy_sql, query, table
from catalog.cleaning import BOIL_SQL, TOX_PLAIN, tox_sql
from propspark.errors import DataError
from propspark.operators import split_scale
from propspark.session import new_path
from propspark.sources import tables

EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"


@query("csv_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def csv_round_trip(spark, sf_dir):
    path = tables.write_csv(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), new_path(spark, "csv"))
    return tables.read_csv(spark, path, EVENT_SCHEMA)


@query("csv_by_name", """SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 3 = 0 THEN 'user_id' ELSE '' END AS unreadable FROM events""")
def csv_by_name(spark, sf_dir):
    """A file in another column order, with an unknown column and cells that are no numbers."""
    df = table(spark, sf_dir, "events").selectExpr(
        "event_type AS unknown", "CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS STRING) END AS user_id", "value", "event_id")
    path = tables.write_csv(df, new_path(spark, "csv"))
    out = tables.read_csv(spark, path, "event_id bigint, value double, user_id bigint", unreadable="bad")
    return out.select("event_id", "value", "user_id", F.array_join("bad", ",").alias("unreadable"))


@query("csv_missing_column", "SELECT 'missing required columns: [''target'']' AS message, count(*) AS n FROM events")
def csv_missing_column(spark, sf_dir):
    """The error of a declared column that the header lacks."""
    events = table(spark, sf_dir, "events")
    path = tables.write_csv(events.select(F.col("event_type").alias("smiles"), F.col("value").alias("solubility")), new_path(spark, "csv"))
    try:
        tables.read_solubility_csv(spark, path)
        message = ""
    except DataError as exc:
        message = str(exc)
    return events.agg(F.lit(message).alias("message"), F.count(F.lit(1)).alias("n"))


SOLUBLE = {
    "cid": "o_orderkey", "smiles": molecule("o_orderkey"), "target": "o_totalprice / 1.0E5 - 2.0E0",
    **{k: ORDER_COMPOUNDS[k] for k in ("molecular_weight", "xlogp", "hbd", "hba", "rotatable_bonds")},
}
SOLUBLE_ROWS = f"SELECT * FROM ({proxy_sql('orders', SOLUBLE)}) WHERE {sq.parse_error('smiles')} IS NULL"


def _land_solubility(spark, sf_dir):
    return tables.write_csv(proxy(spark, sf_dir, "orders", SOLUBLE), new_path(spark, "solubility"))


SOLUBLE_SCHEMA = "cid bigint, smiles string, target double, molecular_weight double, xlogp double, hbd int, hba int, rotatable_bonds int"


@query("solubility_csv", f"SELECT smiles, round(target, 7) AS solubility FROM ({SOLUBLE_ROWS})")
def solubility_csv(spark, sf_dir):
    out = tables.read_solubility_csv(spark, _land_solubility(spark, sf_dir), SOLUBLE_SCHEMA)
    return out.withColumn("solubility", F.round("solubility", 7))


@query("solubility_csv_first", f"SELECT smiles, round(target, 7) AS solubility FROM ({SOLUBLE_ROWS}) ORDER BY target, smiles LIMIT 400")
def solubility_csv_first(spark, sf_dir):
    out = tables.read_solubility_csv(spark, _land_solubility(spark, sf_dir), SOLUBLE_SCHEMA, 400, ("solubility", "smiles"))
    return out.withColumn("solubility", F.round("solubility", 7))


@query("solubility_csv_targets", f"SELECT cid, smiles, round(target, 7) AS solubility, {tox_sql(TOX_PLAIN)} AS toxicity_category FROM ({SOLUBLE_ROWS})")
def solubility_csv_targets(spark, sf_dir):
    out = tables.read_solubility_csv(spark, _land_solubility(spark, sf_dir), SOLUBLE_SCHEMA, heuristic_targets=True, key="cid")
    return out.select("cid", "smiles", F.round("solubility", 7).alias("solubility"), F.col("toxicity_category").cast("bigint").alias("toxicity_category"))


# each landed file line holds one envelope with two records, built from an event
PROPS = """concat('{"PropertyTable":{"Properties":[{"CID":', event_id, ',"MolecularWeight":', value, ',"XLogP":', get_json_object(props, '$.k'),
  ',"HBondDonorCount":', user_id, ',"CanonicalSMILES":"', event_type, '","Note":"n', event_id, '"},{"CID":', -event_id - 1, ',"Charge":', user_id, '}]}}')"""


@query("property_json", """SELECT event_id AS cid, value AS molecular_weight, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS xlogp, user_id AS hbd, event_type AS smiles,
  CAST(NULL AS BIGINT) AS charge, 'n' || event_id AS "Note", CAST(NULL AS DOUBLE) AS volume_3d FROM events
  UNION ALL SELECT -event_id - 1, NULL, NULL, NULL, NULL, user_id, NULL, NULL FROM events""")
def property_json(spark, sf_dir):
    path = new_path(spark, "property")
    table(spark, sf_dir, "events").selectExpr(f"{PROPS} AS value").write.text(path)
    out = tables.read_property_json(spark, path, "Note string")
    return out.select("cid", "molecular_weight", "xlogp", F.col("hbd").cast("bigint").alias("hbd"), "smiles", F.col("charge").cast("bigint").alias("charge"), "Note", "volume_3d")


# of the envelopes, some are cut off, some are faults, and numbers may be texts
ODD_PROPS = """CASE WHEN event_id % 5 = 0 THEN concat('{"PropertyTable":{"Properties":[{"CID":', event_id) WHEN event_id % 5 = 1 THEN '{"Fault":{"Code":"x"}}'
  ELSE concat('{"PropertyTable":{"Properties":[{"CID":"', event_id, '","HBondDonorCount":"', user_id, '.0","Charge":"high","Odd":"o', user_id, '"}]}}') END"""


@query("property_json_odd", """SELECT event_id AS cid, user_id AS hbd, CAST(NULL AS BIGINT) AS charge, 'o' || user_id AS odd, 'charge' AS unreadable FROM events WHERE event_id % 5 > 1""")
def property_json_odd(spark, sf_dir):
    path = new_path(spark, "odd")
    table(spark, sf_dir, "events").selectExpr(f"{ODD_PROPS} AS value").write.text(path)
    out = tables.read_property_json(spark, path, others="more", unreadable="bad")
    return out.select("cid", F.col("hbd").cast("bigint").alias("hbd"), F.col("charge").cast("bigint").alias("charge"),
                      F.col("more")["Odd"].alias("odd"), F.array_join("bad", ",").alias("unreadable"))


@query("property_json_broken", """SELECT CASE WHEN event_id % 5 = 0 THEN 'not JSON' ELSE 'no PropertyTable.Properties' END AS reason, count(*) AS n
  FROM events WHERE event_id % 5 < 2 GROUP BY 1""")
def property_json_broken(spark, sf_dir):
    path = new_path(spark, "odd")
    table(spark, sf_dir, "events").selectExpr(f"{ODD_PROPS} AS value").write.text(path)
    return tables.broken_envelopes(spark, path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("property_json_pretty", "SELECT CAST(n_nationkey AS BIGINT) AS cid, n_name AS smiles FROM nation")
def property_json_pretty(spark, sf_dir):
    """Envelopes written over several lines, one to a file."""
    path = new_path(spark, "pretty")
    nation = table(spark, sf_dir, "nation")
    nation.selectExpr("""concat('{\n  "PropertyTable": {\n "Properties": [\n {"CID": ', n_nationkey, ',\n "CanonicalSMILES": "', n_name, '"}\n ]\n }\n}') AS value""",
                      "n_nationkey").repartition(nation.count(), "n_nationkey").write.option("maxRecordsPerFile", 1).partitionBy("n_nationkey").text(path)
    return tables.read_property_json(spark, f"{path}/*", multi_line=True).select("cid", "smiles")


SYNS = """concat('{"InformationList":{"Information":[{"CID":', p_partkey, ',"Synonym":', CASE WHEN p_partkey % 5 = 0 THEN concat('"', p_name, '"')
  WHEN p_partkey % 7 = 0 THEN '[]' ELSE concat('["', p_name, '","', p_brand, '","', p_type, '","a","b","c"]') END, '}]}}')"""


@query("synonym_json", """SELECT p_partkey AS cid, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 0 ELSE 5 END AS BIGINT) AS n,
  CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || '|' || p_brand || '|' || p_type || '|a|b' END AS names FROM part""")
def synonym_json(spark, sf_dir):
    path = new_path(spark, "synonym")
    table(spark, sf_dir, "part").selectExpr(f"{SYNS} AS value").write.text(path)
    out = tables.read_synonym_json(spark, path)
    return out.select("cid", F.size("synonyms").cast("bigint").alias("n"), F.array_join("synonyms", "|").alias("names"))


@query("id_json", """SELECT o_orderpriority || o_orderkey AS term, p AS pos, o_orderkey * 10 + p AS cid FROM orders, range(0, 4) r(p) WHERE p <= o_orderkey % 7""")
def id_json(spark, sf_dir):
    path = new_path(spark, "ids")
    table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.concat("o_orderpriority", "o_orderkey").alias("term"),
        F.struct(F.transform(F.sequence(F.lit(0), F.col("o_orderkey") % 7), lambda i: F.col("o_orderkey") * 10 + i).alias("CID")).alias("IdentifierList"),
    )).alias("value")).write.text(path)
    return tables.read_id_json(spark, path, 4).withColumn("pos", F.col("pos").cast("bigint"))


@query("split_sink", """SELECT split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT o_totalprice, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders)) GROUP BY 1""")
def split_sink(spark, sf_dir):
    path = new_path(spark, "splits")
    tables.write_splits(split_scale.split(table(spark, sf_dir, "orders"), "o_orderkey"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("slim_table", "SELECT doc_id, n_chars, lang FROM documents")
def slim_table(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", "lang", F.length("text").alias("Morgan_0"), F.length("source").alias("MACCS_0"))
    path = new_path(spark, "slim")
    tables.slim(df).write.parquet(path)
    return spark.read.parquet(path)
