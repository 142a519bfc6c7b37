from pyspark.sql import functions as F

from catalog import smiles_sql as sq
from catalog.base import EMB_LONG, ORDER_COMPOUNDS, molecule, proxy, proxy_sql, query, table
from catalog.cleaning import BOIL_SQL, PART_MOL, SOL_SQL, TOX_PLAIN, TOX_SCORE, tox_sql
from catalog.profiling import _long
from propspark.functions import smiles as sm
from propspark.operators import descriptors, joins
from propspark.plans.compounds import assemble_compounds

MOLS = {"mol_id": "o_orderkey", "smiles": molecule("o_orderkey")}
COUNTS_SQL = ", ".join(f"{e} AS {n}" for n, e in sq.counts("smiles").items())
NAMES = list(sm.COUNT_NAMES)


def as_long(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names or t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


@query("smiles_counts", f"SELECT mol_id, {COUNTS_SQL} FROM ({proxy_sql('orders', MOLS)}) WHERE smiles IS NOT NULL")
def smiles_counts(spark, sf_dir):
    df = proxy(spark, sf_dir, "orders", MOLS).where("smiles IS NOT NULL")
    return as_long(df.select("mol_id", *[c.alias(n) for n, c in sm.counts(F.col("smiles")).items()]))


@query("descriptor_batch", f"""SELECT mol_id, {', '.join(f'CASE WHEN error IS NULL THEN {n} END AS {n}' for n in NAMES)}, coalesce(error, '') AS error
  FROM (SELECT mol_id, {COUNTS_SQL}, {sq.error('smiles')} AS error FROM ({proxy_sql('orders', MOLS)}))""")
def descriptor_batch(spark, sf_dir):
    out = descriptors.compute_descriptors(proxy(spark, sf_dir, "orders", MOLS), "mol_id")
    return as_long(out).withColumn("error", F.coalesce("error", F.lit("")))



@query("descriptor_hook", f"""SELECT mol_id, CASE WHEN error IS NULL THEN heavy_atoms END AS heavy_atoms,
  CASE WHEN error IS NULL THEN CAST(length(smiles) AS DOUBLE) END AS text_length, coalesce(error, '') AS error
  FROM (SELECT mol_id, smiles, {COUNTS_SQL}, {sq.error('smiles')} AS error FROM ({proxy_sql('part', PART_MOL)}))""")
def descriptor_hook(spark, sf_dir):
    def length_feature(pdf):
        import pandas as pd
        return pd.DataFrame({"text_length": pdf["smiles"].str.len().astype("float64")}, index=pdf.index)

    spec = descriptors.DescriptorSet(descriptor_fn=length_feature, descriptor_schema="text_length double")
    out = descriptors.compute_descriptors(proxy(spark, sf_dir, "part", PART_MOL), "mol_id", "smiles", spec)
    return as_long(out.select("mol_id", "heavy_atoms", "text_length", F.coalesce("error", F.lit("")).alias("error")))


@query("descriptor_merge", f"""SELECT s.mol_id, coalesce(s.smiles, '') AS smiles, {', '.join('d.' + n for n in NAMES)} FROM ({proxy_sql('orders', MOLS)}) s LEFT JOIN
  (SELECT * FROM (SELECT mol_id, {COUNTS_SQL}, {sq.error('smiles')} AS error FROM ({proxy_sql('orders', MOLS)})) WHERE error IS NULL) d ON d.mol_id = s.mol_id""")
def descriptor_merge(spark, sf_dir):
    out = descriptors.describe_dataframe(proxy(spark, sf_dir, "orders", MOLS), "mol_id")
    return as_long(out).withColumn("smiles", F.coalesce("smiles", F.lit("")))


# patterns that RE2 and Java read the same way
PATTERNS = ("[0-9]{4}", "@", "http", "[A-Z][a-z]+ [A-Z]", r"\?", "[aeiou]{3}", "([0-9])[.,]", "the", "ou", r"\n\n", "e[rn] ", "#", "é")
BITS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {i} END" for i, p in enumerate(PATTERNS)) + "], lambda x: x IS NOT NULL)"


@query("key_fingerprint", f"SELECT doc_id, array_to_string({BITS_SQL}, ',') AS bits FROM documents")
def key_fingerprint(spark, sf_dir):
    bits = descriptors.key_bits(F.col("text"), PATTERNS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(bits.cast("array<string>"), ",").alias("bits"))


@query("fingerprint_density", f"SELECT doc_id, CAST(len({BITS_SQL}) AS BIGINT) AS bits_set, round(100.0 * (1 - len({BITS_SQL}) / 167.0), 2) AS sparsity_pct FROM documents")
def fingerprint_density(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", descriptors.key_bits(F.col("text"), PATTERNS).alias("bits"))
    n, sparsity = descriptors.bit_density(F.col("bits"), descriptors.KEY_BITS)
    return df.select("doc_id", n.cast("bigint").alias("bits_set"), sparsity.alias("sparsity_pct"))


NAMED = "CASE WHEN i % 4 = 0 THEN 'Morgan_' || i WHEN i % 4 = 1 THEN 'MACCS_' || i WHEN i = 2 THEN 'MolWt' WHEN i = 6 THEN 'TPSA' ELSE 'Chi' || i END"


@query("feature_groups", f"""WITH {EMB_LONG}, n AS (SELECT vec_id, value, {NAMED} AS feature FROM (SELECT vec_id, value, CAST(substr(feature, 2) AS INT) AS i FROM emb))
  SELECT vec_id, CASE WHEN feature LIKE 'Morgan\\_%' ESCAPE '\\' OR feature LIKE 'MACCS\\_%' ESCAPE '\\' THEN 'fingerprint' WHEN feature IN ('MolWt', 'TPSA') THEN 'physicochemical' ELSE 'topological' END AS category,
  count(*) AS n, count(*) FILTER (WHERE value > 0) AS bits_set FROM n GROUP BY 1, 2""")
def feature_groups(spark, sf_dir):
    long = _long(spark, sf_dir).withColumn("i", F.substring("feature", 2, 2).cast("int"))
    return descriptors.feature_groups(long.withColumn("feature", F.expr(NAMED)), "vec_id")


# --- graphs: turns of a conversation as atoms, every third conversation closed to a ring ---------


def graph(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    atoms = conv.select(F.col("conv_id").alias("mol_id"), F.col("turn").alias("atom_id"), F.substring("role", 1, 1).alias("symbol"))
    chain = conv.where("turn > 0").selectExpr("conv_id AS mol_id", "turn - 1 AS src", "turn AS dst", "CAST(1 AS BIGINT) AS order")
    ends = conv.groupBy("conv_id").agg(F.max("turn").alias("last")).where("conv_id % 3 = 0 AND last >= 2")
    rings = ends.selectExpr("conv_id AS mol_id", "CAST(0 AS BIGINT) AS src", "last AS dst", "CAST(2 AS BIGINT) AS order")
    return atoms, chain.unionByName(rings)


SIZES = "WITH n AS (SELECT conv_id AS mol_id, count(*) AS n FROM conversations GROUP BY 1)"


@query("zagreb_index", f"{SIZES} SELECT mol_id, CAST(CASE WHEN n = 1 THEN 0 WHEN mol_id % 3 = 0 AND n >= 3 THEN 4 * n ELSE 4 * (n - 2) + 2 END AS BIGINT) AS zagreb FROM n")
def zagreb_index(spark, sf_dir):
    atoms, bonds = graph(spark, sf_dir)
    return descriptors.zagreb_index(bonds, atoms)


@query("wiener_index", f"""{SIZES} SELECT mol_id, CAST(CASE WHEN mol_id % 3 = 0 AND n >= 3 THEN CASE WHEN n % 2 = 0 THEN n * n * n // 8 ELSE n * (n * n - 1) // 8 END
  ELSE n * (n * n - 1) // 6 END AS BIGINT) AS wiener FROM n""")
def wiener_index(spark, sf_dir):
    atoms, bonds = graph(spark, sf_dir)
    return descriptors.wiener_index(bonds, atoms)


def _h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _round_sql(r: int) -> str:
    x = _h('e."order"', "p.h")
    return f"""s{r} AS (SELECT e.mol_id, e.a AS atom_id, count(*) AS n, CAST(sum({x}) AS BIGINT) AS s1, CAST(sum(({x} % 65521) * ({x} % 65521)) AS BIGINT) AS s2
    FROM edges e JOIN r{r - 1} p ON p.mol_id = e.mol_id AND p.atom_id = e.b GROUP BY 1, 2),
  r{r} AS (SELECT p.mol_id, p.atom_id, {_h(f"'{r}'", 'p.h', 'coalesce(n, 0)', 'coalesce(s1, 0)', 'coalesce(s2, 0)')} AS h
    FROM r{r - 1} p LEFT JOIN s{r} s ON s.mol_id = p.mol_id AND s.atom_id = p.atom_id)"""


CIRCULAR_SQL = f"""WITH bonds AS (SELECT conv_id AS mol_id, turn - 1 AS src, turn AS dst, 1 AS "order" FROM conversations WHERE turn > 0
  UNION ALL SELECT conv_id, 0, max(turn), 2 FROM conversations GROUP BY 1 HAVING conv_id % 3 = 0 AND max(turn) >= 2),
  edges AS (SELECT mol_id, src AS a, dst AS b, "order" FROM bonds UNION ALL SELECT mol_id, dst, src, "order" FROM bonds),
  r0 AS (SELECT conv_id AS mol_id, turn AS atom_id, {_h("'atom'", 'substr(role, 1, 1)')} AS h FROM conversations),
  {_round_sql(1)}, {_round_sql(2)},
  bits AS (SELECT DISTINCT mol_id, h % 2048 AS bit FROM (SELECT mol_id, h FROM r0 UNION ALL SELECT mol_id, h FROM r1 UNION ALL SELECT mol_id, h FROM r2))
  SELECT mol_id, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM bits GROUP BY 1"""


@query("circular_fingerprint", CIRCULAR_SQL)
def circular_fingerprint(spark, sf_dir):
    atoms, bonds = graph(spark, sf_dir)
    out = descriptors.circular_fingerprint(atoms, bonds)
    return out.select("mol_id", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


# --- joins and assembly -------------------------------------------------------------------------


# every fourth customer is keyed so that no order matches it
UNMATCHED = "CASE WHEN c_custkey % 4 = 0 THEN -c_custkey - 1 ELSE c_custkey END"
NAMED_CUSTOMERS = f"SELECT *, {UNMATCHED} AS c_id FROM customer"


@query("synonym_lookup", f"""SELECT o_orderkey, o_custkey AS cid, coalesce(c_mktsegment || ',' || c_name, '') AS synonyms, coalesce(c_mktsegment, '') AS common_name
  FROM orders LEFT JOIN ({NAMED_CUSTOMERS}) c ON c_id = o_custkey""")
def synonym_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.expr(UNMATCHED).alias("cid"), F.array("c_mktsegment", "c_name").alias("synonyms"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cid"))
    out = joins.lookup_synonyms(orders, names)
    return out.select("o_orderkey", "cid", F.array_join("synonyms", ",").alias("synonyms"), F.coalesce("common_name", F.lit("")).alias("common_name"))


@query("merge_by_key", """SELECT o_orderkey, o_totalprice, l.lines, l.qty FROM orders LEFT JOIN
  (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def merge_by_key(spark, sf_dir):
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"))
    return joins.merge_by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), right, "o_orderkey")


@query("ordered_features", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(0 AS DOUBLE) AS unknown, p_retailprice FROM part")
def ordered_features(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", *joins.ordered_features(df, ["p_size", "unknown", "p_retailprice"]))


@query("ordered_features_long", """SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'purchase'), 0) AS purchase,
  coalesce(max(value) FILTER (WHERE event_type = 'click'), 0) AS click, CAST(0 AS DOUBLE) AS absent FROM events GROUP BY 1""")
def ordered_features_long(spark, sf_dir):
    long = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("feature"), "value")
    return joins.select_features_long(long, ["purchase", "click", "absent"], "user_id")


ATTACH = {k: v for k, v in ORDER_COMPOUNDS.items() if k not in ("charge", "complexity")}


@query("attach_targets", f"SELECT cid, {BOIL_SQL} AS boiling_point, {tox_sql(TOX_PLAIN)} AS toxicity_category FROM ({proxy_sql('orders', ORDER_COMPOUNDS)})")
def attach_targets(spark, sf_dir):
    out = descriptors.attach_heuristic_targets(proxy(spark, sf_dir, "orders", ORDER_COMPOUNDS), "cid", noise_sd=0.0)
    return as_long(out.select("cid", "boiling_point", "toxicity_category"))


RAW = {**ORDER_COMPOUNDS, "cid": "o_custkey", "pos": "o_orderkey"}
COLLECT_SQL = f"""WITH batches AS (SELECT 0 AS batch, * FROM ({proxy_sql('orders', RAW)}) UNION ALL
  SELECT 1 AS batch, * REPLACE (molecular_weight + 300 AS molecular_weight) FROM ({proxy_sql('orders', RAW)})),
  kept AS (SELECT * FROM batches WHERE molecular_weight BETWEEN 50 AND 1000 AND {sq.parse_error('smiles')} IS NULL),
  one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY cid ORDER BY batch, pos) = 1)
  SELECT cid, pos, smiles, coalesce(c_mktsegment || ',' || c_name, '') AS synonyms, coalesce(c_mktsegment, '') AS common_name, {COUNTS_SQL},
  {tox_sql(TOX_SCORE)} AS toxicity_category, {BOIL_SQL} AS boiling_point, {SOL_SQL} AS solubility
  FROM one LEFT JOIN ({NAMED_CUSTOMERS}) c ON c_id = cid"""


@query("collect_compounds", COLLECT_SQL)
def collect_compounds(spark, sf_dir):
    raw = proxy(spark, sf_dir, "orders", RAW)
    batches = [raw.withColumn("batch", F.lit(0)), raw.withColumn("batch", F.lit(1)).withColumn("molecular_weight", F.col("molecular_weight") + 300)]
    names = table(spark, sf_dir, "customer").select(F.expr(UNMATCHED).alias("cid"), F.array("c_mktsegment", "c_name").alias("synonyms"))
    out = assemble_compounds(batches, names, noise_sd=(0.0, 0.0))
    return as_long(out.select("cid", "pos", "smiles", F.array_join("synonyms", ",").alias("synonyms"), F.coalesce("common_name", F.lit("")).alias("common_name"),
                              *NAMES, "toxicity_category", "boiling_point", "solubility"))
