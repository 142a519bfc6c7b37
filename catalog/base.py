"""Query registry and the proxy inputs both engines share.

Proxy columns are SQL text that Spark and DuckDB read the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proxy(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def proxy_sql(name: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {name}"


# fixed values: acceptance molecules (the first ten), then texts that fail or have rarer syntax; chosen by key
MOLECULES = (
    "CCO", "c1ccccc1", "CC(C)C", "CCN(CC)CC", "CC(=O)O", "CCCCCCCCCC", "c1ccc(cc1)O", "CC(C)CO", "CCCC(=O)O",
    "CC(C)(C)C", "XYZ123!!!", "[Na]", "CCO@#$", "N[C@@H](C)C(=O)O", "[NH4+].[Cl-]",
    "O=C([O-])c1ccccc1[N+](=O)[O-]", "C#N", "C%12CCCCC%12Br", "CC(C", "C1CC", "", "C CO",
)


def molecule(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MOLECULES))
    return f"CASE {key} % {len(MOLECULES) + 1} {whens} ELSE NULL END"


# one compound record per order line or per order
def compound_columns(key: str, price: str, a: str, b: str) -> dict[str, str]:
    return {
        "cid": key,
        "molecular_weight": f"CASE WHEN {a} % 17 = 0 THEN NULL ELSE sqrt({price}) * 3.1E0 END",
        "xlogp": f"CASE WHEN {a} % 13 = 0 THEN NULL ELSE ({a} % 90) / 9.7E0 - 1.5E0 END",
        "tpsa": f"({a} % 83) * 1.7E0",
        "hbd": f"CAST({a} % 7 AS INT)",
        "hba": f"CASE WHEN {b} % 19 = 0 THEN NULL ELSE CAST({b} % 11 AS INT) END",
        "rotatable_bonds": f"CAST({b} % 8 AS INT)",
        "complexity": f"({b} % 61) * 13.1E0",
        "charge": f"CAST({b} % 5 - 2 AS INT)",
        "smiles": molecule(a),
    }


LINE_COMPOUNDS = compound_columns("l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey")
ORDER_COMPOUNDS = compound_columns("o_orderkey", "o_totalprice", "o_custkey", "o_orderkey")

FEATURES = [f"e{i:02d}" for i in range(64)]


def embedding_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as 64 double columns with the class label."""
    cols = [f"CAST(embedding[{i}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES)]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", *cols)


# the same in long form, as the first table of a WITH list
EMB_LONG = (
    "emb AS (SELECT vec_id, CAST(label AS BIGINT) AS label, format('e{:02d}', unnest(range(0, 64))) AS feature, "
    "CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
)
