"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from propspark.columns import require_columns
from propspark.errors import DataError
from propspark.functions import smiles as sm
from propspark.operators.cleaning import drop_missing
from propspark.session import materialize
from propspark.operators.descriptors import FINGERPRINT_PREFIXES, attach_heuristic_targets

# fixed values: source property names, our column names and types
PROPERTY_COLUMNS = (
    ("CID", "cid", "bigint"),
    ("MolecularWeight", "molecular_weight", "double"),
    ("XLogP", "xlogp", "double"),
    ("TPSA", "tpsa", "double"),
    ("HBondDonorCount", "hbd", "int"),
    ("HBondAcceptorCount", "hba", "int"),
    ("RotatableBondCount", "rotatable_bonds", "int"),
    ("ExactMass", "exact_mass", "double"),
    ("CanonicalSMILES", "smiles", "string"),
    ("IUPACName", "iupac_name", "string"),
    ("InChI", "inchi", "string"),
    ("MolecularFormula", "molecular_formula", "string"),
    ("Charge", "charge", "int"),
    ("Complexity", "complexity", "double"),
    ("IsotopeAtomCount", "isotope_count", "int"),
    ("DefinedAtomStereoCount", "defined_stereo_atoms", "int"),
    ("UndefinedAtomStereoCount", "undefined_stereo_atoms", "int"),
    ("DefinedBondStereoCount", "defined_stereo_bonds", "int"),
    ("UndefinedBondStereoCount", "undefined_stereo_bonds", "int"),
    ("CovalentUnitCount", "covalent_units", "int"),
    ("Volume3D", "volume_3d", "double"),
)
SYNONYMS_KEPT = 5


def read_csv(spark: SparkSession, path: str, schema: str, unreadable: str | None = None) -> DataFrame:
    """CSV with a header; the declared columns are found by name, wherever they stand, and others are left out.

    A missing path or a column missing from the header is an error, as is a file whose header differs from the first
    one's. A cell that does not fit its type becomes null; ``unreadable`` names a column that lists such cells.
    """
    try:
        text = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"data file not found: {path}") from exc
        raise
    wanted = StructType.fromDDL(schema)
    require_columns(text, wanted.names)
    cells = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in wanted.fields}
    out = [c.alias(n) for n, c in cells.items()]
    if unreadable:
        out.append(_unreadable({n: (F.col(f"`{n}`"), c) for n, c in cells.items()}).alias(unreadable))
    return text.select(*out)


def _unreadable(cells: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the cells with a text but no value."""
    return F.array_compact(F.array(*[F.when(raw.isNotNull() & value.isNull(), n) for n, (raw, value) in cells.items()]))


def read_solubility_csv(spark: SparkSession, path: str, schema: str = "smiles string, target double",
                        n: int | None = None, order: Sequence[str] = ("smiles", "solubility"),
                        heuristic_targets: bool = False, key: str = "smiles") -> DataFrame:
    """SMILES and measured solubility; null and unparsable SMILES are dropped.

    ``n`` keeps the first rows in ``order``. Heuristic targets need the descriptor
    columns ``molecular_weight, xlogp, hbd, hba, rotatable_bonds`` in the file.
    """
    if not {"smiles", "target"} <= set(StructType.fromDDL(schema).names):
        raise DataError("the schema needs the columns smiles and target")
    df = read_csv(spark, path, schema)
    df = df.withColumnRenamed("target", "solubility")
    extra = [c for c in df.columns if c not in ("smiles", "solubility")]
    df = df.select("smiles", "solubility", *(extra if heuristic_targets else []))
    df = drop_missing(df, ["smiles"]).where(sm.parse_error(F.col("smiles")).isNull())
    if n is not None:
        df = df.orderBy(*order).limit(n)
    if heuristic_targets:
        df = attach_heuristic_targets(df, key).select(
            "smiles", "solubility", "boiling_point", "toxicity_category", *[c for c in extra if c == key])
    return df


def _envelopes(spark: SparkSession, path: str, schema: str, items: str, multi_line: bool) -> DataFrame:
    """Texts of landed files (a line each, or whole files) beside their ``items``; null items mark a broken envelope."""
    raw = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    return raw.select("value", F.from_json("value", schema)[items.split(".")[0]][items.split(".")[1]].alias("items"))


PROPERTIES = ("PropertyTable struct<Properties: array<map<string,string>>>", "PropertyTable.Properties")
IDENTIFIERS = ("IdentifierList struct<CID: array<string>>", "IdentifierList.CID")
INFORMATION = ("InformationList struct<Information: array<struct<CID: string, Synonym: string>>>", "InformationList.Information")


def broken_envelopes(spark: SparkSession, path: str, kind: tuple[str, str] = PROPERTIES, multi_line: bool = False) -> DataFrame:
    """Quarantine: ``value, reason`` of every landed text that the readers cannot use."""
    bad = _envelopes(spark, path, *kind, multi_line).where("items is null")
    return bad.select("value", F.when(F.from_json("value", "map<string,string>").isNull(), "not JSON").otherwise(
        F.concat(F.lit("no "), F.lit(kind[1]))).alias("reason"))


def _number(text: Column, kind: str) -> Column:
    """The number in a text; whole numbers may be written with a decimal point."""
    if kind in ("bigint", "int"):
        return F.coalesce(text.try_cast(kind), F.when(text.try_cast("double") % 1 == 0, text.try_cast("double").try_cast(kind)))
    return text.try_cast(kind)


def read_property_json(spark: SparkSession, path: str, extra: str = "", multi_line: bool = False, others: str | None = None,
                       unreadable: str | None = None) -> DataFrame:
    """Compound properties out of landed property envelopes, one to a line or, with ``multi_line``, one to a file.

    Numbers may be written as text. ``extra`` declares further keys (``Name type, ...``), passed through unrenamed;
    ``others`` names a column (map of texts) for all keys not declared and ``unreadable`` one that lists the cells that are
    not of their type. Envelopes that cannot be read at all are in ``broken_envelopes``.
    """
    more = [p.strip().split(" ", 1) for p in extra.split(",") if p.strip()]
    item = _envelopes(spark, path, *PROPERTIES, multi_line).select(F.explode("items").alias("p"))
    cells = {name: (F.col("p")[src], _number(F.col("p")[src], kind)) for src, name, kind in
             [*PROPERTY_COLUMNS, *((n, n, t) for n, t in more)]}
    out = [value.alias(name) for name, (_, value) in cells.items()]
    if others:
        known = [src for src, _, _ in PROPERTY_COLUMNS] + [n for n, _ in more]
        out.append(F.map_filter("p", lambda k, _: ~k.isin(known)).alias(others))
    if unreadable:
        out.append(_unreadable(cells).alias(unreadable))
    return item.select(*out)


def read_synonym_json(spark: SparkSession, path: str, keep: int = SYNONYMS_KEPT, multi_line: bool = False) -> DataFrame:
    """``cid, synonyms``: the first names per compound; a single string counts as a list of one."""
    item = _envelopes(spark, path, *INFORMATION, multi_line).select(F.explode("items").alias("i"))
    text = F.col("i.Synonym")
    names = F.when(text.isNull(), F.array().cast("array<string>")).when(
        text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return item.select(_number(F.col("i.CID"), "bigint").alias("cid"), F.slice(names, 1, keep).alias("synonyms"))


def read_id_json(spark: SparkSession, path: str, n: int, multi_line: bool = False) -> DataFrame:
    """``term, pos, cid``: the first ``n`` ids of each landed search result, in document order; one to a line or to a file.

    Ids may be written as text. What cannot be read is in ``broken_envelopes(..., kind=IDENTIFIERS)``.
    """
    found = _envelopes(spark, path, *IDENTIFIERS, multi_line).select(F.get_json_object("value", "$.term").alias("term"), "items")
    ids = found.select("term", F.posexplode(F.slice("items", 1, n)).alias("pos", "id"))
    return ids.select("term", "pos", _number(F.col("id"), "bigint").alias("cid"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, str]:
    """One folder per split; returns their paths."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return {s: f"{path}/split={s}" for s in ("train", "val", "test")}


def slim(df: DataFrame) -> DataFrame:
    """The feature table without the fingerprint columns."""
    return df.drop(*[c for c in df.columns if c.startswith(FINGERPRINT_PREFIXES)])


def write_metrics_report(spark: SparkSession, path: str, metrics: DataFrame, **facts) -> str:
    """One JSON record with run facts and ``metrics[target_model][metric]`` (a few rows)."""
    nested: dict = {}
    for r in metrics.collect():
        nested.setdefault(f"{r['target']}_{r['model_type']}", {})[r["metric"]] = r["value"]
    text = json.dumps({**facts, "metrics": nested}, default=float)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def require_rows(df: DataFrame, message: str = "no rows left") -> DataFrame:
    """The rows of ``df``, written once so that looking for a first one does not run it a second time; an error if there are none."""
    held = materialize(df, "rows")
    if held.isEmpty():
        raise DataError(message)
    return held
