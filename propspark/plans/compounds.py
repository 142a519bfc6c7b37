"""Compound table assembly from landed batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from propspark.functions import formulas, smiles as sm
from propspark.operators.cleaning import dedup_by_key
from propspark.operators.joins import lookup_synonyms
from propspark.session import materialize
from propspark.sources.tables import require_rows, write_csv

def assemble_compounds(batches: Sequence[DataFrame], synonyms: DataFrame | None = None, min_mass: float = 50.0,
                       max_mass: float = 1000.0, require_smiles: bool = True, order: Sequence[str] = ("batch", "pos"),
                       noise_sd: tuple[float, float] = (20.0, 0.5), seed: int = 42, output_path: str | None = None,
                       fail_if_empty: bool = True) -> DataFrame:
    """Union, mass and SMILES filters, first row per ``cid``, names, counts and derived targets.

    Filters and the group limit of the dedup run before the name lookup, so the
    join sees one row per compound whatever the skew of the ids.
    """
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
    df = df.where(F.col("molecular_weight").between(min_mass, max_mass))
    if require_smiles:
        df = df.where(sm.parse_error(F.col("smiles")).isNull())
    df = dedup_by_key(df, ["cid"], order)
    if synonyms is not None:
        # one list per compound, so the lookup cannot repeat rows
        found = [c for c in order if c in synonyms.columns]
        last = F.max_by("synonyms", F.struct(*found)) if found else F.max("synonyms")  # of several lists the last landed
        df = lookup_synonyms(df, synonyms.groupBy("cid").agg(last.alias("synonyms")))
    mw, lp, hba, hbd = F.col("molecular_weight"), F.col("xlogp"), F.col("hba"), F.col("hbd")
    key = F.col("cid")
    df = df.withColumn("_outer", sm.outside(F.col("smiles")))
    df = df.withColumns(sm.counts(F.col("smiles"), F.col("_outer"))).drop("_outer").withColumns({
        "toxicity_category": formulas.toxicity_category(mw, lp, hbd, hba, F.col("complexity"), F.col("charge")),
        "boiling_point": formulas.boiling_point(mw, lp, hba, hbd, F.col("rotatable_bonds"), key, noise_sd[0], seed),
        "solubility": formulas.solubility_mol_per_l(mw, lp, hba, hbd, F.col("tpsa"), key, noise_sd[1], seed),
    })
    if fail_if_empty:
        df = require_rows(df, "no compounds were collected")
    elif output_path:
        df = materialize(df, "compounds")  # written for the file, then read again by the caller
    if output_path:
        flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        write_csv(df.select(*flat), output_path)
    return df
