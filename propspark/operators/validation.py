"""Value and record validation, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propspark.columns import require_columns
from propspark.functions import smiles as sm


def number_text(v: float) -> str:
    return repr(float(v))


def range_error(value: Column, name: str, min_val: float | None = None, max_val: float | None = None) -> Column:
    """Message when the value is not a number within the inclusive range, else null."""
    text = value.cast("string")
    v = text.try_cast("double")
    got = F.concat(F.lit(", got "), F.coalesce(text, F.lit("null")))
    out = F.when(v.isNull(), F.concat(F.lit(f"{name} must be numeric"), got))
    if min_val is not None:
        out = out.when(v < min_val, F.concat(F.lit(f"{name} must be >= {number_text(min_val)}"), got))
    if max_val is not None:
        out = out.when(v > max_val, F.concat(F.lit(f"{name} must be <= {number_text(max_val)}"), got))
    return out


def record_errors(smiles: str = "smiles", mass: str = "molecular_weight", key: str = "cid",
                  min_mass: float = 1.0) -> Column:
    """All errors of a compound record as an array."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"Missing required field: {c}")) for c in (key, smiles, mass)]
    has_text = F.col(smiles).isNotNull() & (F.col(smiles) != "")
    bad_smiles = F.when(has_text, F.concat(F.lit("Invalid SMILES: "), sm.error(F.col(smiles))))
    bad_mass = F.when(F.col(mass).isNotNull(), range_error(F.col(mass), mass, min_mass))
    return F.array_compact(F.array(*missing, bad_smiles, bad_mass))


def validate_records(df: DataFrame, smiles: str = "smiles", mass: str = "molecular_weight",
                     key: str = "cid") -> DataFrame:
    require_columns(df, [smiles, mass, key])
    return df.withColumn("errors", record_errors(smiles, mass, key))


def quarantine(checked: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """``(good rows, bad rows with their errors)`` of a table with an errors array."""
    return checked.where(F.size(errors) == 0).drop(errors), checked.where(F.size(errors) > 0)


def quarantine_summary(checked: DataFrame, errors: str = "errors") -> DataFrame:
    ok = F.size(errors) == 0
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
                       F.count_if(~ok).alias("failed"))


def safe_filename(name: Column, limit: int = 255) -> Column:
    """Path characters and runs of white space become ``_``; cut at ``limit``."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", "_"), 1, limit)
