"""Heuristic property formulas. Null and NaN inputs both count as missing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from propspark.functions.hashing import keyed_gauss


def _known(col: Column | None) -> Column:
    if col is None:
        return F.lit(None).cast("double")
    d = col.cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def _or(col: Column | None, default: float) -> Column:
    return F.coalesce(_known(col), F.lit(float(default)))


def _mass(col: Column) -> Column:
    m = _or(col, 200.0)
    return F.when(m == 0.0, 200.0).otherwise(m)


def toxicity_category(mw: Column, logp: Column, hbd: Column, hba: Column,
                      complexity: Column | None = None, charge: Column | None = None) -> Column:
    lp = _known(logp)
    # fixed values: alert thresholds and their points
    score = (
        F.when(_or(mw, 200.0) > 500, 1).otherwise(0)
        + F.when(lp > 5, 2).when(lp > 3, 1).otherwise(0)
        + F.when(_or(hbd, 0) + _or(hba, 0) > 12, 1).otherwise(0)
        + F.when(_or(complexity, 0) > 500, 1).otherwise(0)
        + F.when(F.abs(_or(charge, 0)) > 1, 1).otherwise(0)
    )
    return F.when(score <= 1, 0).when(score <= 3, 1).when(score <= 5, 2).otherwise(3)


def _noise(key: Column | None, seed: int | str, sd: float) -> Column:
    if sd == 0.0:
        return F.lit(0.0)
    if key is None:
        raise ValueError("noise needs a key column")
    return keyed_gauss(key, seed, sd)


def boiling_point(mw: Column, logp: Column, hba: Column, hbd: Column, rotatable_bonds: Column,
                  key: Column | None = None, noise_sd: float = 20.0, seed: int | str = 42) -> Column:
    bp = (
        F.lit(100.0) + F.lit(0.5) * _mass(mw) + F.lit(10.0) * _or(logp, 0)
        - F.lit(15.0) * (_or(hba, 0) + _or(hbd, 0)) + F.lit(5.0) * _or(rotatable_bonds, 0)
        + _noise(key, f"bp{seed}", noise_sd)
    )
    return F.round(F.greatest(F.lit(-100.0), F.least(F.lit(800.0), bp)), 2)


def solubility_mol_per_l(mw: Column, logp: Column, hba: Column, hbd: Column, tpsa: Column,
                         key: Column | None = None, noise_sd: float = 0.5, seed: int | str = 42) -> Column:
    mass = _mass(mw)
    lp = F.coalesce(_known(logp), F.lit(0.1) * F.sqrt(mass) - F.lit(1.0))
    log_s = (
        F.lit(0.8) - F.lit(0.01) * (mass - F.lit(100.0)) - F.lit(0.5) * lp - F.lit(0.01) * _or(tpsa, 0)
        + F.lit(0.3) * (_or(hba, 0) + _or(hbd, 0)) + _noise(key, f"sol{seed}", noise_sd)
    )
    # 10^log_s leaves the double range long after the clamp has been reached
    power = F.pow(F.lit(10.0), F.greatest(F.lit(-300.0), F.least(F.lit(300.0), log_s)))
    return F.round(F.greatest(F.lit(1e-10), F.least(F.lit(100.0), power)), 6)
