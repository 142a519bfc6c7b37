"""Keyed hashes: numbers that depend on the row key and a seed only.

Splits, folds, samples and noise built on them stay the same under any
partitioning, task retry or executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def _hex_number(key: Column, salt: str, digits: int) -> Column:
    text = F.concat(key.cast("string"), F.lit(f"#{salt}"))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def keyed_uniform(key: Column, seed: int | str = 42) -> Column:
    """A number in [0, 1) for each key."""
    return _hex_number(key, str(seed), 8) / F.lit(TWO_32)


def keyed_long(key: Column, seed: int | str = 42) -> Column:
    """A non-negative 52-bit number for each key, exact as a double."""
    return _hex_number(key, str(seed), 13)


def keyed_fold(key: Column, folds: int, seed: int | str = 42) -> Column:
    return F.pmod(keyed_long(key, f"fold{seed}"), F.lit(folds)).cast("int")


def keyed_gauss(key: Column, seed: int | str, sd: float) -> Column:
    """Normal noise by the Box-Muller transform of two keyed uniforms."""
    u1 = (_hex_number(key, f"{seed}a", 8) + F.lit(1.0)) / F.lit(TWO_32 + 1.0)
    u2 = keyed_uniform(key, f"{seed}b")
    return F.lit(float(sd)) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
