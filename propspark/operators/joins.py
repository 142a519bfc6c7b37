"""Key lookups. Spark chooses broadcast or sort-merge from the measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propspark.columns import clean_double


def lookup_synonyms(compounds: DataFrame, synonyms: DataFrame, key: str = "cid") -> DataFrame:
    """Left lookup; unmatched keys get an empty list, ``common_name`` is the first name."""
    joined = compounds.join(synonyms.select(key, "synonyms"), key, "left")
    names = F.coalesce("synonyms", F.array().cast("array<string>"))
    return joined.withColumn("synonyms", names).withColumn("common_name", F.get("synonyms", 0))


def merge_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Attach computed columns by key; columns of ``left`` win on a name clash."""
    extra = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*extra), key, "left")


def ordered_features(df: DataFrame, names: Sequence[str], default: float = 0.0) -> list[Column]:
    """The named columns in order; an absent column, null or NaN becomes ``default``."""
    have = set(df.columns)
    return [
        (F.coalesce(clean_double(df, n), F.lit(default)) if n in have else F.lit(default)).alias(n)
        for n in names
    ]


def select_features_long(long: DataFrame, names: Sequence[str], key: str, default: float = 0.0) -> DataFrame:
    """The named features in order, one row per key, from the long form."""
    return long.groupBy(key).agg(*[
        F.coalesce(F.max(F.when((F.col("feature") == n) & ~F.isnan("value"), F.col("value"))), F.lit(default)).alias(n) for n in names
    ])


def project_available(df: DataFrame, features: Sequence[str], targets: Sequence[str],
                      key: str | None = None) -> tuple[DataFrame, dict]:
    """The wanted columns that exist, and what was found."""
    have_f = [c for c in features if c in df.columns]
    have_t = [c for c in targets if c in df.columns]
    meta = {
        "feature_columns": have_f, "target_columns": have_t, "n_features": len(have_f), "n_targets": len(have_t),
        "missing": sorted((set(features) | set(targets)) - set(df.columns)),
        "key": key,
    }
    return df.select(*([key] if key else []), *have_f, *have_t), meta
