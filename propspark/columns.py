"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from propspark.errors import DataError

FLOATING = (T.FloatType, T.DoubleType)
# Above this many columns one aggregate with an expression per column costs more
# (planning and generated code) than unpivoting and grouping by feature.
WIDE_AGG_LIMIT = 30


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise DataError(f"missing required columns: {missing}")
    return df


def present(df: DataFrame, name: str) -> Column:
    """True where the column holds a value; NaN counts as missing."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOATING):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def clean_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null and -0.0 into 0.0."""
    col = F.col(f"`{name}`").cast("double") + F.lit(0.0)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(F.isnan(col), None).otherwise(col)
    return col


def _cell(value: Column) -> Column:
    return F.when(~F.isnan(value), value + F.lit(0.0))


def to_long(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Long form ``carry..., feature, value`` of numeric columns as doubles; nulls are kept.

    A few columns go through ``unpivot``; for many, one array per row and
    ``posexplode`` keep the plan and the generated code small.
    """
    keep = [F.col(f"`{c}`") for c in carry]
    raw = {c: F.col(f"`{c}`").cast("double") for c in columns}
    if len(raw) <= WIDE_AGG_LIMIT:
        long = df.select(*keep, *[v.alias(c) for c, v in raw.items()]).unpivot(list(carry), list(raw), "feature", "value")
    else:
        cells = df.select(*keep, F.posexplode(F.array(*raw.values())).alias("_i", "value"))
        label = F.get(F.array(*[F.lit(c) for c in raw]), F.col("_i"))
        long = cells.select(*keep, label.alias("feature"), "value")
    return long.withColumn("value", _cell(F.col("value")))


def array_to_long(df: DataFrame, array_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Long form of an array column; ``feature`` is the position."""
    out = df.select(*[F.col(c) for c in carry], F.posexplode(array_col).alias("feature", "value"))
    return out.withColumn("value", _cell(F.col("value").cast("double")))
