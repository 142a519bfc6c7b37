"""Row and column cleaning: duplicates, missing values, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.columns import (
    FLOATING, WIDE_AGG_LIMIT, clean_double, numeric_columns, present, require_columns, string_columns, to_long,
)
from propspark.operators import sketches
from propspark.operators.outlier_bounds import iqr_bounds, zscore_parameters
from propspark.operators.quantiles import column_quantiles
from propspark.session import materialize

# fixed values: identifier-like columns that outlier removal leaves alone
OUTLIER_EXEMPT = ("cid", "charge")
MISSING_CHUNK = 100  # columns per aggregate when counting gaps in other than numeric columns


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` becomes a group limit on both sides of the shuffle, so a
    hot key sends at most one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a value in every column of ``subset`` (default: all columns)."""
    return df.where(reduce(lambda a, b: a & b, [present(df, c) for c in subset or df.columns]))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return {}
    many = [c for c in numeric_columns(df) if c in set(columns)]
    if len(many) <= WIDE_AGG_LIMIT:
        many = []
    few = [c for c in columns if c not in set(many)]
    out: dict[str, int] = {}
    for at in range(0, len(few), MISSING_CHUNK):
        chunk = few[at:at + MISSING_CHUNK]
        row = df.agg(*[F.count_if(~present(df, c)).alias(f"n{i}") for i, c in enumerate(chunk)]).first()
        out.update({c: row[f"n{i}"] for i, c in enumerate(chunk)})
    if many:
        gone = to_long(df, many).groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("n"))
        out.update({c: 0 for c in many} | {r["feature"]: r["n"] for r in gone.collect()})
    return out


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else numeric_columns(df))
    return df.withColumns({c: F.when(present(df, c), F.col(c)).otherwise(F.lit(0)) for c in columns})


def drop_columns_with_missing(df: DataFrame) -> DataFrame:
    gaps = missing_counts(df)
    return df.select(*[c for c in df.columns if gaps[c] == 0])


def non_finite_to_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]

    def fix(c: str) -> Column:
        col = F.col(c)
        return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(0.0)).otherwise(col)

    return df.withColumns({c: fix(c) for c in columns})


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per string column, the smallest on ties.

    Counted per (column, value), so no single buffer holds all distinct values.
    """
    if not columns:
        return {}
    counts = (
        df.select(*columns).unpivot([], list(columns), "feature", "value")
        .where("value is not null").groupBy("feature", "value").count()
    )
    top = counts.groupBy("feature").agg(F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("top"))
    return {r["feature"]: r["top"]["value"] for r in top.collect()}


def impute(df: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Median for numeric columns and mode for string columns that have gaps.

    Medians are exact, or with ``accuracy`` within that share of the ranks, from one scan for all columns.
    """
    numeric, text = numeric_columns(df), string_columns(df)
    gaps = missing_counts(df, numeric + text)
    holes = [c for c in numeric if gaps[c]]
    if accuracy is None:
        medians = {c: q[0] for c, q in column_quantiles(df, holes, [0.5]).items()}
    else:
        medians = {c: q[0] for c, q in sketches.quantiles(sketches.build(df, holes, accuracy), [0.5]).items()} if holes else {}
    modes = column_modes(df, [c for c in text if gaps[c]])
    fills: dict[str, Column] = {}
    for c, v in medians.items():
        if v is not None:
            fills[c] = F.coalesce(clean_double(df, c), F.lit(v))
    for c, v in modes.items():
        fills[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(fills) if fills else df


def _outlier_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else numeric_columns(df, OUTLIER_EXEMPT)


def _iqr_bounds(q: Sequence[float | None], threshold: float) -> tuple[float, float] | None:
    if q[0] is None:
        return None
    spread = q[1] - q[0]
    return q[0] - threshold * spread, q[1] + threshold * spread


def remove_outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5,
                        mode: str = "sequential") -> DataFrame:
    """Keep rows within ``[q25 - t*IQR, q75 + t*IQR]``; missing values are dropped.

    ``sequential`` recomputes the quartiles on the survivors of the previous
    column, one scan of a narrow table each; ``joint`` takes all bounds from the input table in one set of scans.
    The result is ``df`` under plain range filters, which reach the file scan.
    """
    columns = _outlier_columns(df, columns)
    if mode not in ("sequential", "joint"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "joint":
        bounds = {c: _iqr_bounds(q, threshold) for c, q in column_quantiles(df, columns, [0.25, 0.75]).items()}
    else:
        bounds = iqr_bounds(df, columns, threshold)[0]
    if bounds is None or None in bounds.values():
        return df.where(F.lit(False))
    for c, b in bounds.items():
        df = df.where(present(df, c) & F.col(c).between(*b))
    return df


def remove_outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Keep rows with ``abs(z) < threshold``, column after column, population std.

    Missing values are dropped; a constant column removes nothing.
    """
    for c, (mean, deviation) in zscore_parameters(df, _outlier_columns(df, columns), threshold)[0].items():
        df = df.where(present(df, c))
        if deviation:
            df = df.where(F.abs((clean_double(df, c) - F.lit(mean)) / F.lit(deviation)) < threshold)
    return df


def clean(df: DataFrame, required_columns: Sequence[str] | None = None, drop_duplicates: bool = True,
          handle_missing: str = "impute", outlier_method: str | None = "iqr",
          outlier_threshold: float = 1.5) -> DataFrame:
    """The cleaning steps in order: required columns, duplicates, missing, outliers.

    The duplicate-free table is written once to the shared folder: the statistics
    passes that follow read single columns of it instead of repeating the shuffle.
    """
    if handle_missing not in ("impute", "drop", "none"):
        raise ValueError(f"unknown missing-value strategy: {handle_missing}")
    if outlier_method not in ("iqr", "zscore", None):
        raise ValueError(f"unknown outlier method: {outlier_method}")
    if required_columns:
        require_columns(df, required_columns)
    if drop_duplicates:
        df = drop_duplicate_rows(df)
        if handle_missing == "impute" or outlier_method:
            df = materialize(df, "dedup")
    if handle_missing == "drop":
        df = drop_missing(df)
    elif handle_missing == "impute":
        df = impute(df)
    if outlier_method == "iqr":
        df = remove_outliers_iqr(df, threshold=outlier_threshold)
    elif outlier_method == "zscore":
        df = remove_outliers_zscore(df, threshold=outlier_threshold)
    return df


def clean_audit(df: DataFrame, required_columns: Sequence[str] | None = None, handle_missing: str = "impute",
                outlier_method: str | None = "iqr", outlier_threshold: float = 1.5) -> DataFrame:
    """Row counts around each cleaning step: ``step, rows_in, rows_out``."""
    if required_columns:
        require_columns(df, required_columns)
    steps = [df, materialize(drop_duplicate_rows(df), "dedup")]
    names = ["duplicates", "missing", "outliers"]
    steps.append(clean(steps[-1], None, False, handle_missing, None))
    steps.append(clean(steps[-1], None, False, "none", outlier_method, outlier_threshold))
    tagged = reduce(DataFrame.unionAll, [s.select(F.lit(i).alias("i")) for i, s in enumerate(steps)])
    n = {r["i"]: r["count"] for r in tagged.groupBy("i").count().collect()}
    rows = [(name, n.get(i, 0), n.get(i + 1, 0)) for i, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "step string, rows_in long, rows_out long")


