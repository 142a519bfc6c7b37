"""Train/validation/test splits and scaling with stored parameters."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from propspark.columns import WIDE_AGG_LIMIT, clean_double, to_long
from propspark.errors import DataError
from propspark.functions.hashing import keyed_long, keyed_uniform
from propspark.operators import sketches
from propspark.operators.quantiles import column_quantiles

SCALERS = ("standard", "minmax", "robust")
HASH_BITS, BUCKET_BITS = 52, 16  # of the key hash, and those that the first pass counts by


def split_column(key: Column, test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> Column:
    u = keyed_uniform(key, seed)
    return F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train")


def split(df: DataFrame, key: str, test_size: float = 0.2, val_size: float = 0.1, seed: int = 42,
          exact: bool = False) -> DataFrame:
    """Add ``split`` (train/val/test), a function of the row key and the seed only.

    ``exact`` gives the sizes ``ceil(n * test)`` and ``ceil((n - n_test) * val / (1 - test))``
    by finding the two cut values among the key hashes: one pass counts the rows by the leading bits of
    the hash, a second one ranks (hash, key) inside the two buckets where the cuts fall. Keys must be unique and
    not null; a key that stands twice at a cut is an error.
    """
    if not exact:
        return df.withColumn("split", split_column(F.col(key), test_size, val_size, seed))
    h = keyed_long(F.col(key), seed)
    bucket = F.shiftright(h, HASH_BITS - BUCKET_BITS).cast("int")
    sizes = dict(df.groupBy(bucket.alias("b")).count().collect())  # at most 2 ** BUCKET_BITS rows
    n = sum(sizes.values())
    n_test = math.ceil(n * test_size)
    n_val = math.ceil((n - n_test) * (val_size / (1 - test_size)))
    spots, before = {}, 0  # for each cut its bucket and the rows to take from it
    for b in sorted(sizes):
        for cut in {n_test, n_test + n_val}:
            if before < cut <= before + sizes[b]:
                spots[cut] = (b, cut - before)
        before += sizes[b]

    def upto(count: int) -> Column:
        """Rows among the ``count`` first in the order of (hash, key)."""
        if count <= 0:
            return F.lit(False)
        b, take = spots[count]
        first = df.where(bucket == b).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(take + 1)
        last = first.orderBy(F.desc("h"), F.desc("k")).limit(2).collect()
        edge = last[0] if take == sizes[b] else last[1]
        if edge["k"] is None or len(last) > 1 and last[0] == last[1]:
            raise DataError(f"exact splits need a unique key: {key}")
        return (h < F.lit(edge["h"])) | ((h == F.lit(edge["h"])) & (F.col(key) <= F.lit(edge["k"])))

    return df.withColumn("split", F.when(upto(n_test), "test").when(upto(n_test + n_val), "val").otherwise("train"))


@dataclass
class Scaler:
    """Per-column ``(value - center) / scale`` with fitted parameters."""

    kind: str
    columns: list[str]
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def expr(self, name: str, col: Column | None = None) -> Column:
        col = F.col(f"`{name}`").cast("double") if col is None else col
        return (col - F.lit(self.center[name])) / F.lit(self.scale[name])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.columns if c in df.columns})

    def inverse(self, name: str, col: Column) -> Column:
        """Back to the original unit; an unknown column is returned unchanged."""
        if name not in self.scale:
            return col
        return col * F.lit(self.scale[name]) + F.lit(self.center[name])

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(c, self.center[c], self.scale[c]) for c in self.columns], "feature string, center double, scale double")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Scaler":
        return Scaler(**json.loads(text))


def _stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """mean, population std, min, max per column in one job."""
    if len(columns) <= WIDE_AGG_LIMIT:
        aggs = []
        for i, c in enumerate(columns):
            x = clean_double(df, c)
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        return {c: tuple(row[f"{k}{i}"] for k in "msab") for i, c in enumerate(columns)}
    got = to_long(df, columns).groupBy("feature").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("a"), F.max("value").alias("b"))
    return {r["feature"]: (r["m"], r["s"], r["a"], r["b"]) for r in got.collect()}


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard", accuracy: float | None = None) -> Scaler:
    """``standard`` (mean, population std), ``minmax`` or ``robust`` (median, IQR); a zero scale becomes 1.

    The quantiles of ``robust`` are exact, or with ``accuracy`` within that share of the ranks, from one scan.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler: {kind}")
    columns = list(columns)
    if kind == "robust":
        probs = [0.25, 0.5, 0.75]
        q = (column_quantiles(train, columns, probs) if accuracy is None or not columns
             else sketches.quantiles(sketches.build(train, columns, accuracy), probs))
        pairs = {c: (v[1], None if v[1] is None else v[2] - v[0]) for c, v in q.items()}
    else:
        st = _stats(train, columns)
        pairs = {
            c: (v[0], v[1]) if kind == "standard" else (v[2], None if v[2] is None else v[3] - v[2])
            for c, v in st.items()
        }
    return Scaler(kind, columns, {c: pairs[c][0] or 0.0 for c in columns}, {c: pairs[c][1] or 1.0 for c in columns})


def scale_features(df: DataFrame, columns: Sequence[str], kind: str = "standard",
                   scaler: Scaler | None = None) -> tuple[DataFrame, Scaler]:
    """Fit on the rows with ``split = 'train'`` (unless a scaler is given), apply to all."""
    scaler = scaler or fit_scaler(df.where("split = 'train'"), columns, kind)
    return scaler.transform(df), scaler


def scale_targets(df: DataFrame, target_types: dict[str, str]) -> tuple[DataFrame, Scaler]:
    """Standardise regression targets on the train split; class targets pass through."""
    names = [t for t, kind in target_types.items() if kind != "classification"]
    scaler = fit_scaler(df.where("split = 'train'"), names, "standard")
    return scaler.transform(df), scaler
