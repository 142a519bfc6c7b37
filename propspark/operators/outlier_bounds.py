"""Outlier bounds column after column, each from one scan of what the earlier columns left.

The numeric columns are written once as a narrow table, and what has survived is written again, without the columns that are
done, every ``REWRITE`` columns. So a column is read under a few range filters only, whatever their total number. The writes
observe a sketch of the columns that come next: where a table is too large for exact quantiles in one aggregate, it gives the
first brackets, and a second scan sorts the few values inside them. The tables are deleted when the bounds are known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F

from propspark.columns import clean_double
from propspark.operators.quantiles import ACCURACY, BUDGET, bracketed_quantiles, literal_edges
from propspark.session import intermediates, materialize

#: Columns after which the survivors are written again.
REWRITE = 8
#: Bracket half-widths as shares of the rows at the last writing; the outer ones allow for rows removed since.
MARGINS = (0.002, 0.01, 0.03, 0.08, 0.15)

Bounds = tuple[float, float]


class Narrow(NamedTuple):
    """A written table of the columns still to do, its number of rows, and sketched quantiles of the next few columns."""

    rows: DataFrame
    n: int
    cuts: dict[str, list[float]]


def _written(rows: DataFrame, left: Sequence[str], probs: Sequence[float]) -> Narrow:
    seen = Observation()
    near = sorted({min(1.0, max(0.0, p + s * m)) for p in probs for m in MARGINS for s in (-1, 1)})
    sketches = [F.percentile_approx(c, near, ACCURACY).alias(f"q{i}") for i, c in enumerate(left[:REWRITE])] if near else []
    table = materialize(rows.select(*left).observe(seen, F.count(F.lit(1)).alias("n"), *sketches), "narrow")
    got = seen.get
    return Narrow(table, got["n"], {c: list(got[f"q{i}"] or []) for i, c in enumerate(left[:REWRITE])} if near else {})


def _within(bounds: dict[str, Bounds | None]) -> Column:
    tests = [F.col(c).between(*b) if b else F.col(c).isNotNull() for c, b in bounds.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def sequential_bounds(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                      find: Callable[[DataFrame, str, Narrow], tuple[Bounds | None, int]]) -> tuple[dict[str, Bounds | None] | None, int]:
    """Bounds of every column on the rows that the columns before it keep, and the number of scans.

    ``find`` gives a column's bounds on its surviving values (no bounds keep all) and the scans that it took; it raises
    ``LookupError`` if there are none, and then no row survives: the result is None.
    """
    found: dict[str, Bounds | None] = {}
    scans, names = 0, [f"v{i}" for i in range(len(columns))]
    with intermediates(df.sparkSession):
        rows = df.select(*[clean_double(df, c).alias(n) for c, n in zip(columns, names)])
        for at in range(0, len(columns), REWRITE):
            table = _written(rows, names[at:], probs)
            scans += 1
            here: dict[str, Bounds | None] = {}
            for c, n in zip(columns[at:at + REWRITE], names[at:]):
                left = table.rows.where(_within(here) & F.col(n).isNotNull())
                try:
                    here[n], took = find(left, n, table)
                except LookupError:
                    return None, scans + 1
                found[c], scans = here[n], scans + took
            rows = table.rows.where(_within(here))
    return found, scans


def iqr_bounds(df: DataFrame, columns: Sequence[str], threshold: float, budget: int = BUDGET) -> tuple[dict[str, Bounds | None] | None, int]:
    """``[q25 - t * IQR, q75 + t * IQR]`` of every column in turn; quartiles are exact."""
    probs = [0.25, 0.75]

    def find(left: DataFrame, c: str, table: Narrow) -> tuple[Bounds | None, int]:
        if table.n <= budget:
            q, took = left.agg(F.percentile(c, F.array(*literal_edges(probs)))).first()[0], 1
        else:
            q, took = bracketed_quantiles(left.select(F.lit(c).alias("feature"), F.col(c).alias("value")), c, probs, table.cuts[c], budget), 2
        if not q:
            raise LookupError(c)
        spread = q[1] - q[0]
        return (q[0] - threshold * spread, q[1] + threshold * spread), took

    return sequential_bounds(df, columns, probs, find)


def zscore_parameters(df: DataFrame, columns: Sequence[str], threshold: float) -> tuple[dict[str, tuple[float, float]], int]:
    """Mean and population deviation of every column in turn (deviation 0 keeps all of its values)."""
    found: dict[str, tuple[float, float]] = {}
    scans, names = 0, [f"v{i}" for i in range(len(columns))]
    with intermediates(df.sparkSession):
        rows = df.select(*[clean_double(df, c).alias(n) for c, n in zip(columns, names)])
        for at in range(0, len(columns), REWRITE):
            table = _written(rows, names[at:], [])
            scans += 1
            rows = table.rows
            for c, n in zip(columns[at:at + REWRITE], names[at:]):
                rows = rows.where(F.col(n).isNotNull())
                s = rows.agg(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).first()
                scans += 1
                found[c] = (s["m"] or 0.0, s["s"] or 0.0)
                if s["s"]:
                    rows = rows.where(F.abs((F.col(n) - F.lit(s["m"])) / F.lit(s["s"])) < threshold)
    return found, scans
