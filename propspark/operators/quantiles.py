"""Exact quantiles without gathering a column in one task.

``percentile`` and ``median`` keep every distinct value of a group in one buffer.
Here a bounded sketch over a row sample brackets each wanted rank, one counting
pass over all rows locates the ranks, and only the few values inside a bracket are
sorted. Rows of brackets that are still too full are written on their own and cut again,
so the sample only affects the number of passes, never the result. Each pass is a scan with a partial
aggregate; the driver holds a handful of numbers per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propspark.columns import to_long
from propspark.session import materialize, small_table

BUDGET = 1 << 18  # most values one bracket may hold before it is sorted
ACCURACY = 4000  # sketch accuracy: rank error at most n / ACCURACY
SAMPLE = 1 / 16  # share of rows that enter the sketch
MARGINS = (0.001, 0.005, 0.02)  # bracket half-widths around a wanted rank, as shares
GRID = 200  # sub-brackets per narrowing round


def edges_upto(value: Column, edges: Sequence[Column]) -> Column:
    """How many of the ascending edges lie at or below the value, by binary search.

    Null edges may pad the end and count nothing.
    """
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= edges[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(edges))


def _gap_or_edge(value: Column, edges: Sequence[Column]) -> Column:
    """Gaps between edges are numbered 0, 2, 4, ... and the edges themselves 1, 3, 5, ..."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        return (F.when(value > edges[mid], search(mid + 1, hi)).when(value == edges[mid], 2 * mid + 1)
                .otherwise(search(lo, mid)))

    return search(0, len(edges))


def literal_edges(edges: Sequence[float]) -> list[Column]:
    return [F.lit(float(e)) for e in edges]


def _kind(long: DataFrame) -> str:
    return long.schema["feature"].dataType.simpleString()


def with_edges(long: DataFrame, edges: dict) -> tuple[DataFrame, list[Column]]:
    """Attach each feature's edges as plain columns, padded with nulls.

    The edge table has one short row per feature, so its size follows the number of
    columns and not the number of rows; features without edges drop out.
    """
    width = max((len(v) for v in edges.values()), default=0)
    names = [f"_e{i}" for i in range(width)]
    rows = [(k, *v, *[None] * (width - len(v))) for k, v in edges.items()]
    frame = small_table(long.sparkSession, rows, feature=_kind(long), **dict.fromkeys(names, "double"))
    return long.join(F.broadcast(frame), "feature"), [F.col(n) for n in names]


def _with_bucket(long: DataFrame, edges: dict) -> DataFrame:
    rows, cols = with_edges(long, edges)
    return rows.select("feature", "value", _gap_or_edge(F.col("value"), cols).alias("bucket"))


def _counted(long: DataFrame, edges: dict) -> dict:
    """Rows of each feature in every gap between its edges and on them."""
    counts: dict = {k: {} for k in edges}
    for r in _with_bucket(long, edges).groupBy("feature", "bucket").count().collect():
        counts[r["feature"]][r["bucket"]] = r["count"]
    return counts


def order_statistics(long: DataFrame, wanted: dict, edges: dict, budget: int = BUDGET, counted: dict | None = None) -> dict:
    """``{(feature, rank): value}`` for 0-based ranks, given first bracket edges (and the counts between them, if known)."""
    found: dict = {}
    edges = {k: sorted(set(edges[k])) for k, v in wanted.items() if v}
    if not edges:
        return found
    counts = counted or _counted(long, edges)
    gather, narrow = {}, {}
    for k in edges:
        before, ranks = 0, sorted(set(wanted[k]))
        for b in sorted(counts[k]):
            n = counts[k][b]
            for rank in [r for r in ranks if before <= r < before + n]:
                if b % 2:
                    found[k, rank] = edges[k][b // 2]
                else:
                    (gather if n <= budget else narrow).setdefault((k, b), []).append((rank, rank - before, n))
            before += n
    if gather:
        found.update(_sorted_inside(long, edges, gather))
    if narrow:
        # every cell is a feature of its own from here, so no row is held against the edges of other cells
        cells = list(narrow)
        inner = materialize(_cells(long, edges, cells), "brackets")
        offsets = {i: [offset for _, offset, _ in narrow[c]] for i, c in enumerate(cells)}
        cuts = _narrow(inner, {i: narrow[c] for i, c in enumerate(cells)})
        inside = order_statistics(inner, offsets, cuts, budget)
        for i, (k, b) in enumerate(cells):
            found.update({(k, rank): inside[i, offset] for rank, offset, _ in narrow[k, b]})
    return found


def _inside(long: DataFrame, edges: dict, cells) -> DataFrame:
    """Rows of the given (feature, bucket) cells."""
    keep = small_table(long.sparkSession, list(cells), feature=_kind(long), bucket="int")
    rows = _with_bucket(long, {k: edges[k] for k, _ in cells})
    return rows.join(F.broadcast(keep), ["feature", "bucket"])  # a few cells per feature


def _sorted_inside(long: DataFrame, edges: dict, gather: dict) -> dict:
    rows = [(k, b, sorted({o for _, o, _ in items})) for (k, b), items in gather.items()]
    offsets = small_table(long.sparkSession, rows, feature=_kind(long), bucket="int", offsets="array<int>")
    # at most `budget` values per group: counted just before
    picked = (
        _inside(long, edges, gather).groupBy("feature", "bucket")
        .agg(F.sort_array(F.collect_list("value")).alias("vals"))
        .join(F.broadcast(offsets), ["feature", "bucket"])
        .select("feature", "bucket", "offsets",
                F.transform("offsets", lambda o: F.element_at("vals", o + 1)).alias("picked"))
    )
    out = {}
    for r in picked.collect():
        at = dict(zip(r["offsets"], r["picked"]))
        for rank, offset, _ in gather[r["feature"], r["bucket"]]:
            out[r["feature"], rank] = at[offset]
    return out


def _cells(long: DataFrame, edges: dict, cells: Sequence[tuple]) -> DataFrame:
    """Values of the given (feature, bucket) cells, under the cell's number as ``feature``."""
    number = small_table(long.sparkSession, [(*c, i) for i, c in enumerate(cells)], feature=_kind(long), bucket="int", cell="int")
    rows = _with_bucket(long, {k: edges[k] for k, _ in cells}).join(F.broadcast(number), ["feature", "bucket"])  # a few cells per feature
    return rows.select(F.col("cell").alias("feature"), "value")


def _narrow(inner: DataFrame, wanted: dict) -> dict:
    grid = [i / GRID for i in range(GRID + 1)]
    cuts: dict = {}
    rows = inner.groupBy("feature").agg(F.percentile_approx("value", grid, ACCURACY).alias("cuts")).collect()
    for r in rows:
        for _, offset, n in wanted[r["feature"]]:
            at = int(offset / n * GRID)
            cuts.setdefault(r["feature"], []).extend(r["cuts"][max(0, at - 2):at + 4])
    return cuts


def _cuts(probs: Sequence[float]) -> list[float]:
    return sorted({_near(p, m, s) for p in probs for m in MARGINS for s in (-1, 1)})


def _near(p: float, margin: float, side: int) -> float:
    return min(1.0, max(0.0, p + side * margin))


def _heads(long: DataFrame, probs: Sequence[float]) -> tuple[dict, dict]:
    """Row count and sampled bracket cuts per feature, in one pass."""
    picked = long.withColumn("_pick", F.when(F.rand(7) < SAMPLE, F.col("value")))
    rows = picked.groupBy("feature").agg(
        F.count("value").alias("n"), F.percentile_approx("_pick", _cuts(probs), ACCURACY).alias("cuts")).collect()
    return {r["feature"]: r["n"] for r in rows if r["n"]}, {r["feature"]: r["cuts"] for r in rows}


def _sampled_cuts(long: DataFrame, probs: Sequence[float]) -> dict:
    """Bracket cuts per feature when the row counts are known already."""
    rows = long.where(F.rand(7) < SAMPLE).groupBy("feature").agg(
        F.percentile_approx("value", _cuts(probs), ACCURACY).alias("cuts")).collect()
    return {r["feature"]: r["cuts"] for r in rows}


def _first_edges(n: int, cuts: Sequence[float] | None, probs: Sequence[float]) -> list[float]:
    """The bracket ends whose margin fits the sampling error at this row count."""
    if not cuts:
        return []
    error = 1.5 / math.sqrt(n * SAMPLE) + 2.0 / ACCURACY  # three standard errors of a rank, plus the sketch
    margin = next((m for m in MARGINS if m >= error), MARGINS[-1])
    at = dict(zip(_cuts(probs), cuts))
    return [at[_near(p, margin, s)] for p in probs for s in (-1, 1)]


def exact_quantiles(long: DataFrame, probs: Sequence[float], budget: int = BUDGET, n: dict | None = None) -> dict:
    """``{feature: [quantile, ...]}`` of a long table ``feature, value``.

    Linear interpolation between neighbouring ranks; nulls are ignored. A feature
    without values is absent from the result. ``n`` gives the non-null row count per
    feature if an earlier pass has it.
    """
    long = long.select("feature", "value").where("value is not null")
    if n is None:
        n, cuts = _heads(long, probs)
    else:
        n = {k: c for k, c in n.items() if c}
        cuts = _sampled_cuts(long, probs) if any(c > budget for c in n.values()) else {}
    out: dict = {}
    small = {k for k, c in n.items() if c <= budget}
    if small:
        rows = long if len(small) == len(n) else long.where(F.col("feature").isin(list(small)))
        direct = rows.groupBy("feature").agg(F.percentile("value", F.array(*literal_edges(probs))).alias("q"))
        out.update({r["feature"]: list(r["q"]) for r in direct.collect()})
    large = {k: _first_edges(c, cuts.get(k), probs) for k, c in n.items() if c > budget}
    if large:
        spots = {k: [(n[k] - 1) * p for p in probs] for k in large}
        ranks = {k: {f(h) for h in hs for f in (math.floor, math.ceil)} for k, hs in spots.items()}
        found = order_statistics(long, ranks, large, budget)
        for k, hs in spots.items():
            out[k] = []
            out[k] += [_between(found[k, math.floor(h)], found[k, math.ceil(h)], h) for h in hs]
    return out


def bracketed_quantiles(long: DataFrame, feature: str, probs: Sequence[float], edges: Sequence[float], budget: int = BUDGET) -> list[float] | None:
    """Quantiles of one feature's values, none of them null, from brackets that are known already (None without values)."""
    held = {feature: sorted(set(edges))}
    counted = _counted(long, held)
    n = sum(counted[feature].values())
    if not n:
        return None
    spots = [(n - 1) * p for p in probs]
    ranks = {f(h) for h in spots for f in (math.floor, math.ceil)}
    found = order_statistics(long, {feature: ranks}, held, budget, counted)
    return [_between(found[feature, math.floor(h)], found[feature, math.ceil(h)], h) for h in spots]


def _between(lo: float, hi: float, h: float) -> float:
    return lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     budget: int = BUDGET) -> dict[str, list[float | None]]:
    """Exact quantiles of wide columns; one set of scans for all of them."""
    if not columns:
        return {}
    got = exact_quantiles(to_long(df, columns), probs, budget)
    return {c: got.get(c, [None] * len(probs)) for c in columns}
