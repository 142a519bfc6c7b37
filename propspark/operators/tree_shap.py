"""Path-dependent Shapley values of tree ensembles, level by level on flat node arrays.

A leaf counts for a row as a product over the distinct features of its path: a feature that is known contributes whether the
row follows the path (``o``, 0 or 1), one that is unknown the share ``z`` of training rows that do. With ``D`` features on
a path the Shapley weights of subset sizes are integrals of ``t^k (1-t)^(D-1-k)`` over [0, 1], so feature ``f`` gets

    value * (o_f - z_f) * integral of prod_{g != f} (z_g (1-t) + o_g t) dt

a polynomial of degree ``D - 1``, which ``ceil(D / 2)`` Gauss-Legendre points integrate exactly. At each point the products are
carried down and the leaves' sums carried up the tree one level at a time, for all rows of a block and all nodes of the
level at once. A feature that comes up again on a path replaces its earlier factor.

That visits every leaf for every row. Trees over few features are summed into tables first: what they predict from a set of
known features is constant on the cells between their thresholds, and a leaf adds a constant to a box of cells. A row then looks up
one cell for each set of features, and its Shapley values are weighted sums of these, exactly as defined.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from propspark.errors import DataError
from propspark.operators.forest_growth import Walk, saved_at
from propspark.session import materialize

TREE_MODELS = (RandomForestRegressionModel, RandomForestClassificationModel, GBTRegressionModel, GBTClassificationModel)
FORESTS = (RandomForestRegressionModel, RandomForestClassificationModel)
#: Nodes that are sent to the tasks at once (about 60 bytes each; one tree at least).
GROUP_NODES = 1 << 21
#: Numbers in an array of a block: rows times nodes.
BLOCK = 1 << 18
#: Tables are made for at most so many features and cells (8 bytes each, held by every Python worker).
TABLE_FEATURES, TABLE_CELLS = 8, 1 << 24

FLAT = ("tree int, nodes bigint, base double, level array<int>, parent array<int>, feature array<int>, low array<double>, "
        "high array<double>, share array<double>, before array<int>, value array<double>")


class Tree(NamedTuple):
    """Nodes of a tree in order of their level, brothers side by side; the arrays describe the edge above each node.

    ``level`` has the first node of each level; ``before`` is the nearest node above whose edge tests the same feature (-1 if none);
    a row is inside if ``low < x <= high`` for all tests of that feature so far, ``share`` is the training rows' share for them.
    """

    level: np.ndarray
    parent: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    before: np.ndarray
    value: np.ndarray


def flatten(nodes: pd.DataFrame) -> tuple[Tree, float]:
    """The flat form of one tree's nodes (``id, left, right, feature, cut, cover, value``) and its mean value."""
    nodes = nodes.sort_values("id", ignore_index=True)
    place = {i: k for k, i in enumerate(nodes["id"].tolist())}
    left, right = (np.array([place.get(i, -1) for i in nodes[c].tolist()]) for c in ("left", "right"))
    test, cut, cover, value = (nodes[c].to_numpy() for c in ("feature", "cut", "cover", "value"))
    which, parent, level = np.array([0]), np.array([-1]), [0]
    feature, low, high, share, before = np.array([-1]), np.array([-np.inf]), np.array([np.inf]), np.array([1.0]), np.array([-1])
    first = 0
    while True:
        inner = first + np.flatnonzero(left[which[first:]] >= 0)
        if not len(inner):
            break
        up = np.repeat(inner, 2)
        kids = np.stack([left[which[inner]], right[which[inner]]], axis=1).ravel()
        f, at = test[which[up]].astype(np.int64), cut[which[up]]
        part = cover[kids] / cover[which[up]]
        same = up.copy()
        while (seek := (same >= 0) & (feature[same] != f)).any():
            same[seek] = parent[same[seek]]
        known = same >= 0
        lo, hi, z = (np.where(known, x[same], y) for x, y in ((low, -np.inf), (high, np.inf), (share, 1.0)))
        is_left = np.arange(len(up)) % 2 == 0
        first = len(which)
        level.append(first)
        which, parent, feature = np.append(which, kids), np.append(parent, up), np.append(feature, f)
        low, high = np.append(low, np.where(is_left, lo, np.maximum(lo, at))), np.append(high, np.where(is_left, np.minimum(hi, at), hi))
        share, before = np.append(share, z * part), np.append(before, np.where(known, same, -1))
    leaf = left[which] < 0
    values = np.where(leaf, value[which], 0.0)
    base = float((values * cover[which]).sum() / cover[0])
    return Tree(np.array(level + [len(which)]), parent, feature, low, high, share, before, values), base


def flat_trees(spark: SparkSession, model, label: int | None = None) -> DataFrame:
    """One row for each tree of a forest or boosted model, flattened where Spark put its nodes and written to the shared folder.

    Forests average their trees (``label`` picks the class whose share a leaf of a classification forest gives); boosted
    models add the weighted values, for classification as a margin.
    """
    if not isinstance(model, TREE_MODELS):
        raise DataError(f"not a tree ensemble: {type(model).__name__}")
    path = saved_at(spark, model)
    shares = isinstance(model, RandomForestClassificationModel)
    stats = F.col("nodeData.impurityStats")
    cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if shares else stats[0]
    weights = [1.0 / len(model.treeWeights)] * len(model.treeWeights) if isinstance(model, FORESTS) else list(model.treeWeights)
    value = stats[label if label is not None else 1] / cover if shares else F.col("nodeData.prediction")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("cut"),
        cover.cast("double").alias("cover"), (value * F.get(F.lit(weights), F.col("treeID"))).alias("value"))

    def flat(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, base = flatten(pdf)
        return pd.DataFrame([(pdf["treeID"].iloc[0], len(tree.parent), base, *tree)], columns=[c.split()[0] for c in FLAT.split(", ")])

    return materialize(nodes.groupBy("treeID").applyInPandas(flat, FLAT), "trees")


def tree_values(tree: Tree, x: np.ndarray, phi: np.ndarray) -> None:
    """Add the tree's Shapley values of the rows ``x`` to ``phi``."""
    n = len(tree.parent)
    if n < 2:
        return
    # distinct features on the way to each node; the root is left out of all edge arrays
    seen = np.zeros(n, np.int64)
    for a, b in zip(tree.level[1:-1], tree.level[2:]):
        seen[a:b] = seen[tree.parent[a:b]] + (tree.before[a:b] < 0)
    points, weights = np.polynomial.legendre.leggauss((int(seen.max()) + 1) // 2)
    z, again = tree.share[1:, None], np.flatnonzero(tree.before >= 0)
    earlier = tree.before[again] - 1
    again -= 1
    order = np.argsort(tree.feature[1:], kind="stable")
    used, starts = np.unique(tree.feature[1:][order], return_index=True)
    leaves = tree.value[1:, None]
    step = min(4096, max(16, BLOCK // n))
    for s in range(0, len(x), step):
        columns = np.ascontiguousarray(x[s:s + step].T)
        inside = columns[tree.feature[1:]]
        inside = (inside > tree.low[1:, None]) & (inside <= tree.high[1:, None])
        change = np.zeros(inside.shape)
        for t, w in zip((points + 1) / 2, weights / 2):
            known, unknown = z * (1 - t) + t, z * (1 - t)
            factor = np.where(inside, known, unknown)
            gain = np.where(inside, (1 - z) / known, -1 / (1 - t))
            grown = factor.copy()
            grown[again] /= factor[earlier]
            gain_change = gain.copy()
            gain_change[again] -= gain[earlier]
            # products of the factors down to each level, then sums of the leaves up to each
            for a, b in zip(tree.level[2:-1], tree.level[3:]):
                grown[a - 1:b - 1] *= grown[tree.parent[a:b] - 1]
            grown *= leaves
            for a, b in zip(tree.level[-2:1:-1], tree.level[:2:-1]):
                grown[tree.parent[a:b:2] - 1] = grown[a - 1:b - 1:2] + grown[a:b - 1:2]
            gain_change *= grown
            gain_change *= w
            change += gain_change
        phi[s:s + step, used] += np.add.reduceat(change[order], starts, axis=0).T


def _walk_of(trees: Sequence[Tree]) -> Walk:
    """The trees one after the other; the tests of two brothers belong to the node above them."""
    starts = np.cumsum([0, *[len(t.parent) for t in trees]])
    feature, cut, down = np.zeros(starts[-1], np.int64), np.full(starts[-1], np.inf), np.arange(starts[-1])
    for tree, first in zip(trees, starts.tolist()):
        up = first + tree.parent[1::2]
        feature[up], cut[up], down[up] = tree.feature[1::2], tree.high[1::2], first + np.arange(1, len(tree.parent), 2)
    return Walk(starts[:-1], feature, cut, down, np.concatenate([t.value for t in trees]))


class Tables:
    """What a group of trees predicts from each set of known features, cell by cell between the thresholds.

    ``features`` are those the trees test, ``cuts`` their thresholds; ``values`` has the table of every proper subset (a mask
    over ``features``). With all features known a row is sent down the trees.
    """

    def __init__(self, trees: Sequence[Tree], features: list[int], cuts: list[np.ndarray]):
        self.features, self.cuts = features, cuts
        *sides, value = (np.concatenate(c) for c in zip(*[self._leaves(t) for t in trees]))
        start, stop, share = (np.ascontiguousarray(s.T) for s in sides)
        m, self.values = len(features), {}
        for mask in range(1 << m):
            known = [k for k in range(m) if mask >> k & 1]
            if len(known) < m:
                rest = np.ones(len(value))
                for k in range(m):
                    if k not in known:
                        rest *= share[k]
                rest *= value
                self.values[mask] = self._boxes(start[known], stop[known], rest, [len(cuts[k]) + 1 for k in known])
        self.walk = _walk_of(trees)

    @staticmethod
    def fitting(trees: Sequence[Tree]) -> Tables | None:
        """Tables of the trees, or None where they would be too large."""
        tests = np.concatenate([np.empty(0, np.int64), *[t.feature[1:] for t in trees]])
        ends = np.concatenate([np.empty(0), *[t.high[1:] for t in trees]])
        features = np.unique(tests).tolist()
        if not 0 < len(features) <= TABLE_FEATURES:
            return None
        cuts = [np.unique(ends[(tests == f) & np.isfinite(ends)]) for f in features]
        if math.prod(len(c) + 2 for c in cuts) - math.prod(len(c) + 1 for c in cuts) > TABLE_CELLS:
            return None
        return Tables(trees, features, cuts)

    def _leaves(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf and feature the cells inside (first, stop) and the share of rows; the leaf's value."""
        n, m = len(tree.parent), len(self.features)
        start, stop = np.zeros((n, m), np.int64), np.tile([len(c) + 1 for c in self.cuts], (n, 1))
        share = np.ones((n, m))
        which = np.searchsorted(self.features, tree.feature)
        for a, b in zip(tree.level[1:-1], tree.level[2:]):
            up = tree.parent[a:b]
            start[a:b], stop[a:b], share[a:b] = start[up], stop[up], share[up]
            for k, cuts in enumerate(self.cuts):
                at = a + np.flatnonzero(which[a:b] == k)
                start[at, k] = np.where(np.isfinite(tree.low[at]), np.searchsorted(cuts, tree.low[at]) + 1, 0)
                stop[at, k] = np.maximum(np.searchsorted(cuts, tree.high[at]) + 1, start[at, k])
                share[at, k] = tree.share[at]
        stop = np.minimum(stop, [len(c) + 1 for c in self.cuts])
        leaf = np.ones(n, bool)
        leaf[tree.parent[1:]] = False
        return start[leaf], stop[leaf], share[leaf], tree.value[leaf]

    @staticmethod
    def _boxes(start: np.ndarray, stop: np.ndarray, value: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The sum of all boxes' values in each cell: signed values at the corners, summed along every axis."""
        padded = [n + 1 for n in sizes]
        table = np.zeros(math.prod(padded))
        steps = [math.prod(padded[k + 1:]) for k in range(len(padded))]

        def corners(k: int, at: np.ndarray | int, signed: tuple[np.ndarray, np.ndarray]) -> None:
            if k == len(ends):
                np.add.at(table, at, signed[0])
                return
            corners(k + 1, at + ends[k][0], signed)
            corners(k + 1, at + ends[k][1], signed[::-1])

        for s in range(0, len(value), 1 << 14):  # as many as stay in the processor's cache
            part = value[s:s + (1 << 14)]
            ends = [(a[s:s + len(part)] * step, b[s:s + len(part)] * step) for a, b, step in zip(start, stop, steps)]
            corners(0, np.zeros(len(part), np.int64), (part, -part))
        table = table.reshape(padded)
        for k in range(len(sizes)):
            np.cumsum(table, axis=k, out=table)
        return np.ascontiguousarray(table[(slice(-1),) * len(sizes)])

    def add(self, x: np.ndarray, phi: np.ndarray) -> None:
        """Add the trees' Shapley values of the rows ``x`` to ``phi``."""
        m = len(self.features)
        cells = [np.searchsorted(c, x[:, f]) for f, c in zip(self.features, self.cuts)]
        whole = np.zeros(len(x))
        for rows, node in self.walk.ends(x):
            whole[rows] += self.walk.value[node]
        weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        for mask in range(1 << m):
            known = [k for k in range(m) if mask >> k & 1]
            got = whole if len(known) == m else self.values[mask][tuple(cells[k] for k in known)]
            for k, f in enumerate(self.features):
                if mask >> k & 1:
                    phi[:, f] += weight[len(known) - 1] * got
                else:
                    phi[:, f] -= weight[len(known)] * got


_tables: dict[str, Tables | None] = {}


def _tables_of(name: str, trees: Sequence[Tree]) -> Tables | None:
    if name not in _tables:
        _tables.clear()
        _tables[name] = Tables.fitting(trees)
    return _tables[name]


def _groups(sizes: Sequence[tuple[int, int]], most: int) -> list[list[int]]:
    out, held = [[]], 0
    for tree, n in sizes:
        if out[-1] and held + n > most:
            out.append([])
            held = 0
        out[-1].append(tree)
        held += n
    return out


def _read_trees(table: pa.Table) -> list[Tree]:
    columns = [[row.values.to_numpy() for row in table.column(c)] for c in Tree._fields]
    return [Tree(*arrays) for arrays in zip(*columns)]


def _adder(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, trees = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tables = _tables_of(name, trees)
            x, phi = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy() for c in ("x", "phi"))
            if tables is not None:
                tables.add(x, phi)
            for tree in trees if tables is None else ():
                tree_values(tree, x, phi)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * phi.shape[1]
            at = batch.schema.get_field_index("phi")
            yield batch.set_column(at, "phi", pa.ListArray.from_arrays(ends, phi.ravel()))

    return add


def add_tree_values(rows: DataFrame, trees: DataFrame, group_nodes: int = GROUP_NODES) -> tuple[DataFrame, float]:
    """Fill ``phi`` of rows that have an array ``x`` with the Shapley values of all trees; also the sum of the trees' mean values.

    Trees go to the tasks in groups of at most ``group_nodes`` nodes, each group once to each machine; rows carry their partial
    sums from group to group (written between groups), so no task holds more than a group and a block of rows.
    """
    spark = rows.sparkSession
    sizes = sorted((r.tree, r.nodes, r.base) for r in trees.select("tree", "nodes", "base").collect())
    groups = _groups([(t, n) for t, n, _ in sizes], group_nodes)
    out = rows.withColumn("phi", F.transform("x", lambda _: F.lit(0.0)))
    # a row costs far more to explain than to move, so rows are dealt out evenly over a number that is not made smaller
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = out.repartition(parts, F.xxhash64(*[c for c in out.columns if c != "phi"]))
    for i, group in enumerate(groups):
        held = _read_trees(trees.filter(F.col("tree").isin(group)).toArrow())
        out = out.mapInArrow(_adder(spark.sparkContext.broadcast((uuid.uuid4().hex, held))), out.schema)
        if i + 1 < len(groups):
            out = materialize(out, "partial")
    return out, float(sum(b for _, _, b in sizes))
