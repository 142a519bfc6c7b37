"""Deep regression forests, grown in two parts, and their predictions from flat node arrays.

Spark ML makes one pass over all rows for each level of its trees and keeps the sums of all nodes of a level in every task, so a deep
forest costs it a walk from the root and scattered sums for each row, tree and level. Here rows are binned once, with their weight
in each tree. Nodes of many rows are split by sums over all rows, a level at a time; there are few of them. The rows of a node that
is small enough then go to one task, which grows everything below it on its own. The rules are those of Spark ML: thresholds from
a sample's quantiles, Poisson weights, a random subset of features for each node, the largest gain of variance. The result is an
ordinary model of Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from propspark.session import materialize, new_path, small_table

#: Forests of this depth or more are grown here, shallower ones by Spark ML, which needs few passes for them.
DEEP = 10
#: Models of so many nodes or more are walked as arrays.
WALKED = 1 << 15
#: Weighted rows below which a node is grown in one task, and bytes of their bins.
NODE_ROWS, NODE_BYTES = 1 << 20, 1 << 26
#: Numbers in an array of sums: nodes times bins, and bytes of the sums that a task keeps for large nodes.
SUMS, KEPT_BYTES = 1 << 20, 1 << 26
#: Bytes of rows that go to the small nodes at once, and of a partition of theirs.
SENT_BYTES, PART_BYTES = 1 << 24, 1 << 25

SUBTREE = {"tree": "int", "at": "int", "size": "int", "feature": "array<int>", "cut": "array<double>", "left": "array<int>", "count": "array<double>",
           "total": "array<double>", "square": "array<double>", "gain": "array<double>"}
NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")
#: In place of a feature: the node is a leaf, or its rows are grown in one task.
LEAF, APART = -1, -2


class Plan(NamedTuple):
    """What the tasks need: settings, thresholds of each feature, mean and variance of the labels."""

    trees: int
    depth: int
    leaf: int
    subset: int
    seed: int
    rate: float | None
    cuts: list[np.ndarray]
    mean: float
    variance: float


class Nodes:
    """Nodes of one tree or subtree in the order they were made, brothers side by side; sums are of weight, centred label and its square."""

    def __init__(self):
        self.feature, self.cut, self.left, self.depth, self.gain, self.sums = [LEAF], [0], [-1], [0], [-1.0], [np.zeros(3)]

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, first, gain
        for sums in (left, self.sums[node] - left):
            self.feature.append(LEAF)
            self.cut.append(0)
            self.left.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.gain.append(-1.0)
            self.sums.append(sums)
        return first, first + 1


def grows(estimator) -> bool:
    """Whether ``grow`` takes this estimator."""
    if not isinstance(estimator, RandomForestRegressor):
        return False
    get = estimator.getOrDefault
    plain = get("minInfoGain") == 0 and get("minWeightFractionPerNode") == 0 and not (estimator.hasParam("weightCol") and estimator.isDefined("weightCol"))
    names = get("featureSubsetStrategy") in ("auto", "all", "sqrt", "log2", "onethird")
    drawn = get("bootstrap") or get("subsamplingRate") == 1
    return plain and names and drawn and get("maxDepth") >= DEEP and get("maxBins") <= 256 and get("numTrees") > 1


def _subset(strategy: str, features: int) -> int:
    sizes = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features)))}
    return sizes.get(strategy, math.ceil(features / 3))


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds: between all distinct values, or where the share of values below comes nearest to equal steps."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middle) <= most:
        return middle
    stride = len(values) / (most + 1)
    out, target, below = [], stride, np.cumsum(counts).tolist()
    for i in range(1, len(below)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _thresholds(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds of all features from as many rows as Spark ML takes."""
    bins, wanted = min(bins, n), max(bins * bins, 10_000)
    taken = rows.sample(wanted / n, seed=seed) if n > wanted else rows
    values = taken.select(F.posexplode("x").alias("f", "v"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"f": pdf["f"].iloc[:1], "cuts": [thresholds(pdf["v"].to_numpy(), bins - 1)]})

    found = {r["f"]: np.array(r["cuts"]) for r in values.groupBy("f").applyInPandas(cut, "f int, cuts array<double>").collect()}
    return [found[f] for f in sorted(found)]


def _binned(plan: Plan) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([plan.seed & 0xFFFFFFFF, TaskContext.get().partitionId()])
        p = len(plan.cuts)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
            out = np.empty((n, p + plan.trees), np.uint8)
            for f, cuts in enumerate(plan.cuts):
                out[:, f] = np.searchsorted(cuts, x[:, f])
            out[:, p:] = 1 if plan.rate is None else np.minimum(rng.poisson(plan.rate, (n, plan.trees)), 255)
            ends = np.arange(n + 1, dtype=np.int32) * out.shape[1]
            packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column("label"), packed], ["label", "packed"])

    return run


def _blocks(batches: Iterable[pa.RecordBatch], plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins (by feature), weights (by tree) and labels of many rows at once."""
    p = len(plan.cuts)
    held, rows, most = [], 0, max(4096, min(1 << 17, SENT_BYTES // (plan.trees * (p + 9))))

    def joined():
        wide = np.concatenate([w for w, _ in held])
        return np.ascontiguousarray(wide[:, :p].T), np.ascontiguousarray(wide[:, p:].T), np.concatenate([y for _, y in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column("packed")
        packed = packed.cast(pa.large_binary())
        start, data = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset], np.frombuffer(packed.buffers()[2], np.uint8)
        wide = data[start:start + batch.num_rows * (p + plan.trees)].reshape(batch.num_rows, -1)
        held.append((wide, batch.column("label").to_numpy()))
        rows += batch.num_rows
        if rows >= most:
            yield joined()
            held, rows = [], 0
    if held:
        yield joined()


def _walk(left: np.ndarray, feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node each row comes to."""
    at, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while len(live := live[left[at[live]] >= 0]):
        node = at[live]
        at[live] = left[node] + (bins[feature[node], rows[live]] > cut[node])
    return at


def _better(best: dict[str, np.ndarray], feature: np.ndarray, count: np.ndarray, total: np.ndarray, cuts: np.ndarray, leaf: int) -> None:
    """Replace each node's split in ``best`` by one of ``feature`` that is better (by the squared sums over weights of both sides)."""
    lc, ls = count.cumsum(axis=1), total.cumsum(axis=1)
    rc, rs = lc[:, -1:] - lc, ls[:, -1:] - ls
    ok = (lc >= leaf) & (rc >= leaf) & (np.arange(count.shape[1]) < cuts[feature][:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(ok, ls * ls / lc + rs * rs / rc, -np.inf)
    at = score.argmax(axis=1)
    top = score[np.arange(len(at)), at]
    won = top > best["score"]
    best["score"][won], best["feature"][won], best["cut"][won] = top[won], feature[won], at[won]


def _unsplit(n: int) -> dict[str, np.ndarray]:
    return {"score": np.full(n, -np.inf), "feature": np.full(n, LEAF), "cut": np.zeros(n, np.int64)}


def _gains(best: dict[str, np.ndarray], sums: np.ndarray, plan: Plan) -> np.ndarray:
    """The gain of each node's split, 0 where it is lost in rounding."""
    gain = (best["score"] - sums[:, 1] ** 2 / sums[:, 0]) / sums[:, 0]
    return np.where(gain > 1e-12 * plan.variance + 1e-28 * plan.mean ** 2, gain, 0.0)


def grow_node(bins: np.ndarray, weight: np.ndarray, label: np.ndarray, plan: Plan, depth: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Everything below a node, ``depth`` levels at most, from the bins (by feature), weights and centred labels of its rows."""
    sizes = np.array([len(c) for c in plan.cuts])
    width, p = int(sizes.max(initial=0)) + 1, len(sizes)
    w = weight.astype(np.float64)
    wy, wyy = w * label, w * label * label
    feature, cut, left, gain = [], [], [], []
    sums = [np.array([[w.sum(), wy.sum(), wyy.sum()]])]
    rows, node, made = np.arange(len(w)), np.zeros(len(w), np.int64), 1
    for level in range(depth + 1):
        here = sums[-1]
        best, gained = _unsplit(len(here)), np.zeros(len(here))
        wide = np.flatnonzero(here[:, 0] >= 2 * plan.leaf) if level < depth else np.empty(0, np.int64)
        step = max(1, SUMS // max(width, p))
        for s in range(0, len(wide), step):
            part = wide[s:s + step]
            slot_of = np.full(len(here), -1)
            slot_of[part] = np.arange(len(part))
            slot = slot_of[node]
            inside = np.flatnonzero(slot >= 0) if len(part) < len(here) else slice(None)
            slot, held = slot[inside], rows[inside]
            hw, hy = w[held], wy[held]
            chosen = rng.random((len(part), p)).argsort(axis=1)[:, :plan.subset] if plan.subset < p else np.tile(np.arange(p), (len(part), 1))
            found = _unsplit(len(part))
            for j in range(chosen.shape[1]):
                f = chosen[:, j]
                cell = slot * width + bins[f[slot], held]
                count, total = (np.bincount(cell, v, len(part) * width).reshape(-1, width) for v in (hw, hy))
                _better(found, f, count, total, sizes, plan.leaf)
            gained[part] = _gains(found, here[part], plan)
            for k in best:
                best[k][part] = found[k]
        inner = gained > 0
        number = np.cumsum(inner) - 1
        kids = np.where(inner, made + 2 * number, -1)
        feature.append(np.where(inner, best["feature"], LEAF))
        cut.append(best["cut"])
        left.append(kids)
        gain.append(np.where(inner, gained, -1.0))
        count = int(inner.sum())
        if not count:
            break
        keep = np.flatnonzero(inner[node])
        rows, node = rows[keep], node[keep]
        node = 2 * number[node] + (bins[best["feature"][node], rows] > best["cut"][node])
        sums.append(np.stack([np.bincount(node, v[rows], 2 * count) for v in (w, wy, wyy)], axis=1))
        made += 2 * count
    return {"feature": np.concatenate(feature), "cut": np.concatenate(cut), "left": np.concatenate(left), "gain": np.concatenate(gain), "sums": np.concatenate(sums)}


def _subtree(plan: Plan, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, gain: np.ndarray, sums: np.ndarray) -> dict[str, list]:
    """Arrays of a row of ``SUBTREE``: bins become thresholds, the sums those of the labels themselves."""
    cuts = [c.tolist() for c in plan.cuts]
    n, s, q = sums.T
    return {
        "size": len(feature), "feature": feature, "cut": np.array([cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist())]), "left": left,
        "count": n, "total": s + n * plan.mean, "square": q + 2 * plan.mean * s + n * plan.mean ** 2, "gain": gain,
    }


def _summed(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of weight, centred label and its square by large node, feature of its subset and bin."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, trees, slots, chosen = shared.value
        width = max(len(c) for c in plan.cuts) + 1
        sums = np.zeros((len(chosen), 3, chosen.shape[1], width))
        for bins, weights, label in _blocks(batches, plan):
            label = label - plan.mean
            for t, slot_of in slots.items():
                rows = np.flatnonzero(weights[t])
                slot = slot_of[_walk(*trees[t], bins, rows)]
                first, n = slot_of[slot_of >= 0].min(), int((slot_of >= 0).sum())
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                w = weights[t][rows].astype(np.float64)
                y = label[rows]
                for j in range(chosen.shape[1]):
                    cell = (slot - first) * width + bins[chosen[slot, j], rows]
                    for k, v in enumerate((w, w * y, w * y * y)):
                        sums[first:first + n, k, j] += np.bincount(cell, v, n * width).reshape(n, width)
        full = np.flatnonzero(sums[:, 0, 0].any(axis=1))
        for at in range(0, len(full), 64):
            some = full[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sums[i].tobytes() for i in some], pa.binary())], ["slot", "sums"])

    return run


def _splits(rows: DataFrame, plan: Plan, trees: list[tuple], open_nodes: list[tuple[int, int]]) -> dict[int, tuple]:
    """For each large node (by its place) the feature, cut and gain of its best split (``LEAF`` for none), its own sums and those of its left side."""
    sc = rows.sparkSession.sparkContext
    p = len(plan.cuts)
    chosen = np.array([np.sort(np.random.default_rng([plan.seed & 0xFFFFFFFF, t, i]).permutation(p)[:plan.subset]) for t, i in open_nodes])
    slots = {}
    for slot, (t, i) in enumerate(open_nodes):
        slots.setdefault(t, np.full(len(trees[t][0]), -1))[i] = slot
    width, sizes = max(len(c) for c in plan.cuts) + 1, np.array([len(c) for c in plan.cuts])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        sums = np.sum([np.frombuffer(b) for b in pdf["sums"]], axis=0).reshape(3, -1, width)
        whole, best = sums[:, 0].sum(axis=1), _unsplit(1)
        for j, f in enumerate(chosen[slot]):
            _better(best, np.array([f]), sums[0, j][None], sums[1, j][None], sizes, plan.leaf)
        gain = float(_gains(best, whole[None], plan)[0])
        f, cut = (int(best["feature"][0]), int(best["cut"][0])) if gain > 0 else (LEAF, 0)
        j = chosen[slot].tolist().index(f) if f >= 0 else 0
        return pd.DataFrame([(slot, f, cut, gain, whole, sums[:, j, :cut + 1].sum(axis=1))], columns=["slot", "f", "cut", "gain", "whole", "below"])

    got = rows.mapInArrow(_summed(sc.broadcast((plan, trees, slots, chosen))), "slot int, sums binary")
    got = got.groupBy("slot").applyInPandas(choose, "slot int, f int, cut int, gain double, whole array<double>, below array<double>").collect()
    return {r["slot"]: (r["f"], r["cut"], r["gain"], np.array(r["whole"]), np.array(r["below"])) for r in got}


def _large_nodes(rows: DataFrame, plan: Plan, n: int, most: int) -> list[Nodes]:
    """All nodes down to those of at most ``most`` weighted rows, which are marked ``APART``."""
    trees = [Nodes() for _ in range(plan.trees)]
    for tree in trees if n <= most else ():
        tree.feature[0] = APART
    todo = [] if n <= most else [(t, 0) for t in range(plan.trees)]
    at_once = max(1, KEPT_BYTES // (24 * plan.subset * (max(len(c) for c in plan.cuts) + 1)))
    while todo:
        found = []
        arrays = [tuple(np.array(a) for a in (t.left, t.feature, t.cut)) for t in trees]
        for s in range(0, len(todo), at_once):
            part = todo[s:s + at_once]
            splits = _splits(rows, plan, arrays, part)
            found += [(*node, splits[k]) for k, node in enumerate(part) if k in splits]
        todo = []
        for t, i, (f, cut, gain, whole, below) in found:
            tree = trees[t]
            tree.sums[i] = whole
            if f < 0:
                continue
            for kid in tree.split(i, f, cut, gain, below):
                count = tree.sums[kid][0]
                if tree.depth[kid] >= plan.depth or count < 2 * plan.leaf:
                    continue
                if count <= most:
                    tree.feature[kid] = APART
                else:
                    todo.append((t, kid))
    return trees


def _sent(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of each node that is grown apart, many at a time: bins, weights and labels one after the other."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, trees, apart = shared.value
        for bins, weights, label in _blocks(batches, plan):
            for t, (left, feature, cut) in enumerate(trees):
                rows = np.flatnonzero(weights[t])
                place = apart[t][_walk(left, feature, cut, bins, rows)]
                rows, place = rows[place >= 0], place[place >= 0]
                order = np.argsort(place, kind="stable")
                rows, place = rows[order], place[order]
                ends = np.append(np.flatnonzero(np.diff(place)) + 1, len(place)) if len(place) else []
                keys, packed, start = [], [], 0
                for end in ends:
                    own = rows[start:end]
                    keys.append(int(place[start]))
                    packed.append(bins[:, own].tobytes() + weights[t][own].tobytes() + label[own].tobytes())
                    start = end
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], ["place", "packed"])

    return run


def _grown(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row of ``SUBTREE`` for each node that is grown apart; the rows of a node come one after the other."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, places = shared.value
        p = len(plan.cuts)
        records = (r for batch in batches for r in zip(batch.column("place").to_pylist(), batch.column("packed")))
        for place, parts in groupby(records, key=lambda r: r[0]):
            bins, weights, labels = [], [], []
            # the order in which they come may differ from run to run, the sums of a node may not
            for raw in sorted(value.as_py() for _, value in parts):
                m = len(raw) // (p + 9)
                bins.append(np.frombuffer(raw, np.uint8, m * p).reshape(p, m))
                weights.append(np.frombuffer(raw, np.uint8, m, m * p))
                labels.append(np.frombuffer(raw, np.float64, m, m * (p + 1)))
            tree, at, depth = places[place]
            rng = np.random.default_rng([plan.seed & 0xFFFFFFFF, tree, at])
            made = grow_node(np.concatenate(bins, axis=1), np.concatenate(weights), np.concatenate(labels) - plan.mean, plan, plan.depth - depth, rng)
            row = {"tree": tree, "at": at} | _subtree(plan, **made)
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in _KINDS.items()], list(SUBTREE))

    return run


_KINDS = {c: pa.int32() if kind == "int" else pa.list_(pa.int32() if "int" in kind else pa.float64()) for c, kind in SUBTREE.items()}


def _saved_nodes(first_ids: dict[tuple[int, int], int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes as Spark ML saves them; a node's children have larger numbers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, at = (batch.column(c)[i].as_py() for c in ("tree", "at"))
                feature, cut, left, n, s, q, gain = (batch.column(c)[i].values.to_numpy() for c in list(SUBTREE)[3:])
                ids = np.arange(len(feature))
                if at >= 0:
                    ids = first_ids[tree, at] + ids - 1
                    ids[0] = at
                down = np.where(left >= 0, left + (first_ids[tree, at] - 1 if at >= 0 else 0), -1)
                keep = np.flatnonzero(feature != APART)
                ids, down, feature, cut, n, s, q, gain = (a[keep] for a in (ids, down, feature, cut, n, s, q, gain))
                k, inner, some = len(keep), feature >= 0, np.maximum(n, 1.0)
                mean = s / some
                stats = pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * 3, np.stack([n, s, q], axis=1).ravel())
                at_cut = pa.ListArray.from_arrays(np.append(0, np.cumsum(inner)).astype(np.int32), cut[inner])
                split = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), at_cut, pa.array(np.full(k, -1), pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
                right = np.where(down >= 0, down + 1, -1)
                columns = {
                    "id": pa.array(ids, pa.int32()), "prediction": pa.array(mean), "impurity": pa.array(np.maximum(q / some - mean * mean, 0.0)), "impurityStats": stats,
                    "rawCount": pa.array(n.astype(np.int64)), "gain": pa.array(gain), "leftChild": pa.array(down, pa.int32()), "rightChild": pa.array(right, pa.int32()), "split": split,
                }
                node = pa.StructArray.from_arrays(list(columns.values()), list(columns))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, tree), pa.int32()), node], ["treeID", "nodeData"])

    return run


def grow(estimator: RandomForestRegressor, table: DataFrame) -> RandomForestRegressionModel:
    """The forest that ``estimator`` describes, grown on the labels and features of a written table."""
    spark = table.sparkSession
    get = estimator.getOrDefault
    rows = table.select(F.col(get("labelCol")).cast("double").alias("label"), vector_to_array(get("featuresCol")).alias("x"))
    unfit = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)) | F.isnan("label") | (F.abs("label") == math.inf) | F.col("label").isNull()
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"), F.min(F.size("x")).alias("least"), F.max(unfit).alias("unfit"),
                    F.avg("label").alias("mean"), F.var_pop("label").alias("variance")).first()
    if not told["n"] or told["unfit"] or not told["p"] or told["p"] != told["least"]:
        return estimator.fit(table)  # which says what is wrong
    n, p, trees = told["n"], told["p"], get("numTrees")
    strategy = get("featureSubsetStrategy")
    plan = Plan(trees, get("maxDepth"), get("minInstancesPerNode"), _subset("onethird" if strategy == "auto" else strategy, p), get("seed"),
                get("subsamplingRate") if get("bootstrap") else None, _thresholds(rows, n, get("maxBins"), get("seed")), told["mean"], told["variance"])
    binned = materialize(rows.mapInArrow(_binned(plan), "label double, packed binary"), "binned")
    most = max(1000, min(NODE_ROWS, NODE_BYTES // (p + 16)))
    tops = _large_nodes(binned, plan, n, most)

    places = [(t, i, top.depth[i]) for t, top in enumerate(tops) for i, f in enumerate(top.feature) if f == APART]
    apart = [np.full(len(top.feature), -1) for top in tops]
    for place, (t, i, _) in enumerate(places):
        apart[t][i] = place
    arrays = [tuple(np.array(a) for a in (t.left, t.feature, t.cut)) for t in tops]
    sc = spark.sparkContext
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * sc.defaultParallelism, n * trees * (p + 9) // PART_BYTES)
    sent = binned.mapInArrow(_sent(sc.broadcast((plan, arrays, apart))), "place int, packed binary").repartition(parts, "place").sortWithinPartitions("place")
    schema = ", ".join(f"{c} {kind}" for c, kind in SUBTREE.items())
    below = materialize(sent.mapInArrow(_grown(sc.broadcast((plan, places))), schema), "subtrees")

    first_ids, ends = {}, [len(top.feature) for top in tops]
    for r in below.select("tree", "at", "size").orderBy("tree", "at").collect():
        first_ids[r["tree"], r["at"]] = ends[r["tree"]]
        ends[r["tree"]] += r["size"] - 1
    above = []
    for t, top in enumerate(tops):
        if top.feature[0] == APART and (t, 0) not in first_ids:
            top.feature[0] = LEAF  # the tree drew none of the few rows
        row = {"tree": t, "at": -1} | _subtree(plan, *(np.array(a) for a in (top.feature, top.cut, top.left, top.gain)), np.array(top.sums))
        above.append(tuple(row[c] for c in SUBTREE))
    nodes = small_table(spark, above, **SUBTREE).unionByName(below).mapInArrow(_saved_nodes(first_ids), NODE)

    # everything but the nodes comes from a forest of one row
    path = new_path(spark, "forest")
    one = spark.range(1).select(F.lit(0.0).alias(get("labelCol")), array_to_vector(F.array_repeat(F.lit(0.0), p)).alias(get("featuresCol")))
    form = estimator.fit(one)
    form.write().save(path)
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    return GrownRandomForest(form, path, sum(ends))


class GrownRandomForest(RandomForestRegressionModel):
    """A saved forest that the driver loads when something asks for more than its size or its predictions."""

    def __init__(self, form: RandomForestRegressionModel, path: str, nodes: int):
        self.__dict__.update(form.__dict__)
        self._saved_at, self._nodes, self._loaded, self._features = path, nodes, None, form.numFeatures

    @property
    def _java_obj(self):
        if self._loaded is None:
            self._loaded = RandomForestRegressionModel.load(self._saved_at)
        return self._loaded._java_obj

    @_java_obj.setter
    def _java_obj(self, other):
        self._loaded = RandomForestRegressionModel(other)

    @classmethod
    def read(cls):
        return RandomForestRegressionModel.read()

    def __del__(self):
        pass  # what was loaded goes on its own

    @property
    def trees(self) -> list:
        return [DecisionTreeRegressionModel(tree) for tree in self._call_java("trees")]

    @property
    def totalNumNodes(self) -> int:
        return self._nodes

    @property
    def numFeatures(self) -> int:
        return self._features

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self.getOrDefault("numTrees")


# --- saved models and predictions -------------------------------------------------------------


def saved_at(spark: SparkSession, model) -> str:
    """Where the model is saved in the shared folder; it is written once."""
    if getattr(model, "_saved_at", None) is None:
        path = new_path(spark, "model")
        model.write().save(path)
        model._saved_at = path
    return model._saved_at


class Walk(NamedTuple):
    """Trees for predictions: their roots and, for all nodes, the feature, threshold, left child (its brother comes next) and prediction.

    A leaf leads to itself: its threshold is infinite.
    """

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    down: np.ndarray
    value: np.ndarray

    def ends(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """For some rows at a time and one tree after the other the leaves that the rows come to."""
        for s in range(0, len(x), 8192):
            part = np.ascontiguousarray(x[s:s + 8192])
            flat, first = np.where(np.isnan(part), np.inf, part).ravel(), np.arange(len(part)) * x.shape[1]
            for root in self.roots.tolist():
                node = np.full(len(part), root)
                while ((down := self.down.take(node)) != node).any():
                    at = self.feature.take(node)
                    at += first
                    node = down + (flat.take(at) > self.cut.take(node))
                yield slice(s, s + len(part)), node


def _walk_of(spark: SparkSession, model: RandomForestRegressionModel) -> Walk:
    d = F.col("nodeData")
    cut = F.coalesce(F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(math.inf))
    got = spark.read.parquet(f"{saved_at(spark, model)}/data").select(
        "treeID", d["id"].alias("id"), d["split"]["featureIndex"].alias("feature"), cut.alias("cut"), d["leftChild"].alias("left"), d["rightChild"].alias("right"),
        d["prediction"].alias("value")).toArrow()
    tree, number = (got.column(c).to_numpy() for c in ("treeID", "id"))
    order = np.lexsort((number, tree))
    roots = np.flatnonzero(number[order] == 0)
    start = np.repeat(roots, np.diff(np.append(roots, len(order))))
    left, right = (got.column(c).to_numpy()[order] for c in ("left", "right"))
    # level by level, brothers side by side
    levels = [roots]
    while len(inner := levels[-1][left[levels[-1]] >= 0]):
        levels.append(np.stack([start[inner] + left[inner], start[inner] + right[inner]], axis=1).ravel())
    place = np.concatenate(levels)
    at = np.empty(len(place), np.int64)
    at[place] = np.arange(len(place))
    inner = left[place] >= 0
    down = np.arange(len(place))
    down[inner] = at[(start + left)[place[inner]]]
    rest = order[place]
    feature, cut, value = (got.column(c).to_numpy()[rest] for c in ("feature", "cut", "value"))
    return Walk(at[roots], np.maximum(feature, 0).astype(np.int64), cut, down, value)


def walk_forest(x: np.ndarray, walk: Walk) -> np.ndarray:
    """The mean of the trees' predictions, added up in the order of the trees."""
    out = np.zeros(len(x))
    for rows, node in walk.ends(x):
        out[rows] += walk.value[node]
    return out / len(walk.roots)


def transform(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform``; a large or grown regression forest is sent to the tasks as arrays."""
    last = model.stages[-1]
    if len(model.stages) > 1 or not isinstance(last, RandomForestRegressionModel) or not isinstance(last, GrownRandomForest) and last.totalNumNodes < WALKED:
        return model.transform(df)
    if getattr(last, "_walk", None) is None:
        last._walk = df.sparkSession.sparkContext.broadcast(_walk_of(df.sparkSession, last))
    shared = last._walk

    @F.arrow_udf("double")
    def predict(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        return pa.array(walk_forest(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), shared.value))

    return df.withColumn(last.getPredictionCol(), predict(vector_to_array(F.col(last.getFeaturesCol()))))
