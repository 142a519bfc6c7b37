"""Sums of shortest path lengths of many graphs at once, on flat arrays.

Graphs of a batch are one disjoint union. Hanging trees are peeled off first: cutting the edge to a leaf of weight ``w`` (the
atoms merged into it) in a component of ``S`` atoms accounts for ``w * (S - w)`` paths, and its weight moves to its neighbour.
What is left, the rings and what joins them, is searched from 64 starting atoms to a word: a bit of every atom's word says
which of them have reached it, and a level is one OR over the neighbours' words, for all graphs together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Starting atoms of a task row: four words.
SOURCES = 256


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label of each vertex' component: least labels meet over edges, then every chain of labels is halved until none is left."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        # labels are hooked at their own roots, so whole trees of labels move
        np.minimum.at(label, before[u], least)
        np.minimum.at(label, before[v], least)
        while not np.array_equal(shorter := label[label], label):
            label = shorter
        if np.array_equal(label, before):
            return label


def peel(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths over the edges of hanging trees counted at the vertex that was cut off, weights, and whether a vertex was cut off."""
    label = components(n, u, v)
    size = np.bincount(label, minlength=n)[label]
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    # the exclusive or of a vertex' neighbours is its only neighbour once the others are gone
    other = np.zeros(n, np.int64)
    np.bitwise_xor.at(other, u, v)
    np.bitwise_xor.at(other, v, u)
    weight, paths, gone = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        to = other[leaves]
        # of two leaves that only have each other the second one stays
        first = (degree[to] > 1) | (leaves < to)
        leaves, to = leaves[first], to[first]
        paths[leaves] = weight[leaves] * (size[leaves] - weight[leaves])
        gone[leaves] = True
        np.add.at(weight, to, weight[leaves])
        np.subtract.at(degree, to, 1)
        np.bitwise_xor.at(other, to, leaves)
        degree[leaves] = 0
        near = np.unique(to)
        leaves = near[degree[near] == 1]
    return paths, weight, gone


def search(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray, place: np.ndarray, first: np.ndarray, owner: np.ndarray,
           owners: int, words: int) -> np.ndarray:
    """For each graph (``owner`` of a vertex), distances from its vertices of places ``first`` to ``first + 64 * words`` to all
    others, each times the weights of both ends."""
    start, end = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    has, at = np.unique(start, return_index=True)
    bit = place - first
    source = np.flatnonzero((bit >= 0) & (bit < 64 * words))
    seen = np.zeros((n, words), np.uint64)
    seen[source, bit[source] // 64] = np.uint64(1) << (bit[source] % 64).astype(np.uint64)
    weights = np.zeros((owners, 64 * words), np.int64)
    weights[owner[source], bit[source]] = weight[source]
    total, front, depth = np.zeros(owners, np.int64), seen.copy(), 0
    while len(has):
        depth += 1
        reached = np.zeros_like(seen)
        reached[has] = np.bitwise_or.reduceat(front[end], at, axis=0)
        front = reached & ~seen
        new = np.flatnonzero(front.any(axis=1))
        if not len(new):
            break
        seen |= front
        for part in np.array_split(new, max(1, len(new) * words // 4096)):
            bits = np.unpackbits(front[part].astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            np.add.at(total, owner[part], depth * weight[part] * (bits * weights[owner[part]]).sum(axis=1))
    return total


def _union(lists: list[pa.ListArray], rows: int) -> tuple[np.ndarray, ...]:
    """The lists' numbers as one array each, and the row of each number."""
    sizes = np.diff(lists[0].offsets.to_numpy())
    return *(x.flatten().to_numpy().astype(np.int64) for x in lists), np.repeat(np.arange(rows), sizes)


def _cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        src, dst, owner = _union([batch.column("s"), batch.column("d")], rows)
        ends = np.stack([np.concatenate([owner, owner]), np.concatenate([src, dst])])
        vertices, number = np.unique(ends, axis=1, return_inverse=True)
        number = number.reshape(-1)
        n, of = vertices.shape[1], vertices[0]
        u, v = number[:len(src)], number[len(src):]
        if len(u):
            u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        paths, weight, gone = peel(n, u, v)
        trees = np.zeros(rows, np.int64)
        np.add.at(trees, of, paths)
        # vertices of what is left are numbered from 0 on within their graph
        stays = np.flatnonzero(~gone & ((np.bincount(u, minlength=n) + np.bincount(v, minlength=n)) > 0))
        kept = ~gone[u] & ~gone[v]
        left = np.bincount(of[stays], minlength=rows)
        place = np.zeros(n, np.int64)
        place[stays] = np.arange(len(stays)) - np.repeat(np.cumsum(left) - left, left)
        edges = np.bincount(of[u[kept]], minlength=rows)
        order = np.argsort(of[u[kept]], kind="stable")
        offsets = [np.append(0, np.cumsum(x)).astype(np.int32) for x in (edges, left)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("mol_id"), pa.array(trees), pa.ListArray.from_arrays(offsets[0], place[u[kept]][order]),
             pa.ListArray.from_arrays(offsets[0], place[v[kept]][order]), pa.ListArray.from_arrays(offsets[1], weight[stays])],
            names=["mol_id", "trees", "u", "v", "w"])


def _searched(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            u, v, by_edge = _union([batch.column("u"), batch.column("v")], rows)
            weight, owner = _union([batch.column("w")], rows)
            sizes = np.bincount(owner, minlength=rows)
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(owner)) - begin[owner]
            first = batch.column("c").to_numpy().astype(np.int64) * 64 * words
            total = search(len(owner), u + begin[by_edge], v + begin[by_edge], weight, place, first[owner], owner, rows, words)
            yield pa.RecordBatch.from_arrays([batch.column("mol_id"), pa.array(total), batch.column("trees")], names=["mol_id", "part", "trees"])

    return run


def distance_sums(bonds: DataFrame, sources: int = SOURCES) -> DataFrame:
    """``mol_id, wiener``: the sum of shortest path lengths over unordered pairs of atoms of each molecule that has a bond.

    A molecule's bonds are one row (a molecule is a record here); what is left of it without its hanging trees is searched by as
    many rows as it has ``sources`` starting atoms, so a large one spreads over tasks. Pairs without a path add 0.
    """
    words = max(1, sources // 64)
    kind = bonds.schema["mol_id"].dataType.simpleString()
    lists = bonds.where("src <> dst").groupBy("mol_id").agg(F.collect_list("src").alias("s"), F.collect_list("dst").alias("d"))
    cores = lists.mapInArrow(_cores, f"mol_id {kind}, trees bigint, u array<bigint>, v array<bigint>, w array<bigint>")
    chunks = F.floor((F.size("w") + 64 * words - 1) / (64 * words)).cast("int")
    blocks = cores.withColumn("c", F.explode(F.sequence(F.lit(0), F.greatest(chunks - 1, F.lit(0)))))
    blocks = blocks.withColumn("trees", F.when(F.col("c") == 0, F.col("trees")).otherwise(0))
    found = blocks.repartition("mol_id", "c").mapInArrow(_searched(words), f"mol_id {kind}, part bigint, trees bigint")
    return found.groupBy("mol_id").agg((F.expr("sum(part) div 2") + F.sum("trees")).cast("bigint").alias("wiener"))
