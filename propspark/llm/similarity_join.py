"""N-gram Jaccard join with Bayesian pruning of candidate pairs.

Documents with equal shingle sets form one class from the start. Representatives of the classes get MinHash values
whose bands make buckets. Inside a bucket MinHash values are compared a few at a time, and a pair is
dropped as soon as the posterior probability that its similarity reaches the threshold is below a tolerance.
The surviving pairs only say which classes belong together; every pair inside such a cluster is then verified exactly,
by the sizes of intersections, and links are counted where they are found, so no table of pairs is ever made.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from propspark.llm.components import components
from propspark.llm.decontamination import LOWER, WORD
from propspark.llm.text import content, digest, free_shuffles, mix, slices, utf8, word_hashes, word_spans
from propspark.session import materialize

SHINGLE = 5
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: MinHash values compared before each look at the posterior.
STEP = 16
TOLERANCE = 1e-6
#: Classes in one block of a bucket or cluster; larger groups are compared block by block.
BLOCK = 1024

_rng = np.random.default_rng(20_231)
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII; a shingle is five words in a row, or
    all words of a text that has fewer. A text without words has none.
    """
    raw, at = utf8(column)
    raw = LOWER[raw]
    first, end, row = word_spans(raw, at, WORD)
    h = word_hashes(raw, first, end)
    border = np.searchsorted(row, np.arange(len(column) + 1))
    n = max(len(h) - SHINGLE + 1, 0)
    joined = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        joined += h[j:j + n] * _PLACE[j]
    joined = mix(joined)
    for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(joined[a:b - SHINGLE + 1])
        elif b > a:
            yield mix(np.array([(h[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each of the hash functions."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i:i + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@functools.lru_cache
def fewest_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each step, the least number of equal values with which a pair stays a candidate.

    With a uniform prior the similarity has a Beta(s + 1, m - s + 1) posterior after s of m values agree; its tail
    above the threshold is a sum of binomial terms.
    """
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        tail, s = 0.0, 0
        while True:
            tail += math.comb(m + 1, s) * threshold**s * (1 - threshold) ** (m + 1 - s)
            if tail >= tolerance:
                break
            s += 1
        out.append(s)
    return tuple(out)


def _like(one: np.ndarray, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Indices of the rows of ``others`` that are still candidates of ``one`` after all its values."""
    alive = np.arange(len(others))
    same = np.zeros(len(others), np.int32)
    for k, fewest in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        same = same + (others[alive, part] == one[part]).sum(axis=1)
        keep = same >= fewest
        alive, same = alive[keep], same[keep]
        if not len(alive):
            break
    return alive


def _linked(left: np.ndarray, right: np.ndarray | None, least: tuple[int, ...]) -> list[tuple[int, int]]:
    """Edges that connect all rows joined by candidate pairs (inside ``left``, or between the two blocks).

    Pairs that are connected already need no comparison.
    """
    rows = left if right is None else np.concatenate([left, right])
    label = np.arange(len(rows))
    edges = []
    for i in range(len(left)):
        open_ = np.flatnonzero(label[i + 1:] != label[i]) + i + 1 if right is None else (
            np.flatnonzero(label[len(left):] != label[i]) + len(left))
        if not len(open_):
            continue
        for j in open_[_like(rows[i], rows[open_], least)].tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def _dealt(df: DataFrame, group: str, count: Column, member: str, block: int) -> DataFrame:
    """Deal the members of large groups into blocks and send each block to all its pairs of blocks (``x`` <= ``y``)."""
    blocks = F.ceil(count / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), F.col(member)), blocks).cast("int")
    dealt = df.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")


def _sign(df: DataFrame) -> DataFrame:
    """Set digest, number of shingles and MinHash values of every row (doc, hi, lo, text)."""
    kind = df.schema["doc"].dataType.simpleString()

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                sets, sizes, values = [], [], []
                for s in shingle_sets(some.column("text")):
                    sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sizes.append(len(s))
                    values.append(min_hashes(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("doc", "hi", "lo")), pa.array(sets, pa.binary()),
                     pa.array(sizes, pa.int64()), pa.array(values, pa.binary())],
                    names=["doc", "hi", "lo", "set", "n", "values"])

    return df.mapInArrow(sign, f"doc {kind}, hi bigint, lo bigint, set binary, n bigint, values binary")


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        keys = np.zeros(values.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, j])
        at = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), batch.column("set").take(pa.array(at))], names=["bucket", "set"])


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by them; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(reps: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Edges (u, v) that connect all representatives which some bucket shows as a surviving pair."""
    bands = materialize(reps.select("set", "values").mapInArrow(_buckets, "bucket bigint, set binary"), "bands")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = bands.join(shared, "bucket").join(reps.select("set", "values"), "set")
    dealt = _dealt(members, "bucket", F.col("members"), "set", block)
    keys = ["bucket", "x", "y"]
    placed = dealt.select(*keys, "own", "set", "values").repartition(*keys).sortWithinPartitions(*keys)
    least = fewest_matches(threshold, tolerance)

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for group in _groups(batches, keys):
            if group.num_rows < 2:
                continue
            names = group.column("set").to_pylist()
            rows = np.frombuffer(b"".join(group.column("values").to_pylist()), np.uint32).reshape(-1, HASHES)
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            if x == y:
                order, edges = np.arange(len(rows)), _linked(rows, None, least)
            else:
                is_left = group.column("own").to_numpy() == x
                order = np.concatenate([np.flatnonzero(is_left), np.flatnonzero(~is_left)])
                edges = _linked(rows[is_left], rows[~is_left], least)
            u += [names[order[a]] for a, _ in edges]
            v += [names[order[b]] for _, b in edges]
            if len(u) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return placed.mapInArrow(link, "u binary, v binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other.

    Shingles of a single set cannot be shared; the others become columns of two 0/1 matrices, a few thousand at a time.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    own = [np.concatenate(s) if s else np.empty(0, np.uint64) for s in (left, right)]
    shared = np.intersect1d(np.unique(own[0]), np.unique(own[1]))
    sides = []
    for sets, values in zip((left, right), own):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, values)
        if len(shared):
            hit = shared[np.minimum(col, len(shared) - 1)] == values
        else:
            hit = np.zeros(len(values), bool)
        order = np.argsort(col[hit], kind="stable")
        sides.append((row[hit][order], col[hit][order]))
    for first in range(0, len(shared), 4096):
        width = min(4096, len(shared) - first)
        made = []
        for (row, col), sets in zip(sides, (left, right)):
            a, b = np.searchsorted(col, [first, first + width])
            m = np.zeros((len(sets), width), np.float32)
            m[row[a:b], col[a:b] - first] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out.astype(np.int64)


def _verify(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """For each class of a cluster its links (in documents, ``copies`` of the linked classes) and, ``up``, a class that
    it is connected to; several rows of one class are to be summed and joined."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    dealt = _dealt(members.join(size, "cluster"), "cluster", F.col("members"), "set", block)
    keys = ["cluster", "x", "y"]
    placed = dealt.select(*keys, "own", "set", "copies", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    t = Fraction(str(threshold))
    # J >= p / q  <=>  (p + q) * both >= p * (n + m)
    p, q = t.numerator, t.denominator

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            names, copies = group.column("set").to_pylist(), group.column("copies").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            is_left = group.column("own").to_numpy() == x
            a, b = np.flatnonzero(is_left), np.flatnonzero(is_left if x == y else ~is_left)
            both = overlaps([sets[i] for i in a], [sets[i] for i in b])
            near = (p + q) * both >= p * (sizes[a][:, None] + sizes[b][None, :])
            if x == y:
                np.fill_diagonal(near, False)
            links = np.zeros(len(sets), np.int64)
            links[a] += near @ copies[b]
            if x != y:
                links[b] += near.T @ copies[a]
            up = np.arange(len(sets))
            for i, row in enumerate(near):
                other = b[row]
                if len(other):
                    joined = np.unique(up[np.append(other, a[i])])
                    if len(joined) > 1:
                        up[np.isin(up, joined)] = joined[0]
            keep = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, k in zip(names, keep) if k], pa.binary()), pa.array(links[keep], pa.int64()),
                 pa.array([names[i] for i in up[keep]], pa.binary())], names=["set", "links", "up"])

    return placed.mapInArrow(verify, "set binary, links bigint, up binary")


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8,
                      tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: key, text digest (``hi``, ``lo``), ``class_id``, ``n_links``, ``n_copies``,
    ``n_shingles`` and ``stays``.

    ``n_links`` counts the other documents of similarity ``threshold`` or more, exact copies included; ``class_id`` is
    the least key among all documents connected by such links, ``n_copies`` the documents with the same shingle
    set. ``stays`` marks one document of each class: the least (key, text digest), null keys first. Documents without
    words have no links and a class of their own (their key; null if it is null), and stay. Rows equal in key and
    text share one result, an empty table gives an empty one, and texts of any length are compared by all of their
    shingles. A pair at the threshold is missed with a probability below 1e-6 by its bands and below
    ``tolerance`` by the pruning, and not even then if other links put it in one cluster; what is found is exact.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("doc"), content(F.col(f"`{text}`")).alias("text"))
    rows = rows.select("doc", digest(F.col("text")).alias("d"), "text").select("doc", "d.hi", "d.lo", "text")
    signed = materialize(_sign(rows), "signed")
    least = F.min(F.struct("doc", "hi", "lo"))
    reps = signed.filter("n > 0").groupBy("set", "n").agg(
        F.count(F.lit(1)).alias("copies"), least.alias("first"), F.min("doc").alias("key"), F.first("values").alias("values"))
    reps = materialize(reps, "classes")

    clusters = components(_candidates(reps, threshold, tolerance, block))
    clusters = materialize(clusters.select(F.col("id").alias("set"), F.col("root").alias("cluster")), "clusters")
    chosen = reps.join(clusters, "set").select("set", "cluster", "copies", "first.hi", "first.lo")
    bodies = rows.groupBy("hi", "lo").agg(F.first("text").alias("text")).join(chosen, ["hi", "lo"])

    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("set", "cluster", "copies")),
                     pa.array([s.tobytes() for s in shingle_sets(some.column("text"))], pa.binary())],
                    names=["set", "cluster", "copies", "shingles"])

    members = bodies.select("set", "cluster", "copies", "text").mapInArrow(
        shingle, "set binary, cluster binary, copies bigint, shingles binary")
    members = materialize(members, "members")
    free_shuffles(df.sparkSession)
    verified = materialize(_verify(members, threshold, block), "links")
    links = verified.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("set").alias("u"), F.col("up").alias("v")))
    joined = reps.select("set", "copies", "first", "key").join(links, "set", "left").join(
        roots.withColumnRenamed("id", "set"), "set", "left")
    joined = joined.withColumn("root", F.coalesce("root", "set"))
    heads = joined.groupBy("root").agg(F.min("first").alias("head"), F.min("key").alias("class_id"))
    table = joined.join(heads, "root").select(
        "set", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_id", "head")
    out = signed.drop("values").join(table, "set", "left")
    alone = F.col("set").isNull()
    stays = alone | (F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("hi") == F.col("head.hi")) & (F.col("lo") == F.col("head.lo")))
    return out.select(
        F.col("doc").cast(kind).alias(key), "hi", "lo", F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.col("n").alias("n_shingles"), stays.alias("stays"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay: one document of each class of near copies, once if its row is repeated (equal key and text)."""
    same = [F.col(key).alias("__near_key"), F.col("hi").alias("__near_hi"), F.col("lo").alias("__near_lo")]
    marks = similar_documents(df, key, text, threshold).groupBy(*same).agg(
        F.bool_or("stays").alias("stays"), (F.count(F.lit(1)) > 1).alias("repeated"))
    marks = materialize(marks.filter(~F.col("stays") | F.col("repeated")), "near")
    keyed = df.withColumn("__near", digest(content(F.col(f"`{text}`"))))
    met = (F.col(f"`{key}`").eqNullSafe(F.col("__near_key")) & (F.col("__near.hi") == F.col("__near_hi"))
           & (F.col("__near.lo") == F.col("__near_lo")))
    # only texts of repeated rows are shuffled to find them again
    once = keyed.join(marks.filter("stays"), met, "left_semi").withColumn("__near_key", F.col(f"`{key}`"))
    once = once.dropDuplicates(["__near_key", "__near"]).drop("__near_key")
    out = keyed.join(marks, met, "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
