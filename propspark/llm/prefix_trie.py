"""The trie of all prefixes of conversations, from their sorted order and a sparse table of common prefixes.

Conversations are sorted as sequences of turn digests. The members of a prefix are then neighbours: the common prefixes
(LCPs) of adjacent ones inside its interval are no shorter than it. Every candidate prefix finds the left and the right end of its
interval by itself, by binary search over range minima from a sparse table, so no stack and no order of work is needed;
its numbers are differences of running sums over the sorted order.

Intervals are found in blocks of a bounded number of conversations. A prefix that goes on beyond the end of its block is
owned by the block where it begins; each later block adds what it holds of it, and finds the owner by the same search over
a second sparse table, of the blocks' least LCPs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.llm.text import content, utf8
from propspark.session import materialize

#: Conversations of a block at most, and bytes of their turn digests after which it ends.
BLOCK_ROWS, BLOCK_BYTES = 1 << 17, 64 << 20
#: Open prefixes (see the module's text) up to this number are broadcast to their children, more are joined.
SENT_NODES = 100_000
#: Bytes of a turn's digest.
WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id`` and its ``turns`` in order, each as ``sym`` (128 bits of the SHA-256 of role and text,
    in hex) and ``size`` (UTF-8 bytes of the text).

    Turns are ordered by number, null first; turns of one number by their digest. Null roles and texts are empty.
    Rows without a conversation id are left out. Only digests and sizes are shuffled.
    """
    said = content(F.col(f"`{text}`"))
    who = content(F.col(f"`{role}`"))
    sym = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * WIDTH)
    at = F.col(f"`{turn}`")
    rows = df.select(F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.struct(
        at.isNotNull().alias("known"), at.cast("bigint").alias("at"), sym.alias("sym"), F.octet_length(said).cast("bigint").alias("size")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["sym"].alias("sym"), t["size"].alias("size")))
    return rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(turns.alias("turns"))


def share_heads(sequences: DataFrame, group: Column, heads: Column, most: int) -> DataFrame:
    """Every conversation with its first ``heads`` turns (at most ``most``) replaced by those of conversation ``group``.

    All are taken if that one has fewer, none if it does not exist; the conversation's own turns follow after its first
    ``heads``, if it has so many.
    """
    held = materialize(sequences, "sequences")
    first = held.select(F.col("conv_id").alias("head_of"), F.slice("turns", 1, most).alias("head"))
    given = held.withColumns({"head_of": group, "h": heads.cast("int")}).join(first, "head_of", "left")
    head = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    return given.select("conv_id", F.concat(head, rest).alias("turns"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... values."""
    levels = [values]
    while 2 * (step := 1 << (len(levels) - 1)) <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    return levels


def right_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from ``at`` on whose value is below ``depth`` (the number of values if there is none)."""
    at, n = at.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= n)
        fits = fits[levels[k][at[fits]] >= depth[fits]]
        at[fits] += 1 << k
    return at


def left_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to ``at`` whose value is below ``depth`` (-1 if there is none)."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(at + 1 >= 1 << k)
        fits = fits[levels[k][at[fits] + 1 - (1 << k)] >= depth[fits]]
        at[fits] -= 1 << k
    return at


def range_min(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least values from ``left`` up to, not including, ``right``; no range is empty."""
    level = np.frexp((right - left).astype(np.float64))[1] - 1
    out = np.empty(len(left), levels[0].dtype)
    for k in np.unique(level).tolist():
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(levels[k][left[here]], levels[k][right[here] - (1 << k)])
    return out


def adjacent_lcp(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Common turns of each sequence of digests and the next one."""
    words = np.frombuffer(raw.tobytes(), np.uint64).reshape(-1, WIDTH // 8)
    start = offsets // WIDTH
    length = np.diff(start)
    common = np.minimum(length[:-1], length[1:])
    owner = np.repeat(np.arange(len(common)), common)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(common) - common, common)
    other = np.flatnonzero((words[start[owner] + turn] != words[start[owner + 1] + turn]).any(axis=1))
    who, first = np.unique(owner[other], return_index=True)
    common[who] = turn[other[first]]
    return common


TAGGED = "part int, block int, at int, lcp bigint, conv_id bigint, sizes array<bigint>, edge binary"


def _tag(block_rows: int, block_bytes: int):
    """Sorted rows get their block, their place in it and the LCP with the row before (-1 for the first of the partition);
    the first and the last row of a partition keep their digests."""
    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, place, held = TaskContext.get().partitionId(), 0, 0, 0
        before, last, waiting = None, None, None

        def made(columns: dict, ends: bool) -> pa.RecordBatch:
            edge = columns.pop("edge")
            if ends:
                edge[-1] = last
            return pa.RecordBatch.from_pydict(columns | {"edge": pa.array(edge, pa.binary())})

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw, offsets = utf8(batch.column("key"))
            head, tail = raw[:offsets[1]].tobytes(), raw[offsets[-2]:].tobytes()
            lcp = np.full(n, -1, np.int64)
            lcp[1:] = adjacent_lcp(raw, offsets)
            if before is not None:
                lcp[0] = adjacent_lcp(np.frombuffer(before + head, np.uint8), np.array([0, len(before), len(before) + len(head)]))[0]
            blocks, places = np.empty(n, np.int32), np.empty(n, np.int32)
            first = 0
            while first < n:
                if place and (place >= block_rows or held >= block_bytes):
                    block, place, held = block + 1, 0, 0
                full = int(np.searchsorted(offsets, offsets[first] + block_bytes - held, side="left"))
                end = min(n, first + block_rows - place, max(first + 1, full))
                blocks[first:end], places[first:end] = block, place + np.arange(end - first)
                place, held, first = place + end - first, held + int(offsets[end] - offsets[first]), end
            if waiting:
                yield made(waiting, False)
            edge: list[bytes | None] = [None] * n
            if before is None:
                edge[0] = head
            waiting = {"part": pa.array(np.full(n, part, np.int32)), "block": pa.array(blocks), "at": pa.array(places), "lcp": pa.array(lcp),
                       "conv_id": batch.column("conv_id"), "sizes": batch.column("sizes"), "edge": edge}
            before = last = tail
        if waiting:
            yield made(waiting, True)

    return tag


def _borders(tagged: DataFrame) -> dict[int, int]:
    """LCPs of the first row of each partition and the last row before it; one number for each partition."""
    place = F.struct("block", "at")
    ends = tagged.filter(F.col("edge").isNotNull()).groupBy("part").agg(
        F.min_by("edge", place).alias("head"), F.max_by("edge", place).alias("tail"))
    pairs = ends.select("part", "head", F.lag("tail").over(Window.orderBy("part")).alias("before")).filter("before IS NOT NULL")

    def common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [adjacent_lcp(np.frombuffer(x + y, np.uint8), np.array([0, len(x), len(x) + len(y)]))[0]
                     for x, y in zip(batch.column("before").to_pylist(), batch.column("head").to_pylist())]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "lcp": pa.array(found, pa.int64())})

    return {r.part: r.lcp for r in pairs.mapInArrow(common, "part int, lcp bigint").collect()}


#: kind 0: a whole node, 1: a part of one that other blocks share, 2: a piece of the list of its ending conversations.
FOUND = ("kind int, owner bigint, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, total bigint, "
         "fresh bigint, before bigint, parent_conv bigint, parent_owner bigint, seq bigint, ends string")


def _rows(kind: int, n: int, **columns) -> pa.Table:
    arrays = []
    for field in FOUND.split(", "):
        name, type_name = field.split()
        type_ = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[type_name]
        x = np.full(n, kind, np.int32) if name == "kind" else columns.get(name)
        arrays.append(pa.nulls(n, type_) if x is None else pa.array(x, type_) if not isinstance(x, pa.Array) else x)
    return pa.table(arrays, names=[f.split()[0] for f in FOUND.split(", ")])


def _block(number: int, firsts: np.ndarray, least: np.ndarray, table: pa.Table) -> pa.Table:
    """Nodes that begin in a block, and what it adds to nodes that began in earlier ones."""
    table = table.take(pa.array(np.argsort(table.column("at").to_numpy())))
    conv, lcp = table.column("conv_id").to_numpy(), table.column("lcp").to_numpy().copy()
    sizes = table.column("sizes").combine_chunks()
    length = np.diff(sizes.offsets.to_numpy()).astype(np.int64)
    n, lcp[0], after = len(conv), firsts[number], firsts[number + 1]
    start = np.append(0, np.cumsum(length))
    bytes_to = np.append(0, np.cumsum(sizes.flatten().to_numpy().astype(np.int64)))
    total = bytes_to[start[1:]] - bytes_to[start[:-1]]
    fresh = bytes_to[start[1:]] - bytes_to[start[:-1] + np.maximum(lcp, 0)]
    leaf = np.append(lcp[1:], after) < length
    totals, freshes, leaves = (np.append(0, np.cumsum(x)) for x in (total, fresh, leaf))
    levels, convs = sparse_table(lcp), sparse_table(conv)
    second = sparse_table(least[:number]) if number else []

    def owner(depth: np.ndarray) -> np.ndarray:
        return left_end(second, np.full(len(depth), number - 1), depth)

    # each conversation brings the prefixes that are longer than what it shares with the one before
    chain = length - lcp
    begin = np.append(0, np.cumsum(chain))
    i = np.repeat(np.arange(n), chain)
    depth = np.arange(len(i)) - begin[i] + lcp[i] + 1
    left, right = left_end(levels, i, depth), right_end(levels, i + 1, depth)
    opened = (right == n) & (depth <= after)
    before = np.where(depth > 0, bytes_to[start[i] + np.maximum(depth - 1, 0)] - bytes_to[start[i]], 0)
    children = (depth < length[i]).astype(np.int64)

    # parents: the next shorter prefix of the same conversation, or the one that the first of its prefixes branches from
    parent = np.arange(len(i)) - 1
    top = np.flatnonzero(chain > 0)
    top = top[lcp[top] >= 0]
    branch = left_end(levels, top, lcp[top])
    inside = branch >= 0
    to = begin[branch[inside]] + lcp[top[inside]] - lcp[branch[inside]] - 1
    parent[begin[top[inside]]] = to
    np.add.at(children, to, 1)
    outside = top[~inside]
    parent[begin[outside]] = -1
    least_conv = range_min(convs, left, right) if len(i) else conv[:0]
    parent_conv, parent_owner = np.zeros(len(i), np.int64), np.full(len(i), -1, np.int64)
    known = parent >= 0
    parent_conv[known] = least_conv[parent[known]]
    parent_owner[known] = np.where(opened[parent[known]], number, -1)
    if len(outside):
        parent_owner[begin[outside]] = owner(lcp[outside])
    is_known = pa.array((parent_owner < 0) & (depth > 0))

    def nullable(x: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(x, pa.int64(), mask=~there)

    # conversations that end at a prefix are the first of its interval, all equal
    starts = np.flatnonzero(length != lcp)
    stops = np.append(starts[1:], n)
    ends = {}
    for s, e in zip(starts.tolist(), stops.tolist()):
        ends[int(begin[s] + chain[s] - 1)] = ",".join(map(str, conv[s:e].tolist()))

    shut = np.flatnonzero(~opened)
    hashes = [hashlib.sha256(ends[x].encode()).hexdigest() if x in ends else NO_ENDS for x in shut.tolist()]
    numbers = {"depth": depth, "conv_id": least_conv, "n_convs": right - left, "n_children": children, "n_leaves": leaves[right] - leaves[left],
               "total": totals[right] - totals[left], "fresh": freshes[right] - freshes[np.minimum(left + 1, n)] + total[left] - before if len(i) else before,
               "before": before}
    has_owner = parent_owner >= 0
    out = []
    for kind, here in ((0, shut), (1, np.flatnonzero(opened))):
        out.append(_rows(kind, len(here), **{k: v[here] for k, v in numbers.items()}, owner=np.full(len(here), number),
                         parent_conv=nullable(parent_conv[here], is_known.to_numpy(zero_copy_only=False)[here]),
                         parent_owner=nullable(parent_owner[here], has_owner[here]), ends=hashes if kind == 0 else None))
    pieces = [(number, int(depth[x]), text) for x, text in ends.items() if opened[x]]
    if lcp[0] >= 0:
        deep = np.arange(lcp[0] + 1)
        stop = right_end(levels, np.zeros(len(deep), np.int64), deep)
        own = owner(deep)
        out.append(_rows(1, len(deep), depth=deep, owner=own, conv_id=range_min(convs, np.zeros(len(deep), np.int64), stop), n_convs=stop,
                         n_children=np.bincount(lcp[outside], minlength=len(deep)), n_leaves=leaves[stop], total=totals[stop], fresh=freshes[stop]))
        same = int(starts[0]) if len(starts) else n
        if same:
            pieces.append((int(own[-1]), int(lcp[0]), ",".join(map(str, conv[:same].tolist()))))
    out.append(_rows(2, len(pieces), owner=[p[0] for p in pieces], depth=[p[1] for p in pieces], seq=[number] * len(pieces), ends=[p[2] for p in pieces]))
    return pa.concat_tables(out)


def _hash_pieces(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's pieces joined by commas in order; a piece is held at a time."""
    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for owner, depth, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ends"))):
                if (owner, depth) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (owner, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if key:
            done.append((*key, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "sha"), map(list, zip(*done)))))

    rows = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "seq")
    return rows.mapInArrow(join, "owner bigint, depth bigint, sha string")


OUT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def prefix_trie(sequences: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, sent_nodes: int = SENT_NODES) -> DataFrame:
    """All distinct prefixes of the conversations in ``sequences`` (see ``turn_sequences``), the empty one included.

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes in the subtree), ``saved_tokens`` (over the subtree, members but one times the bytes of a node's last text) and
    ``ends_sha256`` (of the ids of the conversations that end there, ascending, joined by commas).

    Equal conversations and any number of members of one prefix may lie in several blocks and partitions, so no group is
    gathered anywhere but as one number for each block; only the list of conversations that end at one node is hashed in one
    task, in pieces of a block, as SHA-256 has to be. A conversation is one row (16 bytes a turn). The driver sees two numbers for each
    block, and these are broadcast. No conversation gives no node; conversations without turns are members of the root.
    """
    spark = sequences.sparkSession
    keyed = sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["sym"]), "")).alias("key"),
                             F.transform("turns", lambda t: t["size"]).alias("sizes"))
    keyed = materialize(keyed, "keyed")  # its range sample and its rows come from one reading
    rows = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    tagged = materialize(rows.mapInArrow(_tag(block_rows, block_bytes), TAGGED), "sorted")
    inner = F.min(F.when(F.col("at") > 0, F.col("lcp")))
    blocks = sorted(tagged.groupBy("part", "block").agg(F.max(F.when(F.col("at") == 0, F.col("lcp"))).alias("first"), inner.alias("least")).collect())
    if not blocks:
        return spark.createDataFrame([], OUT)
    borders = _borders(tagged)
    firsts = np.array([borders.get(b.part, -1) if b.block == 0 else b.first for b in blocks] + [-1], np.int64)
    least = np.array([f if b.least is None else min(f, b.least) for b, f in zip(blocks, firsts.tolist())], np.int64)
    codes = np.array([(b.part << 32) + b.block for b in blocks], np.int64)
    shared = spark.sparkContext.broadcast((codes, firsts, least))

    def nodes(key: tuple, table: pa.Table) -> pa.Table:
        codes, firsts, least = shared.value
        return _block(int(np.searchsorted(codes, key[0].as_py())), firsts, least, table)

    code = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("block")
    found = materialize(tagged.select(code.alias("code"), "at", "lcp", "conv_id", "sizes").groupBy("code").applyInArrow(nodes, FOUND), "nodes")

    numbers = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "fresh")]
    parts = found.filter("kind = 1").groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), *numbers, *[F.max(c).alias(c) for c in ("before", "parent_conv", "parent_owner")])
    hashes = _hash_pieces(found.filter("kind = 2").select("owner", "depth", "seq", "ends"))
    opened = materialize(parts.join(hashes, ["owner", "depth"], "left").withColumn("ends", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha"), "open")

    columns = ["conv_id", "depth", "parent_conv", "parent_owner", "n_convs", "n_children", "n_leaves",
               (F.col("total") - F.col("n_convs") * F.col("before") - F.col("fresh")).alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    every = found.filter("kind = 0").select(*columns).unionAll(opened.select(*columns))
    parents = opened.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("open_parent"))
    if parents.limit(sent_nodes + 1).count() <= sent_nodes:
        parents = F.broadcast(parents)
    rest = every.filter("parent_owner IS NOT NULL").join(parents, ["parent_owner", "depth"], "left").withColumn("parent_conv", F.col("open_parent"))
    result = ["conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return every.filter("parent_owner IS NULL").select(*result).unionAll(rest.select(*result))


#: The trie of ``op12`` as SQL: every prefix of every rebuilt conversation is a group of its own (CRC-32 by its table of 256 numbers).
TRIE_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
), ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc
), turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), sequences AS (SELECT c, list({'r': r, 'x': x} ORDER BY p) AS s FROM turns GROUP BY c),
built AS (
  SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), o.s[h.h + 1:]) AS s
  FROM h JOIN sequences o USING (c) LEFT JOIN sequences b ON b.c = h.c - h.c % 5
), prefixes AS (SELECT c, d, s[1:d] AS node, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends
  FROM prefixes GROUP BY node, d
), kids AS (SELECT node[1:d - 1] AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
weighed AS (
  SELECT n.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (n - 1) * strlen(node[d].x) ELSE 0 END AS w FROM nodes n LEFT JOIN kids USING (node)
), above AS (
  SELECT node[1:e] AS node, sum(w) AS saved, count(*) FILTER (k = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM weighed) GROUP BY 1
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.k AS n_children, a.leaves AS n_leaves,
  a.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM weighed w JOIN above a USING (node) LEFT JOIN nodes p ON w.d > 0 AND p.node = w.node[1:w.d - 1]
"""
