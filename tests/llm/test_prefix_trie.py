"""Tries of conversations against a plain version that keeps every prefix."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from propspark.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Turns of each conversation, (role, text) with nulls as empty, by turn with null first."""
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in held.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in below)
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids.get(node, [])), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def sequences(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    made = prefix_trie.turn_sequences(df)
    turnless = spark.createDataFrame([(c,) for c, turns in convs.items() if not turns], "conv_id bigint")
    return made.unionByName(turnless.selectExpr("conv_id", "CAST(array() AS array<struct<sym: string, size: bigint>>) AS turns"))


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1 << 17])
def test_random_conversations(spark, block_rows):
    rng = random.Random(block_rows)
    convs = {}
    for c in range(160):
        convs[3 * c - 100] = [("u", rng.choice("aab")) for _ in range(rng.choice([0, 1, 2, 3, 6]))]
    for c in range(1000, 1040):  # one large group of copies, and two whose prefixes go on through it
        convs[c] = [("u", "a")] * 5
    convs[1040], convs[1041] = [("u", "a")] * 9, [("u", "a")] * 4 + [("v", "a")]
    df = sequences(spark, convs).repartition(5)
    got = result(prefix_trie.prefix_trie(df, block_rows, block_bytes=200, sent_nodes=3 if block_rows == 2 else 1000))
    assert got == trie(convs)


def test_whole_query_on_odd_rows(spark):
    rows = [(0, None, "s", "é"), (0, 2, None, None), (0, 1, "u", ""), (1, 0, "u", "x"), (1, 1, "u", "y"), (7, 0, "", ""), (None, 0, "u", "x"),
            (9, 0, "u", "w" * 10_000), (9, 1, "u", "w"), (9, 1, "u", "w")]
    rows += [(c, t, "u", f"turn {t % 3}") for c in range(10, 40) for t in range(c % 13)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id int, turn bigint, role string, text string, depth int, turns string")
    assert result(queries.trie_of(df)) == trie(rebuilt(ordered(rows)))
    assert result(queries.trie_of(df.limit(0))) == []


def test_only_turnless(spark):
    assert result(prefix_trie.prefix_trie(sequences(spark, {5: [], 3: []}), block_rows=1)) == trie({5: [], 3: []})


def test_searches():
    values = np.array([3, 1, 4, 4, 0, 5])
    levels = prefix_trie.sparse_table(values)
    rng = np.arange(6)
    for depth in range(7):
        d = np.full(6, depth)
        assert prefix_trie.right_end(levels, rng, d).tolist() == [next((j for j in range(i, 6) if values[j] < depth), 6) for i in range(6)]
        assert prefix_trie.left_end(levels, rng, d).tolist() == [next((j for j in range(i, -1, -1) if values[j] < depth), -1) for i in range(6)]


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.QUERIES["op12_sparse_table_trie"](spark, folder)) == trie(rebuilt(ordered(rows)))
