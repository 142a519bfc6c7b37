"""Repeated strings against a dictionary of all strings."""

import random

import numpy as np
import pytest

from propspark.llm import queries, suffix_dedup as sd
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def expected(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d in raw:
        for i in range(len(d) - length + 1):
            s = d[i:i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for d in raw:
        hit = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                hit[i + 1:i + 1 + length] = True
        edges = int((hit[1:] & ~hit[:-1]).sum())
        kept = bytes(b for b, h in zip(d, hit[1:]) if not h)
        out.append((len(d), len(d) - len(kept), edges, brute.sha(kept)))
    return out


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.choice([1, 2, 2, 3, 7]) if rng.random() < 0.9 else 0 for _ in range(rng.randint(0, 60))] + [0], np.uint8)
        data = t.tobytes()
        got = sd.suffix_order(t, 100).tolist()
        assert got == sorted(range(len(data)), key=lambda i: data[i:]), data


def made(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé\0", k=rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(shared), word(), "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(50)]
    texts += [texts[0], texts[1], None, "", "x" * 700, "ab" * 300, "x" * (length - 1), shared[0], shared[0]]
    return texts + [f"{'.' * i} {shared[1]} {word() * 9}" for i in range(30)]


@pytest.mark.parametrize("length, crowded", [(40, 4000), (40, 3), (100, 5), (400, 4000)])
def test_against_all_strings(spark, length, crowded):
    texts = made(length + crowded, length)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, key string").repartition(3)
    got = sd.remove_repeats(df, length=length, crowded=crowded).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == expected(texts, length)
    assert got[0].key == "x"


def test_long_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    rng = random.Random(9)
    body = "".join(rng.choices("abc", k=3000))
    texts = [body, body[500:1700] + "z", "q" + body[100:139]]
    want = expected(texts, 40)
    import pyarrow as pa
    a = sd.Anchors(40)
    col = pa.array(texts)
    starts = [sum(int(a.runs(raw)[1].sum()) for i, _, raw in sd._pieces(col, 40) if i == j) for j in range(3)]
    assert starts == [max(0, len(t) - 39) for t in texts] and want[0][1] > 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.remove_repeats(df).count() == 0


def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = queries.QUERIES["op2_two_stage_suffixes"](spark, SF).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == expected([t for _, t in rows], 400)


def test_hot_passage_is_one_row_for_each_segment(spark):
    """What a task sorts and gives out grows with the different segments of a passage, not with the texts that hold it."""
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdef", k=600))
    texts = [f"{i:05d}" * 9 + passage + f"{i:06d}" * 8 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = df.select(sd.digest("text").alias("d"), "text").select("d.hi", "d.lo", "text")
    segments = sd._segments(rows.selectExpr("hi", "lo", "text", "1L AS copies").join(
        sd._keys(rows, sd.Anchors(40)).groupBy("hi", "lo").agg(sd.F.collect_set("key").alias("keys")), ["hi", "lo"]), sd.Anchors(40))
    hits = sd._hits(segments, 40).collect()
    inside = segments.filter(sd.F.lit(passage).contains(sd.F.col("seg").cast("string"))).select(*sd.SAME)
    hot = {tuple(r) for r in inside.distinct().collect()}
    assert inside.count() == 300 * len(hot) > 0
    got = [(h.key, h.seg_hash, h.seg_more) for h in hits]
    assert sorted(x for x in got if x in hot) == sorted(hot)
    done = sd.remove_repeats(df, length=40).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in done] == expected(texts, 40)
