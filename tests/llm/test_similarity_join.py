"""Classes and links against all pairs in plain Python."""

import random

import numpy as np
import pyarrow as pa

from propspark.llm import queries, similarity_join as sj
from propspark.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = brute.WORD.findall(brute.lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows):
    """{row: (class, links)} of rows (key, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(least[find(i)], links[i]) for i in range(len(rows))]


def made(n, seed):
    rng = random.Random(seed)
    rows, bases = [], [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(12)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 20)}"
        rows.append((i, rng.choice([" ", ", "]).join(words)))
    return rows + [(n, ""), (n + 1, None), (n + 2, "?!"), (n + 3, "one two"), (n + 4, "One, two!")]


def test_against_all_pairs(spark):
    rows = made(150, 1)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, set string").repartition(4)
    want = classes(rows)
    for block in (1024, 8):
        got = sj.similar_documents(df, block=block).orderBy("doc_id").collect()
        assert [(r.class_id, r.n_links) for r in got] == want
        assert {r.doc_id for r in got if r.stays} == {c for c, _ in want}
    kept = sj.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c, _ in want}) and kept[0].set == "x"


def test_equal_rows_nulls_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text + " more")], "doc_id int, text string")
    got = sj.similar_documents(df).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(5, 3)}
    assert [r.doc_id for r in got if r.stays] == [None]
    assert sj.similar_documents(df.limit(0)).count() == 0


def test_pruning_bound():
    least = sj.fewest_matches(0.8, 1e-6)
    assert len(least) == sj.HASHES // sj.STEP and list(least) == sorted(least) and least[-1] < 0.8 * sj.HASHES
    texts = [" ".join(f"a{i}" for i in range(200)), " ".join(f"a{i}" for i in range(195)), " ".join(f"b{i}" for i in range(200))]
    values = [sj.min_hashes(s) for s in sj.shingle_sets(pa.array(texts))]
    assert sj._like(values[0], np.array(values[1:]), least).tolist() == [0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = queries.QUERIES["op9_bayesian_jaccard_join"](spark, SF).orderBy("doc_id").collect()
    assert [(r.class_id, r.n_links) for r in got] == classes(rows)


def test_repeated_rows_leave_one(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, body, 5)] * 3 + [(2, body, 6), (3, "short", 7), (3, "short", 7), (None, "none", 8), (None, "none", 8), (3, "other short text", 9), (4, None, 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, hi int")
    got = sorted(map(tuple, sj.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, body, 5), (3, "short", 7), (3, "other short text", 9), (None, "none", 8), (4, None, 1)], key=str)
