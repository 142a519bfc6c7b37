"""Benchmark words against a brute-force search."""

import random

import pytest
from pyspark.sql import functions as F

from propspark.llm import decontamination as dec
from propspark.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def made(seed, n_docs=60, n_items=12):
    rng = random.Random(seed)
    vocabulary = ["ab", "Ba", "c1", "é", "x", "Yz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(n_items)]
    items += [(99, None), (None, "ab ab ab"), (3, items[3][1])]
    docs = []
    for _ in range(n_docs):
        parts = [rng.choice([rng.choice(items)[1] or "", " ".join(rng.choices(vocabulary + ["q", "-!"], k=rng.randint(0, 30)))])
                 for _ in range(rng.randint(0, 5))]
        docs.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return [*docs, None, "", "ab", " ".join(vocabulary * 3000)], items


@pytest.mark.parametrize("block_words", [1, 40, 200_000])
def test_against_brute_force(spark, block_words):
    docs, items = made(block_words)
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(docs)], "doc_id int, text string, state string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = dec.find_items(df, bench, block_words=block_words).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == brute.find_items(docs, items)
    assert [r.state for r in got] == ["other"] * len(docs)
    for r in got:
        raw = (r.text or "").encode()
        assert sum(len(dec.item_words(raw[s["first"]:s["stop"]].decode())) for s in r.spans) == r.n_hit


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert dec.find_items(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.n_words for r in dec.find_items(some, bench).collect()) == [0, 2, 2]


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op10_suffix_automaton"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for d, (n, hit, found) in zip(docs, brute.find_items([d.text for d in docs], items)):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            n, hit, len(found), brute.sha(",".join(found)), hit > 0)
    assert any(r.contaminated for r in got.values())


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Start here {item} and go on for a long while after it with é.", 9), (2, item, 9), (3, "clean", 9), (4, None, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string, n_chars bigint")
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = {r.doc_id: r for r in dec.decontaminate(df, bench).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "Start here  and go on for a long while after it with é." and got[1].n_chars == len(got[1].text)
    assert got[3].n_chars == 9 and got[4].text is None
    assert dec.decontaminate(df, bench, max_share=1.0).filter(F.col("doc_id") == 2).count() == 0
