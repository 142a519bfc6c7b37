"""The pipeline against plain Python, stage by stage."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from propspark.llm import bpe
from tests.llm import brute
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_quality import counts
from tests.llm.test_similarity_join import classes

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(line):
    words = len(WORDS.findall(line))
    return (len(re.findall(r"[\x20\x09-\x0D](?:[|»›•·/>]|::)[\x20\x09-\x0D]", line)) >= 3
            or len(re.findall(r"[#*$%&!?|<>]{2,}(?:[\x20\x09-\x0D]|$)", line)) * 100 > words * 30
            or words >= 5 and not re.search("[.!?…,;:。！？，、]", line)
            or bool(re.search(r"all rights reserved|licen[cs]ed under|released under|terms of (use|service)|privacy policy|"
                              r"cookie|javascript|click here|subscribe|sign in|log in|copyright", line, re.I)))


def rules(docs):
    out = []
    for key, text in docs:
        lines = text.split("\n")
        full = [x for x in lines if WORDS.search(x)]
        bad = [x for x in full if fails(x)]
        if not counts(text)[-1] and 100 * sum(map(len, bad)) <= 50 * sum(map(len, full)):
            out.append((key, "\n".join(x for x in lines if not (WORDS.search(x) and fails(x)))))
    return out


def lines(docs):
    out = []
    for (key, text), (left, gone) in zip(docs, line_brute(docs)):
        if gone == 0 or gone < sum(bool(WORDS.search(x)) for x in text.split("\n")):
            out.append((key, left))
    return out


def near(docs):
    return [d for d, (c, _) in zip(docs, classes(docs)) if d[0] == c]


def benchmark(docs, items):
    out = []
    for (key, text), (n, hit, _) in zip(docs, brute.find_items([t for _, t in docs], items)):
        if 2 * hit > n:
            continue
        if hit:
            text = cut(text, items)
            if not text.strip(" "):
                continue
        out.append((key, text))
    return out


def cut(text, items, window=10):
    words = list(brute.WORD.finditer(brute.lower(text)))
    grams = set()
    for _, t in items:
        own = brute.WORD.findall(brute.lower(t))
        size = min(window, len(own))
        grams |= {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
    hit = set()
    for i in range(len(words)):
        for size in {len(g) for g in grams}:
            if tuple(m.group() for m in words[i:i + size]) in grams:
                hit.update(range(i, min(i + size, len(words))))
    drop = set()
    for i in hit:
        drop.update(range(words[i].start(), words[i].end()))
        if i + 1 in hit:
            drop.update(range(words[i].end(), words[i + 1].start()))
    return "".join(c for i, c in enumerate(text) if i not in drop)


def test_pipeline(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = benchmark(near(lines(rules(docs))), items)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    got = sorted(corpus_pipeline.run(spark, SF).collect())
    assert [r.doc_id for r in got] == [k for k, _ in want]
    for r, (_, text) in zip(got, want):
        assert r.ids == model.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == brute.sha(text) and r.n_chars == len(text)
    assert 0 < len(got) < len(docs)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
