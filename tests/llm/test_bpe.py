"""BPE against the library with the same vocabulary."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from propspark.llm import bpe, queries
from propspark.llm.quality import let
from tests.llm import brute

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(VOCABULARY)
MODEL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    None, "", " ", "\n", "  a  b\n\n c ", "a\tb\r\nc", "don't I'll 'S", "日本語 テスト１２3", "é é  x\x85y z", "a\x1cb \x1f c",
    "x" * 3000, "aaab" * 50, "word " * 3000, "🙂🙂‍👩‍👧 ok", "<|endoftext|>", "1234567 12.5%", "ab\n", "\nab", " ab", "ab ", "a \nb",
]


def expected(text):
    ids = MODEL.encode_ordinary(text or "")
    return len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")


def test_odd_texts(spark):
    rng = random.Random(2)
    letters = ["a", "e", "th", "é", "ß", " ", "\n", "!", "9", "ing", "日", "\t", "'s", "🙂"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, block string").repartition(3)
    for hot in (0, 20, bpe.HOT_WORDS):
        got = bpe.encode_documents(df, VOCABULARY, hot_words=hot, with_ids=hot == 20, with_bytes=hot == 20).orderBy("doc_id").collect()
        assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == [expected(t) for t in texts]
        if hot == 20:
            assert [r.ids for r in got] == [MODEL.encode_ordinary(t or "") for t in texts]
            assert [bytes(r.decoded).decode() for r in got] == [t or "" for t in texts]
    assert bpe.encode_documents(df.limit(0), VOCABULARY).count() == 0


def test_words(spark):
    """Every token is its own encoding, and random letters merge as in the library."""
    rng = random.Random(4)
    words = [t.decode() for t in RANKS if all(b < 128 for b in t)][::40]
    words += ["".join(rng.choices("aeinorst", k=rng.randint(1, 40))) for _ in range(400)] + ["a" * n for n in range(1, 60)]
    maps = bpe.rank_map(RANKS)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", let(maps, lambda m: bpe.fold_merges(bpe.first_tokens(RANKS, F.col("w")), m)).alias("s")).collect()
    pairs = {(a << 20) + b: k for a, b, k in bpe.mergeable(RANKS)}
    for r in got:
        raw = [RANKS[bytes([b])] for b in r.w.encode()]
        assert r.s == bpe.fold_short(list(raw), pairs) == bpe.fold_long(list(raw), pairs)
        assert r.s == MODEL._core_bpe.encode_single_piece(r.w.encode()), r.w


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(texts[r.doc_id])


def test_rare_words_together(monkeypatch):
    """Rare words are cut and folded for many texts at once, not one by one, and come out as in the library."""
    rng = random.Random(6)
    marks = ["", "", ".", ",", "'s", "!?", "9", "é"]
    texts = [t or "" for t in ODD] + [
        "\n".join(" ".join("".join(rng.choices("aeinorstßж日", k=rng.randint(1, 70))) + rng.choice(marks) for _ in range(12)) for _ in range(5))
        for _ in range(60)]
    calls = []

    class Split:
        def findall(self, text):
            calls.append(text)
            return split.findall(text)

    split = bpe.SPLIT
    monkeypatch.setattr(bpe, "SPLIT", Split())
    coder = bpe.Coder({}, RANKS)
    ids = [MODEL.encode_ordinary(t) for t in texts]
    for _ in range(2):  # new, then remembered
        assert [bpe.token_ids(c).tolist() for c in coder.encode(texts)] == ids
    assert len(calls) <= 2 * (1 + len(ODD))
    monkeypatch.setattr(bpe, "SPELLED", 3)  # a long text is spelled in parts
    for t, own in zip(texts, ids):
        parts = next(coder.pieces.spell(np.array(own, np.int64), np.array([len(own)])))
        assert b"".join(p.tobytes() for p in parts) == t.encode()
    ends = np.cumsum(list(map(len, ids)))
    parts = coder.decimal.spell(np.array([i for own in ids for i in own]), ends)
    assert [b"".join(p.tobytes() for p in some)[1:].decode() for some in parts] == [",".join(map(str, own)) for own in ids]
