"""Counts against the libraries; the cache encodes each content once."""

import public_tokenizers
import sentencepiece
import tokenizers

from propspark.llm import queries, token_counts
from propspark.session import new_path

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " a  b\n", "<s> </s> <unk>", "日本語 é é 🙂", "word " * 3000, "a\tb\x00c", "same", "same"]


def test_both_libraries(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, hi string")
    cache = new_path(spark, "counts")
    got = token_counts.count_tokens(df, cache, PIECES, limit=100).orderBy("doc_id").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [len(model.encode(t or "")) for t in TEXTS]
    assert [(r.n_bytes, r.n_tokens, r.over_limit, r.hi) for r in got] == [
        (len((t or "").encode()), n, n > 100, "x") for t, n in zip(TEXTS, want)]
    # another tokenizer shares the folder and not the counts
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = token_counts.count_tokens(df, cache, path).orderBy("doc_id").collect()
    model = tokenizers.Tokenizer.from_file(path)
    assert [r.n_tokens for r in other] == [len(model.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]


def test_only_misses_are_encoded(spark):
    cache = new_path(spark, "counts")
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "doc_id int, text string")
    token_counts.count_tokens(one, cache, PIECES)
    assert token_counts.read_cache(spark, cache).count() == 2  # equal contents once, null and empty are one
    two = one.union(spark.createDataFrame([(5, "c")], "doc_id int, text string"))
    assert token_counts.count_tokens(two, cache, PIECES).count() == 5
    assert token_counts.read_cache(spark, cache).count() == 3
    assert token_counts.count_tokens(one.limit(0), cache, PIECES).count() == 0


def test_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_digest_cache"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        k: (len(t.encode()), n := len(model.encode(t)), n > 4096) for k, t in docs.items()}
