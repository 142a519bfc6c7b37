"""Token files against the tokenizer itself."""

import numpy as np
import pytest
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from propspark.llm import queries, token_files
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "  ", "a<|endoftext|>b  c", "don't  É́ x́ ́y", "ΑΣ Σ", "a b\x1cc d\x85e\xa0f", "가 ᆨ", "日本語 テスト 123 !!", "İstanbul ǅ",
    "'s 't x's <|startoftext|> <|endoftext|>", "\r\n\t x\x0b", "ȩ́", "힣 🙂🙂 ‍", "x" * 30_000, "word " * 20_000, "²³¼ º ª ß",
]


def expected(name, rows, end_id=2):
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((key, start, len(ids), brute.crc_ids(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, name):
    rows = [(3 * i - 7, t) for i, t in enumerate(ODD)] + [(None, "null key")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, part string").repartition(3)
    manifest = token_files.write_tokens(df, public_tokenizers.path(name))
    got = [tuple(r) for r in token_files.read_tokens(manifest).orderBy("start").collect()]
    assert got == expected(name, rows)
    ids = token_files.read_tokens(manifest, with_ids=True).filter(F.col("doc_id") == -7 + 3 * 15).first().ids
    assert brute.crc_ids(ids) == next(r[3] for r in got if r[0] == -7 + 3 * 15)


def test_empty_and_equal_keys(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.read_tokens(token_files.write_tokens(none, path)).count() == 0
    rows = [(1, "b"), (1, "b"), (1, "a c")]
    got = token_files.read_tokens(token_files.write_tokens(spark.createDataFrame(rows, "doc_id int, text string"), path)).collect()
    assert sorted(r.start + r.n_tokens for r in got)[-1] == sum(r.n_tokens for r in got) == 7


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op4_token_files"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected("word_bpe_49k.json", rows)


def test_every_character_to_024f():
    """Each character inside, before and after a piece, and beside letters of two scripts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    model, encoder = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path, None)
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f"{c}ab c", f"ab{c} c", f"é{c}1", c):
            ids = np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist()
            assert ids == model.encode(text, add_special_tokens=False).ids, repr(text)
