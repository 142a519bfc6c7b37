"""Aligned token ids against a plain version that unites overlapping tokens."""

import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tokenizers

from propspark.llm import alignment, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NEW = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def letters():
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in same}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in same)}
    return out


def plain(texts):
    """The contract's columns for each text, token by token, from the libraries named in it."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b, back = sentencepiece.SentencePieceProcessor(model_file=B), letters()
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()
              for i in range(b.get_piece_size())]
    rows, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        of_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [pieces[i] for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            rows.append(None)
            continue
        spans = []
        for side in (of_a, of_b):
            at, own = 0, []
            for piece in side:
                own.append((at, at + len(piece)))
                at += len(piece)
            spans.append(own)
        links, j0 = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        counts.update(links)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for cut in both:
            ga, gb = [], []
            while i < len(ids_a) and spans[0][i][1] <= cut:
                ga.append(ids_a[i])
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= cut:
                gb.append(ids_b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    top = {}
    for (x, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        out.append((*r[:3], len(r[3]), sum(counts[x] == top[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), brute.sha(r[4])))
    return out


ODD = [
    None, "", " ", "  a  b", "a\u2581b", "<s></s><unk><|endoftext|> <0x41>", "\x00\x01 \x85\xa0", "h\u00e9llo w\u00f6rld \u4f60\u597d \U0001f642\U0001f642",
    "e\u0301 \ufb01 \u2460", "don't I'll", "x" * 5000, "word and " * 3000, "\n\n\t mixed\r\n", "\u0939\u093f\u0928\u094d\u0926\u0940 \u0e44\u0e17\u0e22", "same text", "same text",
]


@pytest.mark.parametrize("sent", [1 << 20, 40, 0])
def test_against_plain(spark, sent):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("ab cd\u00e9\u4e00\U0001f600\n1.") for _ in range(rng.randint(1, 80))) for _ in range(120)]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "pair int, row string, text string").repartition(4)
    got = alignment.align_documents(df, A, B, sent_pairs=sent, held_pairs=50).orderBy("pair").collect()
    assert [tuple(r[c] for c in NEW) for r in got] == plain(texts)
    assert [(r.pair, r.row, r.text) for r in got] == [(i, "x", t) for i, t in enumerate(texts)]


def test_groups_and_clashes(spark):
    df = spark.createDataFrame([("unbelievable \u00e9",)], "text string")
    row = alignment.align_documents(df, A, B, with_groups=True).first()
    assert brute.sha(row.groups) == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1
    assert alignment.align_documents(df.limit(0), A, B).count() == 0
    with pytest.raises(ValueError):
        alignment.align_documents(df.selectExpr("*", "1 AS n_a"), A, B)


def test_jump():
    assert alignment.jump(np.array([1, 2, 3, 3, 5, 5])).tolist() == [3, 3, 3, 3, 5, 5]


def test_merge_ranks_give_the_same_ids():
    """The rank-based library on every character, in words, beside digits and blanks."""
    model, fast = tokenizers.Tokenizer.from_file(A), alignment.byte_level(A)
    model.encode_special_tokens = True
    for first in range(0, 0x30000, 4096):
        texts = [f"a{c}b {c}{c} 1{c}2.  {c} \n{c}" for c in map(chr, range(first, first + 4096)) if not "\ud800" <= c <= "\udfff"]
        want = [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        assert [list(x) for x in fast.encode(texts)] == want


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op11_pointer_jumping"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in NEW) for r in got] == plain([r.text for r in rows])
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
