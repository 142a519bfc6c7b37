"""Token ids of two tokenizers aligned on the bytes they stand for, by pointer jumping.

Both token sequences of a text cover the same bytes. Every token points to the farthest-right token of the other sequence
that overlaps it, or to itself if none reaches farther; doubling the successors (``s = s[s]``, all tokens of many texts in
one array) converges to the last token of each component, which labels the group.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from propspark.llm.text import content, slices
from propspark.session import materialize

#: Pairs whose counts are sent to all tasks (12 bytes each), the most frequent ones; the counts of all others are joined.
SENT_PAIRS = 1 << 20
#: Pairs that a task holds before it hands their counts on.
HELD_PAIRS = 1 << 22
#: Text bytes that are aligned at once (one text at least).
AT_ONCE = 1 << 20


class Tokens(NamedTuple):
    """A tokenizer: ids of texts, and the bytes of each id (None for an id that no text yields)."""

    encode: Callable[[Sequence[str]], list[Sequence[int]]]
    pieces: list[bytes | None]


def _letter_bytes() -> dict[str, int]:
    """Byte-level letters: printable Latin-1 characters stand for their byte, the other bytes are numbered from 256 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict) -> bool:
    """Whether ids are the ranks of the merges, so that merging by rank of the joined bytes gives the same ids."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if (model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix") or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"]
            or not pre["use_regex"]):
        return False
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return all(model["vocab"].get(x) == 256 + i for i, x in enumerate(made)) and all(model["vocab"][c] < 256 for c in _letter_bytes())


#: The split pattern of byte-level tokenizers (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """A byte-level ``.json`` tokenizer without special tokens: their strings in a text are plain text.

    Where ids are merge ranks, the ranks are handed to the faster rank-based library; ids are the same.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    spec = json.loads(model.to_str())
    letters = _letter_bytes()
    special = {t["id"] for t in spec["added_tokens"]}
    pieces: list[bytes | None] = [None] * model.get_vocab_size(True)
    for word, i in model.get_vocab(True).items():
        if i not in special and all(c in letters for c in word):
            pieces[i] = bytes(letters[c] for c in word)
    if not _ranked(spec):
        return Tokens(lambda texts: [e.ids for e in model.encode_batch_fast(list(texts), add_special_tokens=False)], pieces)
    import tiktoken

    ranks = {p: i for i, p in enumerate(pieces) if p is not None}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return Tokens(lambda texts: [fast.encode_to_numpy(t, disallowed_special=()) for t in texts], pieces)


@functools.lru_cache(maxsize=4)
def sentence_pieces(path: str) -> Tokens:
    """A sentencepiece ``.model``; U+2581 is a space and byte pieces are their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(None)
        else:
            pieces.append(piece.replace("▁", " ").encode())
    return Tokens(lambda texts: model.encode(list(texts), num_threads=1), pieces)


class Aligned(NamedTuple):
    """Tokens of many texts and their components. ``links`` are index pairs of overlapping tokens, ``last_a`` and ``last_b`` say
    which tokens end a group, ``per_text`` has the texts' numbers of A tokens, B tokens, groups and links."""

    a: np.ndarray
    b: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    group_a: np.ndarray
    group_b: np.ndarray
    per_text: np.ndarray


def jump(successor: np.ndarray) -> np.ndarray:
    """The end of every chain of successors, by doubling."""
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor
        successor = doubled


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], width_a: np.ndarray, width_b: np.ndarray) -> Aligned:
    """Align texts whose two id sequences cover the same bytes; ``width_a`` and ``width_b`` are the byte lengths of each id."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    a, b = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (ids_a, ids_b))
    if not len(a):
        return Aligned(a, b, (a, b), a, b, np.zeros((len(ids_a), 4), np.int64))
    end_a, end_b = np.cumsum(width_a[a]), np.cumsum(width_b[b])
    # the first token of the other sequence that ends where a token ends, or behind it
    over_a, over_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    farther = end_a[over_b] > end_b
    successor = np.concatenate([len(a) + over_a, np.where(farther, over_b, np.arange(len(a), len(a) + len(b)))])
    terminal = jump(successor) - len(a)  # always a token of b: both sequences end there
    number = np.cumsum(~farther) - 1
    group_a, group_b = number[terminal[:len(a)]], number[terminal[len(a):]]
    first = np.searchsorted(end_b, end_a - width_a[a], side="right")
    each = over_a - first + 1
    link_a = np.repeat(np.arange(len(a)), each)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(each) - each, each) + first[link_a]
    text_a, text_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    per_text = np.stack([n_a, n_b, np.bincount(text_b[~farther], minlength=len(n_a)),
                         np.bincount(text_a, weights=each, minlength=len(n_a)).astype(np.int64)], axis=1)
    return Aligned(a, b, (link_a, link_b), group_a, group_b, per_text)


class _Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size_a: int, size_b: int):
        self.size = max(size_a, size_b)
        self.parts = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def write(self, found: Aligned) -> list[str]:
        a, b, ga, gb = found.a, found.b, found.group_a, found.group_b
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (ga, gb))
        groups = int(found.per_text[:, 2].sum())
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        order = np.empty(len(a) + len(b), np.int64)
        # a group's tokens of a stand behind the tokens of b of all groups before it, its tokens of b behind those of a
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga]] = a + np.where(last_a, self.size, 0)
        order[np.arange(len(b)) + np.cumsum(in_a)[gb]] = b + np.where(last_b, 2 * self.size, 0)
        words = list(map(self.parts.__getitem__, order.tolist()))
        ends = np.cumsum(found.per_text[:, 0] + found.per_text[:, 1]).tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *ends], ends)]


def _wide(pieces: list[bytes | None]) -> np.ndarray:
    return np.array([len(p or b"") for p in pieces], np.int64)


def _joined(ids: Sequence[int], pieces: list[bytes | None]) -> bytes | None:
    found = list(map(pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return None if None in found else b"".join(found)


def align_documents(df: DataFrame, tokenizer_a: str, tokenizer_b: str, text: str = "text", keep: Sequence[str] | None = None,
                    with_groups: bool = False, sent_pairs: int = SENT_PAIRS, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` (with ``with_groups`` also
    ``groups`` itself) to every row.

    ``tokenizer_a`` is a byte-level ``.json`` file, run on a space and the text; ``tokenizer_b`` a sentencepiece ``.model`` that
    puts a space before a text. A text is cut where tokens of both end; a link is a pair of overlapping tokens, the count of a
    pair of ids is the number of its links in all rows, ``count_sum`` adds up the counts of a row's links and ``n_best``
    counts those whose pair has the highest count of its B id (ties included).

    Null and empty texts, and texts that either tokenizer changes (their tokens do not join to a space and the text), have no
    tokens: zeros and an empty digest. Every row counts, repeated rows too. A text of any length is aligned whole, many
    short ones at once. Empty tables give empty results; a kept column called like a new one is an error.

    Texts are encoded once, in the tasks that read them; each text's distinct pairs and their numbers are written to the shared
    folder. Pairs are added up in the tasks, then by Spark. The counts of the ``sent_pairs`` most frequent pairs (a fixed
    number) are broadcast; links of other pairs, none of them frequent, meet their counts in a join. The highest
    count of each B id is a table as long as the vocabulary.
    """
    spark = df.sparkSession
    keep = list(df.columns if keep is None else keep)
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    if set(added) & set(keep):
        raise ValueError(f"columns already there: {sorted(set(added) & set(keep))}")
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], content(F.col(f"`{text}`")).alias("text"))
    fields = [StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)]
    longs = ("n_a", "n_b", "n_groups", "n_links")
    stored = StructType([StructField("row", LongType()), *fields, *(StructField(n, LongType()) for n in longs),
                         StructField("groups_sha256", StringType()), *([StructField("groups", StringType())] if with_groups else []),
                         StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))])
    size_b = len(sentence_pieces(tokenizer_b).pieces)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok_a, tok_b = byte_level(tokenizer_a), sentence_pieces(tokenizer_b)
        width_a, width_b = _wide(tok_a.pieces), _wide(tok_b.pieces)
        writer = _Writer(len(width_a), len(width_b))
        none = np.empty(0, np.int64)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            first = 0
            for part in slices(pa.RecordBatch.from_arrays([batch.column("text")], names=["text"]), "text", AT_ONCE):
                some, first = batch.slice(first, part.num_rows), first + part.num_rows
                texts = part.column("text").to_pylist()
                full = [i for i, t in enumerate(texts) if t]
                ids_a, ids_b = [none] * len(texts), [none] * len(texts)
                for i, x, y in zip(full, tok_a.encode([" " + texts[i] for i in full]), tok_b.encode([texts[i] for i in full])):
                    whole = (" " + texts[i]).encode()
                    if _joined(x, tok_a.pieces) == whole and _joined(y, tok_b.pieces) == whole:
                        ids_a[i], ids_b[i] = np.asarray(x, np.int64), np.array(y, np.int64)
                found = align(ids_a, ids_b, width_a, width_b)
                groups = writer.write(found)
                link_a, link_b = found.links
                codes = found.a[link_a] * size_b + found.b[link_b]
                owner = np.repeat(np.arange(len(texts)), found.per_text[:, 3])
                order = np.lexsort((codes, owner))
                codes, owner = codes[order], owner[order]
                new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]))[:len(codes)])
                times = np.diff(np.append(new, len(codes))).astype(np.int32)
                ends = np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(texts)))).astype(np.int32)
                cols = [pa.array(at + np.arange(len(texts))), *(some.column(n) for n in names),
                        *(pa.array(x) for x in found.per_text.T.copy()),
                        pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                        *([pa.array(groups, pa.string())] if with_groups else []),
                        pa.ListArray.from_arrays(ends, codes[new]), pa.ListArray.from_arrays(ends, times)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=stored.names)

    held = materialize(rows.mapInArrow(encode, stored), "aligned")
    counts = materialize(_pair_counts(held, held_pairs), "pairs")
    best, sent, least, highest = _frequent(counts, size_b, sent_pairs)
    shared = spark.sparkContext.broadcast((best, *sent))

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, codes, numbers = shared.value
        for batch in batches:
            pairs, times = (batch.column(n) for n in ("pairs", "times"))
            lengths = np.diff(pairs.offsets.to_numpy())
            code, each = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.searchsorted(codes, code)
            known = at < len(codes)
            known[known] = codes[at[known]] == code[known]
            n = numbers[at[known]]
            is_best = n == highest[code[known] % size_b]
            total, top = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            np.add.at(total, owner[known], n * each[known])
            np.add.at(top, owner[known], is_best * each[known])
            ends = np.append(0, np.cumsum(np.bincount(owner[~known], minlength=len(lengths)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(top), pa.array(total), pa.ListArray.from_arrays(ends, code[~known]),
                 pa.ListArray.from_arrays(ends, each[~known])], names=["row", "n_best", "count_sum", "pairs", "times"])

    looked = materialize(held.select("row", "pairs", "times").mapInArrow(
        look_up, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"), "looked")
    rest = looked.filter(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("t"))))
    rare = counts.filter(F.col("n") < least).withColumn("b", F.col("pair") % size_b).join(F.broadcast(highest), "b")
    rare = rare.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    rest = rest.join(rare, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("rare_best"), F.sum(F.col("n") * F.col("t")).alias("rare_sum"))
    sums = looked.select("row", "n_best", "count_sum").join(rest, "row", "left")
    out = held.drop("pairs", "times").join(sums, "row").withColumns({
        "n_best": F.col("n_best") + F.coalesce("rare_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))})
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *added)


def _pair_counts(held: DataFrame, most: int) -> DataFrame:
    """The number of links of every pair in all rows; each task adds up what it reads before it hands it on."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, size = [], [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            code, number = np.concatenate(codes), np.concatenate(numbers)
            order = np.argsort(code, kind="stable")
            code, number = code[order], number[order]
            new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            return code[new], np.add.reduceat(number, new)

        for batch in batches:
            codes.append(batch.column("pairs").flatten().to_numpy())
            numbers.append(batch.column("times").flatten().to_numpy().astype(np.int64))
            size += len(codes[-1])
            if size > most:
                code, number = added()
                codes, numbers, size = [code], [number], len(code)
                if size > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(number)], names=["pair", "n"])
                    codes, numbers, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], names=["pair", "n"])

    return held.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, size_b: int, most: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], int, DataFrame]:
    """The highest count of each B id; codes and counts of at most ``most`` pairs, those of at least a limit; that limit;
    the highest counts as a table. Only rows of the vocabulary and the bounded number of pairs come to the driver.
    """
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("highest")).toArrow()
    best = np.zeros(size_b, np.int64)
    best[highest.column("b").to_numpy()] = highest.column("highest").to_numpy()
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect(), reverse=True)
    total, least = 0, 1 << 62
    for row in sizes:
        total += row.c
        if total > most:
            break
        least = row.n
    sent = counts.filter(F.col("n") >= least).select("pair", "n").toArrow()
    codes, numbers = sent.column("pair").to_numpy(), sent.column("n").to_numpy()
    order = np.argsort(codes)
    return best, (codes[order], numbers[order]), least, counts.sparkSession.createDataFrame(highest)
