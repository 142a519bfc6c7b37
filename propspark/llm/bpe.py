"""Byte-level BPE: ranked merges folded over byte arrays of distinct words; texts are put together from their words.

A word under work is an array of token ids, so the least merged id is the lowest rank. Encoded words are strings with one
symbol for each token (the id, moved past the surrogates). The rank map of the vocabulary (pairs of tokens whose bytes
joined are a token) is one literal of a fixed size.

The most frequent words of the corpus are folded once, by Spark's higher-order functions, and sent to the workers; their
number is fixed. Each worker folds the other words by the same rank map when they first come up, those of about 1 MB of
texts at once, and remembers them: in higher-order functions that took too long (see the README). Neither texts nor
words are shuffled but for the counts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, ArrayType, IntegerType, LongType, StringType, BinaryType

from propspark.llm.quality import let
from propspark.llm.text import content, slices
from propspark.session import materialize

HOT_WORDS, HOT_BYTES = 1 << 18, 64
#: Other words and pieces of text that a worker remembers at most.
CACHED = 1 << 18
#: Words of up to so many bytes are folded together, so many at once (chunks are cut likewise); tokens of a long text that are spelled at once.
SHORT, FOLDED, SPELLED = 128, 1 << 14, 1 << 20
BUCKETS = 32_749  # a prime
BLANKS = r"\t-\r \x85\xa0  -     　"
#: The split pattern of the rank files (fixed value), its blanks written out.
SPLIT = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    .replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]"))
#: Blanks that the quick split does not handle: others than space and newline, two in a row (or at an end).
_OTHER_BLANK = re.compile(r"[\t\x0b-\r\x85\xa0  -     　]")
_DOUBLE = ("  ", " \n", "\n ", "\n\n")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file; the rank is the token's id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def symbol(token: int) -> str:
    return chr(token + 1) if token + 1 < 0xD800 else chr(token + 1 + 0x800)


def symbols(ids: np.ndarray) -> str:
    """A string with one symbol for each token id."""
    points = ids.astype("<u4") + np.uint32(1)
    return np.where(points < 0xD800, points, points + np.uint32(0x800)).astype("<u4").tobytes().decode("utf-32-le")


def token_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(points < 0xD800, points - 1, points - 0x801)


def mergeable(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """All pairs of tokens with a merged token. A pair with a part that has a higher rank than the whole cannot come up:
    the whole would have been merged before.
    """
    def possible(part: bytes, rank: int) -> bool:
        return part in ranks and (len(part) == 1 or ranks[part] < rank)

    for t, k in ranks.items():
        for i in range(1, len(t)):
            if possible(t[:i], k) and possible(t[i:], k):
                yield ranks[t[:i]], ranks[t[i:]], k


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal map from pairs of token ids to the merged id, as buckets of keys (``k``) and ids (``v``).

    It is written as JSON, which the optimizer folds into one literal; its size follows from the vocabulary alone.
    """
    keys: list[list[int]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    for a, b, k in mergeable(ranks):
        code = (a << 20) + b
        keys[code % BUCKETS].append(code)
        values[code % BUCKETS].append(k)
    return F.from_json(F.lit(json.dumps({"k": keys, "v": values}, separators=(",", ":"))), "k array<array<bigint>>, v array<array<int>>")


def first_tokens(ranks: dict[bytes, int], word: Column) -> Column:
    """One token for each byte of a word."""
    singles = F.lit([ranks[bytes([b])] for b in range(256)])
    return F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(singles, F.ascii(c)))


def fold_merges(tokens: Column, maps: Column) -> Column:
    """Merge the leftmost pair of the lowest rank until no pair has one.

    The state holds the tokens and, for each pair of neighbours, what it merges to; a merge looks up only the two
    pairs that it makes anew.
    """
    none = F.array().cast("array<int>")

    def merged(left: Column, right: Column) -> Column:
        code = left.cast("bigint") * (1 << 20) + right
        bucket = (code % BUCKETS).cast("int")
        return F.get(F.get(maps["v"], bucket), (F.array_position(F.get(maps["k"], bucket), code) - 1).cast("int"))

    def first(t: Column) -> Column:
        pairs = F.when(F.size(t) > 1, F.transform(
            F.sequence(F.lit(0), F.size(t) - 2), lambda i: merged(F.get(t, i), F.get(t, i + 1)))).otherwise(none)
        return F.struct(t.alias("t"), pairs.alias("m"))

    def step(state: Column) -> Column:
        t, m = state["t"], state["m"]

        def apply(new: Column) -> Column:
            def at(p: Column) -> Column:
                rest = F.size(t) - p - 1  # tokens after the pair
                before = F.when(p > 1, F.concat(F.slice(m, F.lit(1), p - 2), F.array(merged(F.get(t, p - 2), new)))).otherwise(none)
                after = F.when(rest > 0, F.concat(F.array(merged(new, F.get(t, p + 1))), F.slice(m, p + 2, rest))).otherwise(none)
                return F.struct(F.concat(F.slice(t, F.lit(1), p - 1), F.array(new), F.slice(t, p + 2, rest)).alias("t"),
                                F.concat(before, after).alias("m"))

            return F.when(new.isNull(), state).otherwise(let(F.array_position(m, new).cast("int"), at))

        return let(F.array_min(m), apply)

    return let(tokens, lambda t: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), first(t), lambda acc, _: step(acc), lambda acc: acc["t"]))


def plain_chunks(text: str) -> list[str] | None:
    """What stands between single blanks, from the second line on with the newline before a line's first; None where
    blanks stand otherwise.

    Between two other characters a space always begins a match and a newline is one, so the matches of such a text
    are those of its first chunk, of the other chunks with a space before them, and the newlines. The first chunk
    has a newline too that is not in the text.
    """
    if not text or text[0] in " \n" or text[-1] in " \n" or any(d in text for d in _DOUBLE) or _OTHER_BLANK.search(text):
        return None
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


def chunk_words(chunks: Iterable[str]) -> list[str]:
    """The matches of plain chunks one after the other, each chunk's first newline (one is added where it has none) before them."""
    return SPLIT.findall("".join([c if c[0] == "\n" else "\n " + c for c in chunks]))


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words (matches of the split pattern) of all texts and their numbers."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter[str] = Counter()
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            lines = sum(n for c, n in chunks.items() if c[0] == "\n")
            numbers, n = iter(chunks.values()), 0
            for some in batched(chunks, FOLDED):
                for w in chunk_words(some):
                    if w == "\n":
                        n = next(numbers)
                    else:
                        seen[w] += n
            seen["\n"] += lines
            chunks.clear()
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                between = []
                for body in some.column("text").to_pylist():
                    cut = plain_chunks(body)
                    if cut is None:
                        seen.update(SPLIT.findall(body))
                    else:
                        between += cut
                        seen["\n"] -= 1  # the one before the text
                chunks.update(between)
                if len(chunks) + len(seen) > CACHED:
                    yield flush()
        yield flush()

    rows = df.select(content(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, ranks: dict[bytes, int], maps: Column, text: str = "text", most: int = HOT_WORDS) -> dict[str, str]:
    """The symbols of at most ``most`` words, the most frequent ones of up to ``HOT_BYTES`` bytes."""
    counts = materialize(count_words(df, text), "words").filter(F.octet_length("word") <= HOT_BYTES)
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for lv, n in sizes:
        if total + n > most:
            break
        total, least = total + n, lv
    if least is None:
        return {}
    hot = counts.filter(level >= least).select("word", let(
        maps, lambda m: fold_merges(first_tokens(ranks, F.col("word")), m)).alias("ids")).toArrow()
    return dict(zip(hot.column("word").to_pylist(), _per_word(hot.column("ids").combine_chunks())))


def _per_word(ids: pa.ListArray) -> list[str]:
    """The symbols of each word from its ids."""
    every, at = symbols(ids.flatten().to_numpy()), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).tolist()
    return [every[a:b] for a, b in zip(at, at[1:])]


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = False, with_bytes: bool = False,
                     keep: Sequence[str] | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of the bytes that the ids
    decode to), with ``with_ids`` the ``ids`` and with ``with_bytes`` the ``decoded`` bytes to every row.

    ``vocabulary`` is a ``.tiktoken`` file with all 256 single bytes. Every text is split by the rank files' pattern and
    each match encoded separately, without special tokens. Null is the empty text: no ids. ``keep`` names the columns
    of ``df`` that come back (all). Rows are independent; repeated rows get equal results, an empty table an empty one, and a
    text is encoded whole, whatever its length (long words by a heap of merges).
    """
    spark, ranks = df.sparkSession, read_ranks(vocabulary)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_bytes
    keep = list(df.columns if keep is None else keep)
    if set(added) & set(keep):
        raise ValueError(f"columns already there: {sorted(set(added) & set(keep))}")
    maps = rank_map(ranks)
    hot = frequent_words(df, ranks, maps, text, hot_words)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, list(hot), list(hot.values())))

    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], content(F.col(f"`{text}`")).alias("text"))
    out = StructType([*(StructField(c, f.dataType) for c, f in zip(keep, rows.schema.fields)), StructField("n_tokens", LongType()),
                      StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
                      *([StructField("ids", ArrayType(IntegerType()))] if with_ids else []),
                      *([StructField("decoded", BinaryType())] if with_bytes else [])])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, vocabulary)
        for batch in batches:
            for a, b in _cuts(batch, 1 << 20):
                some = batch.slice(a, b - a)
                coder.trim()
                coded = coder.encode(some.column("text").to_pylist())
                counts = list(map(len, coded))
                ends = np.cumsum(counts, dtype=np.int64)
                ids = token_ids("".join(coded))
                ids_sha, text_sha, decoded = [], [], []
                for parts in coder.decimal.spell(ids, ends):
                    sha = hashlib.sha256()
                    for i, part in enumerate(parts):
                        sha.update(part if i else part[1:])
                    ids_sha.append(sha.hexdigest())
                for parts in coder.pieces.spell(ids, ends):
                    sha, held = hashlib.sha256(), []
                    for part in parts:
                        sha.update(part)
                        if with_bytes:
                            held.append(part.tobytes())
                    text_sha.append(sha.hexdigest())
                    decoded.append(b"".join(held))
                cols = [*(some.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    edges = np.concatenate([[0], ends]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))))
                if with_bytes:
                    cols.append(pa.array(decoded, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return rows.mapInArrow(encode, out)


class Spelling:
    """The bytes that stand for each token id."""

    def __init__(self, spelled: dict[int, bytes]):
        self.long = np.zeros(max(spelled) + 1, np.int32)
        self.long[list(spelled)] = list(map(len, spelled.values()))
        self.first = np.zeros(len(self.long), np.int32)
        self.first[list(spelled)] = np.cumsum([0, *map(len, spelled.values())])[:-1]
        self.flat = np.frombuffer(b"".join(spelled.values()), np.uint8)

    def write(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin (and the last one's end)."""
        long = self.long[ids]
        at = np.concatenate([[0], np.cumsum(long, dtype=np.int64)])
        # ids of about 1 MB of text or ``SPELLED`` ids: places fit 32 bits
        return self.flat[np.arange(at[-1], dtype=np.int32) + np.repeat(self.first[ids] - at[:-1].astype(np.int32), long)], at

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[Iterable[np.ndarray]]:
        """The bytes of each text, in parts where there is only one; ``ends`` are the texts' numbers of ids summed up."""
        if len(ends) == 1:
            yield (self.write(ids[a:a + SPELLED])[0] for a in range(0, len(ids), SPELLED))
            return
        raw, at = self.write(ids)
        edges = [0, *at[ends].tolist()]
        for a, b in zip(edges, edges[1:]):
            yield [raw[a:b]]


class Merges:
    """The rank map as an open-addressed table, for many pairs at once."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        codes, ids = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slot(codes)
        while len(codes):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = codes[free]
            put = self.keys[slot] == codes
            self.ids[slot[put]] = ids[put]
            codes, ids, slot = codes[~put], ids[~put], (slot[~put] + 1) & self.last

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, ``NONE`` where it does not."""
        codes = ((left.astype(np.int64) << 20) + right).ravel()
        slot = self._slot(codes)
        found = self.keys[slot]
        out = np.where(found == codes, self.ids[slot], self.NONE)
        going = np.flatnonzero((found != codes) & (found >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & self.last
            found = self.keys[slot[going]]
            hit = going[found == codes[going]]
            out[hit] = self.ids[slot[hit]]
            going = going[(found != codes[going]) & (found >= 0)]
        return out.reshape(left.shape)


class Coder:
    """Symbols of words: the frequent ones as sent, each other one folded when it first comes up."""

    def __init__(self, frequent: dict[str, str], ranks: dict[bytes, int]):
        self.frequent, self.most = frequent, len(frequent) + CACHED
        self.words, self.chunks = dict(frequent), {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(a << 20) + b: k for a, b, k in mergeable(ranks)}
        self.merges = Merges(self.pairs)
        self.pieces = Spelling({k: t for t, k in ranks.items()})
        self.decimal = Spelling({k: f",{k}".encode() for k in ranks.values()})
        self.newline = symbol(ranks[b"\n"])

    def trim(self) -> None:
        if len(self.words) > self.most:
            self.words = dict(self.frequent)
        if len(self.chunks) > CACHED:
            self.chunks.clear()

    def learn(self, words: Iterable[str]) -> None:
        """Fold the words that are not known."""
        new = list({w for w in words if w not in self.words})
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        for a in range(0, len(short), FOLDED):
            some = short[a:a + FOLDED]
            self.words.update(zip([new[i] for i in some], fold_many([raw[i] for i in some], self.single, self.merges)))
        for w, r in zip(new, raw):
            if len(r) > SHORT:
                tokens = self.single[np.frombuffer(r, np.uint8)].tolist()
                self.words[w] = "".join(map(symbol, fold_short(tokens, self.pairs) if len(tokens) < 200 else fold_long(tokens, self.pairs)))

    def encode(self, texts: Sequence[str]) -> list[str]:
        """The symbols of each text."""
        cut = [plain_chunks(t) for t in texts]
        every = list(chain.from_iterable(filter(None, cut)))
        coded = list(map(self.chunks.get, every))
        gaps = [i for i, made in enumerate(coded) if made is None]
        new = list({every[i] for i in gaps})
        words = chunk_words(new)
        others = [SPLIT.findall(t) if chunks is None else [] for t, chunks in zip(texts, cut)]
        self.learn(chain(words, *others))
        symbols_of = self.words.__getitem__
        # newlines stand only before chunks, and none of their symbols in a word without one
        for c, made in zip(new, "".join(map(symbols_of, words)).split(self.newline)[1:]):
            self.chunks[c] = self.newline + made if c[0] == "\n" else made
        for i in gaps:
            coded[i] = self.chunks[every[i]]
        out, a = [], 0
        for chunks, some in zip(cut, others):
            if chunks is None:
                out.append("".join(map(symbols_of, some)))
            else:
                b = a + len(chunks)
                out.append("".join(coded[a:b])[1:])
                a = b
        return out


def fold_many(words: Sequence[bytes], single: np.ndarray, merges: Merges) -> list[str]:
    """Symbols of words: the leftmost pair of the lowest rank is merged until no pair has one, in all words of as many
    tokens at once, beginning with the longest words.
    """
    long = np.array(list(map(len, words)))
    first, flat = np.cumsum(long) - long, single[np.frombuffer(b"".join(words), np.uint8)]
    by, number = np.argsort(long, kind="stable"), np.bincount(long)
    upto = np.cumsum(number)
    out = [""] * len(words)

    def put(which: np.ndarray, t: np.ndarray) -> None:
        every, n = symbols(t.ravel()), t.shape[1]
        for k, i in enumerate(which.tolist()):
            out[i] = every[k * n:(k + 1) * n]

    which = np.empty(0, np.int64)
    t, m = np.empty((0, len(number) - 1), np.int32), np.empty((0, len(number) - 2), np.int32)
    for n in range(len(number) - 1, 1, -1):
        if number[n]:
            more = by[upto[n] - number[n]:upto[n]]
            new = flat[first[more][:, None] + np.arange(n)]
            which, t, m = np.concatenate([which, more]), np.concatenate([t, new]), np.concatenate([m, merges.of(new[:, :-1], new[:, 1:])])
        rows = np.arange(len(which))
        p = m.argmin(axis=1)
        k = m[rows, p]
        done = k == merges.NONE
        if done.any():
            put(which[done], t[done])
            which, t, m, p, k = (x[~done] for x in (which, t, m, p, k))
            rows = np.arange(len(which))
        t[rows, p] = k
        keep = np.ones(t.shape, bool)
        keep[rows, p + 1] = False
        t = t[keep].reshape(len(which), n - 1)
        keep = np.ones(m.shape, bool)
        keep[rows, p] = False
        m = m[keep].reshape(len(which), n - 2)
        some = np.flatnonzero(p > 0)
        m[some, p[some] - 1] = merges.of(t[some, p[some] - 1], k[some])
        some = np.flatnonzero(p < n - 2)
        m[some, p[some]] = merges.of(k[some], t[some, p[some] + 1])
    put(which, t)
    if len(number) > 1 and number[1]:
        more = by[upto[1] - number[1]:upto[1]]
        put(more, flat[first[more]][:, None])
    return out


def fold_short(t: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until no pair has one."""
    none = 1 << 40
    m = [pairs.get((a << 20) + b, none) for a, b in zip(t, t[1:])]
    while m:
        new = min(m)
        if new == none:
            break
        p = m.index(new)
        t[p:p + 2] = [new]
        del m[p]
        if p:
            m[p - 1] = pairs.get((t[p - 1] << 20) + new, none)
        if p < len(m):
            m[p] = pairs.get((new << 20) + t[p + 1], none)
    return t


def fold_long(t: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges in the same order by a heap of (rank, place) over linked tokens."""
    n = len(t)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(k, i) for i in range(n - 1) if (k := pairs.get((t[i] << 20) + t[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        k, i = heapq.heappop(heap)
        j = after[i]
        if t[i] < 0 or j >= n or pairs.get((t[i] << 20) + t[j]) != k:
            continue  # one of the two was merged meanwhile
        t[i], t[j] = k, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (up := pairs.get((k << 20) + t[after[j]])) is not None:
                heapq.heappush(heap, (up, i))
        if before[i] >= 0 and (up := pairs.get((t[before[i]] << 20) + k)) is not None:
            heapq.heappush(heap, (up, before[i]))
    return [x for x in t if x >= 0]


_coders: dict[str, Coder] = {}


def _coder(shared: Broadcast, vocabulary: str) -> Coder:
    name, words, coded = shared.value
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(dict(zip(words, coded)), read_ranks(vocabulary))
    return _coders[name]


def _cuts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int]]:
    first = 0
    for part in slices(pa.RecordBatch.from_arrays([batch.column("text")], names=["text"]), "text", most):
        yield first, first + part.num_rows
        first += part.num_rows
