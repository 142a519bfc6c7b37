"""Benchmark decontamination by a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from propspark.llm.text import slices, utf8, whole, word_hashes, word_spans

#: Lower case for A-Z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of words after lower-casing: digits, a-z and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

WINDOW = 10
#: Item words in one automaton; more items make more automata, each passed over all documents.
BLOCK_WORDS = 200_000
_BITS = 20


class Automaton:
    """Suffix automaton of many word sequences, with the items of every state."""

    def __init__(self, items: Sequence[tuple[str, Sequence[str]]], window: int):
        self.window = window
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        own: list[set[int]] = [set()]
        short: list[tuple[int, int]] = []  # (state of the whole item, item) of items shorter than a window
        self.items = [name for name, _ in items]
        for number, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)), own)
                own[last].add(number)
            if words and len(words) < window:
                short.append((last, number))
                self.shortest = min(self.shortest, len(words))
        # an item ends wherever one of its longer matches ends: pass the items on along the suffix links
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            own[self.link[state]] |= own[state]
        # the state that holds the last `window` words of a match, and the items in it
        self.full: list[frozenset[int]] = [frozenset()] * len(self.next)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        ends: dict[int, list[int]] = {}
        for state, number in short:
            ends.setdefault(state, []).append(number)
        sizes = {number: len(words) for number, (_, words) in enumerate(items)}
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.full[state] = frozenset(own[state]) if self.length[up] < window else self.full[up]
            self.short[state] = self.short[up] + tuple((sizes[i], i) for i in ends.get(state, ()))

    def _extend(self, last: int, w: int, own: list[set[int]]) -> int:
        """The state of the sequence read so far with ``w`` after it."""
        to = self.next[last].get(w)
        if to is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._clone(last, w, to, own)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        own.append(set())
        while last != -1 and w not in self.next[last]:
            self.next[last][w] = state
            last = self.link[last]
        if last != -1:
            to = self.next[last][w]
            self.link[state] = to if self.length[to] == self.length[last] + 1 else self._clone(last, w, to, own)
        return state

    def _clone(self, last: int, w: int, to: int, own: list[set[int]]) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[to]))
        self.link.append(self.link[to])
        self.length.append(self.length[last] + 1)
        own.append(set())
        self.link[to] = copy
        while last != -1 and self.next[last].get(w) == to:
            self.next[last][w] = copy
            last = self.link[last]
        return copy

    def run(self, words: Sequence[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words covered by occurring windows (first, after last) and the items of these windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state, length = 0, 0
        for at, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                state, length = 0, 0
                continue
            state, length = to, length + 1
            size = 0
            if length >= self.window:
                size = self.window
                found |= self.full[state]
            for n, item in self.short[state]:
                if n <= length:
                    found.add(item)
                    size = max(size, n)
            if size:
                first = at + 1 - size
                if spans and first <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], first), at + 1)
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        begin, end = spans.pop()
                        spans[-1] = (min(spans[-1][0], begin), max(spans[-1][1], end))
                else:
                    spans.append((first, at + 1))
        return spans, found


def item_words(text: str | None) -> list[str]:
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    first, end, _ = word_spans(raw, np.array([0, len(raw)]), WORD)
    data = raw.tobytes()
    return [data[a:b].decode() for a, b in zip(first, end)]


class _Filter:
    """The automaton and a bit table of its words' hashes, made once per worker."""

    def __init__(self, items: Sequence[tuple[str, list[str]]], window: int):
        self.automaton = Automaton(items, window)
        words = list(self.automaton.words)
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        if words:
            first = np.concatenate([[0], ends[:-1]])
            self.bits[(word_hashes(raw, first, ends) >> np.uint64(64 - _BITS)).astype(np.int64)] = True


_made: dict[str, _Filter] = {}


def _filter(shared: Broadcast, window: int) -> _Filter:
    name, items = shared.value
    if name not in _made:
        _made.clear()
        _made[name] = _Filter(items, window)
    return _made[name]


def _scan(some: pa.RecordBatch, name: str, f: _Filter) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each row with a hit: words, byte spans (first, end) and items; rows without one give their words only.

    Words the items lack send the automaton back to its root, so only runs of known words are streamed through it.
    """
    raw, at = utf8(some.column(name))
    raw = LOWER[raw]
    first, end, row = word_spans(raw, at, WORD)
    counts = np.bincount(row, minlength=some.num_rows)
    known = f.bits[(word_hashes(raw, first, end) >> np.uint64(64 - _BITS)).astype(np.int64)]
    # runs of known words inside one row
    start = known & ~np.concatenate([[False], known[:-1] & (row[1:] == row[:-1])]) if len(known) else known
    run_first = np.flatnonzero(start)
    stop = known & ~np.concatenate([known[1:] & (row[1:] == row[:-1]), [False]]) if len(known) else known
    run_end = np.flatnonzero(stop) + 1
    long = run_end - run_first >= f.automaton.shortest
    hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    data, vocabulary = raw.tobytes(), f.automaton.words
    for a, b in zip(run_first[long].tolist(), run_end[long].tolist()):
        ids = [vocabulary.get(data[x:y].decode(), -1) for x, y in zip(first[a:b].tolist(), end[a:b].tolist())]
        spans, found = f.automaton.run(ids)
        if spans:
            own = hits.setdefault(int(row[a]), ([], set()))
            own[0].extend((a + x, a + y) for x, y in spans)
            own[1].update(f.automaton.items[i] for i in found)
    for i in range(some.num_rows):
        spans, found = hits.get(i, ([], set()))
        yield int(counts[i]), [(int(first[x] - at[i]), int(end[y - 1] - at[i]), y - x) for x, y in spans], found


SPANS = "array<struct<first:int,stop:int,words:int>>"


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Items (as strings) with their words, in blocks of bounded size; one row of the table at a time."""
    block, size = [], 0
    rows = whole(benchmark, item, text).select(F.col(item).cast("string"), F.col(text).cast("string")).distinct()
    for name, body in rows.orderBy(F.col(item).cast("string"), text).toLocalIterator():
        words = item_words(body)
        if name is None or not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
               window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_hit`` (words inside occurrences of a window), ``items`` (sorted ids as strings) and
    ``spans`` (byte ranges of the hit runs of words in the text's UTF-8 and their words) to every row of ``docs``.

    Words are runs of digits, a-z and characters beyond ASCII after lower-casing A-Z. A window is ``window``
    consecutive words of an item; an item of fewer, but not none, is one window. The items come to the driver one block
    of ``block_words`` words at a time (an item longer than that is a block alone), and every block is sent to
    the workers as an automaton's input: what is broadcast has a fixed bound, and a larger benchmark means more
    passes. Null texts have no words; items with a null id or no words have no windows; several rows of one id
    count as one item. Repeated documents all stay; empty tables on either side are
    allowed, and long texts are read whole. ``keep`` names the columns of ``docs`` that are wanted back (all).
    """
    clash = {"n_words", "n_hit", "items", "spans"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    names, out, number = list(docs.columns), docs, 0
    blocks = _blocks(benchmark, item, item_text, block_words)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        out = _pass(out, names, names if keep is None or after else list(keep), text, block, window, number > 0)
        if after is None:
            return out
        block, number = after, number + 1


def _pass(df: DataFrame, names: list[str], keep: list[str], text: str, block: list, window: int, later: bool) -> DataFrame:
    """One automaton over all rows; ``later`` if columns of earlier passes follow those of the table."""
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))
    places = [names.index(c) for c in keep]
    fields = "n_words bigint, n_hit bigint, items array<string>, spans " + SPANS
    schema = StructType([df.schema.fields[i] for i in places] + StructType.fromDDL(fields).fields)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _filter(shared, window)
        for batch in batches:
            where = names.index(text)
            for some in _by_bytes(batch, where):
                n_words, n_hit, items, spans = [], [], [], []
                earlier = _earlier(some, len(names)) if later else None
                for i, (n, hit, found) in enumerate(_scan(some.select([where]), some.schema.names[where], f)):
                    if earlier:
                        hit, found = _merge(hit + earlier[1][i], some, where, i), found | set(earlier[0][i])
                    n_words.append(n)
                    n_hit.append(sum(x[2] for x in hit))
                    items.append(sorted(found))
                    spans.append([{"first": a, "stop": b, "words": w} for a, b, w in hit])
                kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(i) for i in places], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)],
                    names=[f.name for f in schema.fields])

    return df.mapInArrow(scan, schema)


def _by_bytes(batch: pa.RecordBatch, where: int) -> Iterator[pa.RecordBatch]:
    bare = pa.RecordBatch.from_arrays([batch.column(where)], names=["text"])
    first = 0
    for part in slices(bare, "text", 2 << 20):
        yield batch.slice(first, part.num_rows)
        first += part.num_rows


def _earlier(some: pa.RecordBatch, n: int) -> tuple[list[list[str]], list[list[tuple[int, int, int]]]]:
    spans = [[(s["first"], s["stop"], s["words"]) for s in row] for row in some.column(n + 3).to_pylist()]
    return some.column(n + 2).to_pylist(), spans


def _merge(spans: list[tuple[int, int, int]], some: pa.RecordBatch, where: int, i: int) -> list[tuple[int, int, int]]:
    """Union of byte spans of several passes, with the words counted anew."""
    joined: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    data = (some.column(where)[i].as_py() or "").encode()
    return [(a, b, len(item_words(data[a:b].decode()))) for a, b in joined]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Remove the hit spans from the texts and the documents in which they cover more than ``max_share`` of the words.

    The columns of ``docs`` come back, with ``text`` shortened and ``n_chars`` (if there) counted anew. A document of
    which nothing but blanks is left goes too if it had hits; documents without hits stay untouched, null texts too.
    """
    found = find_items(docs, benchmark, text, window=window, block_words=block_words)
    found = found.filter(F.col("n_hit") <= F.col("n_words") * max_share)
    names = list(docs.columns)
    raw = F.encode(F.col(f"`{text}`"), "UTF-8")
    # keep what lies between the spans: from the end of one to the start of the next
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"]))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.octet_length(F.col(f"`{text}`"))))
    pieces = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
    cut = F.when(F.col("n_hit") > 0, F.array_join(pieces, "")).otherwise(F.col(f"`{text}`"))
    out = found.withColumn(text, cut).filter((F.col("n_hit") == 0) | (F.trim(F.col(f"`{text}`")) != ""))
    if "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint"):
        kind = docs.schema["n_chars"].dataType.simpleString()
        out = out.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names])


#: The counts of ``op10`` as SQL: windows of items and documents meet as lists of words.
FIND_SQL = r"""
WITH text_words AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, doc_id, text FROM documents UNION ALL SELECT 'i', item_id::VARCHAR, NULL, text FROM benchmark
), words AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM text_words
), item_windows AS (
  SELECT DISTINCT id, s, w[i:i + s - 1] AS g
  FROM (SELECT id, w, least(10, len(w)) AS s, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM words WHERE side = 'i' AND len(w) > 0)
), sizes AS (SELECT DISTINCT s FROM item_windows),
found AS (
  SELECT d.doc_id, d.i, d.s, v.id
  FROM (SELECT doc_id, s, i, w[i:i + s - 1] AS g FROM (
    SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, sizes WHERE side = 'd' AND len(w) >= s)) d
  JOIN item_windows v ON v.g = d.g AND v.s = d.s
), hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN items t ON t.doc_id = w.doc_id WHERE w.side = 'd'
"""
