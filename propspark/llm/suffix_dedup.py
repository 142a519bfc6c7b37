"""Exact substring dedup: two-stage suffix sorting of the places where long strings may repeat.

Every string of ``LENGTH`` bytes is anchored at its least short-gram hash, so equal strings have equal anchors at equal
offsets. Starts with one anchor (and about one offset) form a segment, keyed by the hash of the bytes that all its
strings share. Only segments whose key occurs twice are sent on, equal ones as one row; the different segments of one key
meet in one task, where their suffixes are sorted and adjacent common prefixes tell which strings occur twice. What is
found goes back to every place of a segment by its digest. A key with very many
different segments is split into keys of longer shared strings until its groups are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propspark.llm.text import _powers, content, digest, free_shuffles, mix, slices, utf8
from propspark.session import materialize

LENGTH = 400
GRAM = 32
#: Bytes of text looked at in one step, and of segments sorted together.
PIECE, SORTED = 1 << 20, 1 << 20
#: Different segments of one key above which the key is split.
CROWDED = 4000


class Anchors:
    """Anchored runs of starts in a stretch of bytes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.window = length - self.gram + 1
        self.span = (self.window + 1) // 2

    def runs(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First start, number of starts, place of the anchor and key of each run; ``raw`` is one text or part of it."""
        n = len(raw) - self.length + 1
        if n <= 0:
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0, np.uint64)
        power, back = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        grams = len(raw) - self.gram + 1
        place = np.uint64((1 << 22) - 1)
        least = mix((sums[self.gram:] - sums[:grams]) * back[:grams])
        least = (least & ~place) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= self.window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < self.window:
            least = np.minimum(least[:n], least[self.window - width:self.window - width + n])
        at = (least[:n] & place).astype(np.int64)
        kind = (at - np.arange(n)) // self.span
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])]))
        count = np.diff(np.append(first, n))
        at, kind = at[first], kind[first]
        return first, count, at, self.key(sums, back, at, kind, self.span)

    def key(self, sums: np.ndarray, back: np.ndarray, at: np.ndarray, kind: np.ndarray, span: int) -> np.ndarray:
        """Hash of the bytes in all strings that begin ``kind * span`` to ``(kind + 1) * span - 1`` before the anchor."""
        a = at - kind * span
        b = a + self.length + 1 - span
        shared = mix((sums[b] - sums[a]) * back[a])
        return mix(shared ^ (kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(span)))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, first byte and bytes of every stretch of the texts; long texts are cut with an overlap of one string."""
    raw, at = utf8(column)
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for base in range(0, max(b - a - length + 1, 0), PIECE):
            yield row, base, raw[a + base:min(b, a + base + PIECE + length - 1)]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (bytes, 0 only at the end of segments, last byte 0) in the order of their first ``depth`` bytes.

    Suffixes smaller than their successor are sorted directly. The others are put in place by one scan over the
    buckets of first bytes: the suffix before a placed one goes to the next free place at the head of its bucket.
    """
    n = len(t)
    # a suffix is smaller than its successor if its run of equal bytes is followed by a larger one
    change = np.flatnonzero(t[1:] != t[:-1])
    rises = t[change + 1] > t[change]
    following = np.searchsorted(change, np.arange(n))
    small = np.ones(n, bool)
    inside = following < len(change)
    small[inside] = rises[following[inside]]
    data = t.tobytes()
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: data[i:i + depth])
    direct = np.array(direct, np.int64)
    counts = np.bincount(t, minlength=256)
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])
    end = head + counts
    small_counts = np.bincount(t[direct], minlength=256)
    order = np.empty(n, np.int64)
    tail = end - small_counts
    done = 0
    for c in np.flatnonzero(small_counts).tolist():
        order[tail[c]:end[c]] = direct[done:done + small_counts[c]]
        done += small_counts[c]
    fill = head.copy()

    def induce(placed: np.ndarray, least: int) -> None:
        before = placed[placed > 0] - 1
        before = before[t[before] >= least]
        if not len(before):
            return
        letters = t[before]
        by = np.argsort(letters, kind="stable")
        letters, before = letters[by], before[by]
        number = np.bincount(letters, minlength=256)
        starts = np.concatenate([[0], np.cumsum(number)[:-1]])
        order[fill[letters] + np.arange(len(letters)) - starts[letters]] = before
        fill[:] += number

    for c in np.flatnonzero(counts).tolist():
        seen = int(head[c])
        while seen < fill[c]:
            upto = int(fill[c])
            induce(order[seen:upto], c)
            seen = upto
        induce(order[tail[c]:end[c]], c + 1)
    return order


def adjacent_repeats(t: np.ndarray, order: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """For each position whether it is valid and shares ``length`` bytes with a valid neighbour in suffix order."""
    kept = order[valid[order]]
    out = np.zeros(len(t), bool)
    if len(kept) < 2:
        return out
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.ndarray(len(t) + 1, "<u8", padded.tobytes(), strides=(1,))
    left, right = kept[:-1], kept[1:]
    for offset in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        same = words[left + offset] == words[right + offset]
        left, right = left[same], right[same]
    if length < 8:
        for offset in range(length):
            same = t[left + offset] == t[right + offset]
            left, right = left[same], right[same]
    out[left] = out[right] = True
    return out


def repeated_starts(segments: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each distinct segment, which of its starts begin a string that occurs twice in all of them.

    A segment of weight two or more occurs twice itself.
    """
    sizes = np.array([len(s) for s in segments])
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).copy()
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(len(t), bool)
    body[ends] = False
    t[body] += 1  # UTF-8 has no byte 255; 0 is left to the ends
    starts = ends - sizes
    valid = np.zeros(len(t) + 1, np.int64)
    np.add.at(valid, starts, 1)
    np.add.at(valid, np.maximum(ends - length + 1, starts), -1)
    valid = np.cumsum(valid[:-1]) > 0
    hit = adjacent_repeats(t, suffix_order(t, length), valid, length)
    return [np.ones(max(n - length + 1, 0), bool) if w > 1 else hit[a:a + max(n - length + 1, 0)]
            for a, n, w in zip(starts.tolist(), sizes.tolist(), weights)]


SEGMENT = "key bigint, hi bigint, lo bigint, start bigint, copies bigint, anchor int, kind int, span int, seg binary, seg_hash bigint, seg_more bigint"


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _hash(data: bytes) -> tuple[int, int]:
    both = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _keys(rows: DataFrame, anchors: Anchors) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                row, keys = [], []
                for i, _, raw in _pieces(some.column("text"), anchors.length):
                    k = anchors.runs(raw)[3]
                    keys.append(k)
                    row.append(np.full(len(k), i))
                at = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
                found = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column("hi").take(at), some.column("lo").take(at), pa.array(found)], names=["hi", "lo", "key"])

    return rows.mapInArrow(find, "hi bigint, lo bigint, key bigint")


def _segments(bodies: DataFrame, anchors: Anchors) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                wanted = [np.array(k, np.int64).view(np.uint64) for k in some.column("keys").to_pylist()]
                hi, lo, copies = (some.column(c).to_pylist() for c in ("hi", "lo", "copies"))
                rows = []
                for i, base, raw in _pieces(some.column("text"), anchors.length):
                    first, count, at, key = anchors.runs(raw)
                    take = np.isin(key, wanted[i])
                    kind = (at - first) // anchors.span
                    for a, n, p, c, k in zip(first[take].tolist(), count[take].tolist(), at[take].tolist(),
                                             kind[take].tolist(), key[take].view(np.int64).tolist()):
                        seg = raw[a:a + n + anchors.length - 1].tobytes()
                        rows.append((k, hi[i], lo[i], base + a, copies[i], p - a, c, anchors.span, seg, *_hash(seg)))
                    if len(rows) > 4000:
                        yield _segment_batch(rows)
                        rows = []
                yield _segment_batch(rows)

    return bodies.select("hi", "lo", "copies", "keys", "text").mapInArrow(cut, SEGMENT)


def _halve(crowded: DataFrame, anchors: Anchors) -> DataFrame:
    """Segments cut in two, each under a key of more shared bytes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = np.frombuffer(r["seg"], np.uint8)
                power, back = _powers(len(raw) + 1)
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
                span = (r["span"] + 1) // 2
                start = np.arange(len(raw) - anchors.length + 1)
                kind = (r["anchor"] - start) // span
                first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(start)]):
                    c = kind[a:a + 1]
                    key = anchors.key(sums, back, np.array([r["anchor"]]), c, span)
                    seg = r["seg"][a:b + anchors.length - 1]
                    rows.append((int(key.view(np.int64)[0]), r["hi"], r["lo"], r["start"] + a, r["copies"], r["anchor"] - a,
                                 int(c[0]), span, seg, *_hash(seg)))
            yield _segment_batch(rows)

    return crowded.mapInArrow(cut, SEGMENT)


SAME = ["key", "seg_hash", "seg_more"]


def _hits(segments: DataFrame, length: int) -> DataFrame:
    """Ranges (``a``, ``b``) of starts of repeated strings in each different segment of a key, however often it occurs."""
    each = segments.groupBy(*SAME).agg(F.sum("copies").alias("copies"), F.first("seg").alias("seg"))
    placed = each.repartition("key").sortWithinPartitions("key")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for each segment the sum of its copies and the rows that have it (one for each of its keys)
        held: dict[bytes, tuple[int, list[tuple[int, int, int]]]] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            segs = list(held)
            # a lone segment of weight one can only repeat inside itself, as any other
            found = repeated_starts(segs, [held[s][0] for s in segs], length) if segs else []
            rows = []
            for seg, hit in zip(segs, found):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    rows += [(*one, a, b) for one in held[seg][1]]
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*SAME, "a", "b"])

        for batch in batches:
            same = list(zip(*(batch.column(c).to_pylist() for c in SAME)))
            copies, seg = (batch.column(c).to_pylist() for c in ("copies", "seg"))
            for i, one in enumerate(same):
                if one[0] != last and size > SORTED:
                    yield flush()
                    held, size = {}, 0
                last = one[0]
                weight, rows = held.get(seg[i], (0, []))
                if not rows:
                    size += len(seg[i]) + 1
                held[seg[i]] = weight + copies[i], [*rows, one]
        yield flush()

    return placed.mapInArrow(work, "key bigint, seg_hash bigint, seg_more bigint, a bigint, b bigint")


def _sort(segments: DataFrame, length: int) -> DataFrame:
    """Byte ranges (first, stop) of repeated strings in each text."""
    found = segments.select(*SAME, "hi", "lo", "start").join(_hits(segments, length), SAME)
    return found.select("hi", "lo", (F.col("start") + F.col("a")).alias("first"),
                        (F.col("start") + F.col("b") - 1 + length).alias("stop"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """For each text digest (``hi``, ``lo``) its ``spans``: all byte ranges of strings of ``length`` bytes that start
    anywhere else too, joined where they overlap or touch in the order of their starts.

    ``rows`` has ``hi``, ``lo`` and ``text`` for every document.
    """
    spark, anchors = rows.sparkSession, Anchors(length)
    keys = materialize(_keys(rows, anchors), "keys")
    twice = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    wanted = keys.join(twice, "key", "left_semi").groupBy("hi", "lo").agg(F.collect_set("key").alias("keys"))
    bodies = rows.groupBy("hi", "lo").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    segments = materialize(_segments(bodies.join(wanted, ["hi", "lo"]), anchors), "segments")
    free_shuffles(spark)
    done, span = [], anchors.span
    while True:
        if span > 1:
            many = segments.select("key", "seg_hash").distinct().groupBy("key").agg(
                F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("key")
            many = materialize(many, "crowded")
        if span <= 1 or not many.take(1):
            done.append(segments)
            break
        done.append(segments.join(many, "key", "left_anti"))
        halves = materialize(_halve(segments.join(many, "key", "left_semi"), anchors), "halves")
        still = halves.groupBy("key").agg(F.sum("copies").alias("n")).filter("n > 1").select("key")
        segments = materialize(halves.join(still, "key", "left_semi"), "segments")
        span = (span + 1) // 2
    found = None
    for part in done:
        spans = _sort(part, length)
        found = spans if found is None else found.union(spans)
    return found.groupBy("hi", "lo").agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("spans"))


def join_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["first"], s["stop"]])
    return [(a, b) for a, b in out]


def remove_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, crowded: int = CROWDED,
                   keep: list[str] | None = None, with_bytes: bool = False) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` to every row (``kept`` bytes with ``with_bytes``).

    Removed is each byte of a text's UTF-8 covered by a string of ``length`` bytes that starts anywhere else
    too, in the same text (overlaps count) or another row; all copies go, judged on the input. What is left may cut a
    character, so it is given as bytes. Null is the empty text. Repeated rows are copies of each other. Long texts
    are cut into stretches that overlap by a string; an empty table gives an empty result. ``keep`` names
    the columns of ``df`` that come back.
    """
    keep = list(df.columns if keep is None else keep)
    clash = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"} & set(keep)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], content(F.col(f"`{text}`")).alias("text"))
    rows = rows.withColumn("d", digest(F.col("text")))
    rows = rows.select(*names, F.col("d.hi").alias("hi"), F.col("d.lo").alias("lo"), "text")
    spans = materialize(repeated_spans(rows.select("hi", "lo", "text"), length, crowded), "spans")
    free_shuffles(df.sparkSession)
    joined = rows.join(spans, ["hi", "lo"], "left").select(*names, "text", "spans")
    schema = joined.select(*names).schema
    for f, c in zip(schema.fields, keep):
        f.name = c
    schema.names = keep
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_bytes:
        schema = schema.add("kept", "binary")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            data = raw.tobytes()
            removed, number, sha, left = [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                joined = join_spans(spans)
                own = data[at[i]:at[i + 1]]
                edges = [0, *(x for s in joined for x in s), len(own)]
                kept = b"".join(own[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                removed.append(sum(b - a for a, b in joined))
                number.append(len(joined))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            cols = [*(batch.column(n) for n in names), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(number, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left, pa.binary())] if with_bytes else cols, names=schema.names)

    return joined.mapInArrow(cut, schema)
