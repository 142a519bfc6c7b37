"""Token ids as flat binary files with 64-bit document offsets.

A data set is a folder of parts in ascending key order. Part files hold

* ``.bin``: ids of all its documents one after another, unsigned little-endian, 16 bits if the vocabulary allows, else 32;
* ``.off``: for each document the number of ids before it in this part, and at last their total, unsigned 64 bits;
* ``.key``: the documents' keys, signed 64 bits (0 for null), and ``.nul``: one byte for each, 1 for a null key.

The manifest (a small table) names the files of each part and its base: the number of ids in all parts before it.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from propspark.llm.store import make_dir, mapped, open_output, qualified
from propspark.llm.text import content, slices, whole
from propspark.session import materialize, new_path

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, width int"
#: Entries that a worker remembers at most: pieces between blanks, and matches inside them (the costly ones).
CACHED_PIECES, CACHED_MATCHES = 800_000, 1_000_000


def _drops_blanks(tokenizer) -> bool:
    """Whether ids of a text are the ids of its blank-separated pieces in a row.

    True when the tokenizer's first split removes everything outside matches and no match can hold a blank, and the
    normalizer works character by character or (NFC) never joins across a blank.
    """
    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers") or [pre]
    first = steps[0]
    norm = spec["normalizer"] or {}
    kinds = {n["type"] for n in norm.get("normalizers") or [norm] if n}
    pattern = first.get("pattern", {}).get("Regex", "")
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and pattern == _MATCHES and kinds == {"NFC", "Replace", "Lowercase"} and spec["post_processor"] is None
            and spec["model"]["type"] == "BPE"
            and [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"]))


#: Characters on which normalising, classes and lower case are the same everywhere (no marks, no blanks).
_PLAIN = regex.compile(r"[!-~\u00A1-\u00AC\u00AE-\u024F]+")
#: The matches kept by the tokenizer's first split (fixed value).
_MATCHES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MATCH = regex.compile(_MATCHES)


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable Latin-1 characters stand for their byte, the others are numbered from 256 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Matches(dict):
    """Ids of the matches inside pieces, each encoded when it first comes up."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.tokenize, self.code, self.letters = encoder.model.model.tokenize, encoder.code, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
        return ids


class _Pieces(dict):
    """Ids of the pieces between blanks: match by match for plain characters, else by the whole tokenizer."""

    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.whole, self.matches = encoder.whole, encoder.matches
        # an added token in a piece is not split into matches
        self.marks = "".join({t.content[0] for t in encoder.model.get_added_tokens_decoder().values()})

    def __missing__(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece) and not any(m in piece for m in self.marks):
            low, of = piece.lower(), self.matches
            if low.isalpha():
                ids = of[low]
            elif low[-1] in ".," and low[:-1].isalpha():
                ids = of[low[:-1]] + of[low[-1]]
            else:
                ids = b"".join(map(of.__getitem__, _MATCH.findall(low)))
        else:
            ids = self.whole(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts. Where a blank always ends a token, each piece between blanks is encoded once and remembered."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.dtype = np.dtype("<u2" if max(self.model.get_vocab_size(True) - 1, end_id or 0) < 2**16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.by_piece = _drops_blanks(self.model)
        self.matches = _Matches(self)
        self.pieces = _Pieces(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.by_piece:
            return [np.array(e.ids, self.dtype).tobytes() + self.end
                    for e in self.model.encode_batch_fast(list(texts), add_special_tokens=False)]
        if len(self.matches) > CACHED_MATCHES:
            self.matches.clear()
        if len(self.pieces) > CACHED_PIECES:
            self.pieces = _Pieces(self)
        of = self.pieces.__getitem__
        return [b"".join(map(of, t.replace("\n", " ").split(" "))) + self.end for t in texts]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def write_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2,
                 path: str | None = None) -> DataFrame:
    """Encode every text and write the data set; returns its manifest (part, path, n_docs, n_tokens, width, base).

    Documents go to the parts by ranges of (key, text hash), sorted, so the whole set is in ascending key order (null
    first). Each task writes files under a name of its own and reports them; only the files of the attempt
    that Spark commits are in the manifest, so a lost executor leaves unnamed files at worst. Null texts are empty:
    such a document has the end id only. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    folder = qualified(spark, path or new_path(spark, "tokens"))
    make_dir(folder)
    rows = whole(df, key, text).select(F.col(f"`{key}`").cast("bigint").alias("key"), content(F.col(f"`{text}`")).alias("text"))
    order = ("key", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        width, part = encoder.dtype.itemsize, TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        total, docs, files = 0, 0, None
        for batch in batches:
            for some in slices(batch, "text", 1 << 19):
                if files is None:
                    files = {x: open_output(f"{name}.{x}") for x in ("bin", "off", "key", "nul")}
                ids = encoder.encode(some.column("text").to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
                files["bin"].write(b"".join(ids))
                files["off"].write((total + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                keys = some.column("key")
                files["key"].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                files["nul"].write(keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                total, docs = total + int(sizes.sum()), docs + len(ids)
        if files is None:
            return
        files["off"].write(np.array([total], "<u8").tobytes())
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [docs], "n_tokens": [total],
             "width": pa.array([width], pa.int32())})

    parts = materialize(rows.mapInArrow(write, MANIFEST), "manifest")
    # one row for each part: the bases are prefix sums over a table as short as the list of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of a written data set: key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``
    (of the ids as unsigned 32-bit little-endian numbers), and with ``with_ids`` the ids themselves.
    """
    out = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, dtype = row["path"], "<u2" if row["width"] == 2 else "<u4"
                ids, off = mapped(f"{name}.bin", dtype), mapped(f"{name}.off", "<u8")[:].astype(np.int64)
                keys, nul = mapped(f"{name}.key", "<i8"), mapped(f"{name}.nul", "u1")
                step = 4096 if not with_ids else 256
                for i in range(0, row["n_docs"], step):
                    j = min(i + step, row["n_docs"])
                    each = [np.asarray(ids[a:b]).astype("<u4") for a, b in zip(off[i:j], off[i + 1:j + 1])]
                    cols = [pa.array(np.asarray(keys[i:j]), pa.int64(), mask=np.asarray(nul[i:j], bool)),
                            pa.array(row["base"] + off[i:j], pa.int64()), pa.array(np.diff(off[i:j + 1]), pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    names = [key, "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    files = manifest.select("path", "n_docs", "width", "base")
    parts = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return files.repartition(int(parts)).mapInArrow(read, out)
