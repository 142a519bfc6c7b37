"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def find_items(docs, items, window=10):
    """(n_words, n_hit, item ids) for each text."""
    grams = {}
    for name, text in items:
        words = WORD.findall(lower(text))
        if name is None or not words:
            continue
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            grams.setdefault(tuple(words[i:i + size]), set()).add(str(name))
    sizes = sorted({len(g) for g in grams})
    out = []
    for text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for i in range(len(words)):
            for size in sizes:
                g = tuple(words[i:i + size])
                if len(g) == size and g in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out.append((len(words), len(hit), sorted(found)))
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def crc_ids(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
