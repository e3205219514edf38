"""Packed columns: many small rows as one compressed value, and sorted runs within them."""

from __future__ import annotations

import numpy as np


def squeeze(*columns: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(columns), *(len(c) * c.itemsize for c in columns)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in columns))


def loosen(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, place = [], 8 * (n + 1)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, place))
        place += size
    return out


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of neighbouring keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def slices(at: np.ndarray, n: int, most: int):
    """Whole runs (that begin at ``at``) together, most rows at a time or one run."""
    edges, s = np.append(at, n), 0
    while s < n:
        k = int(np.searchsorted(edges, s + most, "right")) - 1
        e = int(edges[k]) if edges[k] > s else int(edges[k + 1])
        yield s, e
        s = e


def dealt(key: np.ndarray):
    """(key, its rows) for each key, rows in order."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    at = runs_of(key[order])
    for s, e in zip(at, np.append(at[1:], len(key)), strict=True):
        yield int(key[order[s]]), order[s:e]


def by_document(doc: np.ndarray, tag: np.ndarray, *rest: np.ndarray) -> bytes:
    """A blob of rows that come by document: each document once, with its number of rows."""
    at = runs_of(doc, tag)
    count = np.diff(np.append(at, len(doc))).astype(np.uint32)
    return squeeze(np.diff(doc[at], prepend=0), tag[at], count, *rest)


def documents_of(blobs, *kinds) -> list[np.ndarray]:
    """The columns of blobs that by_document() made, one after the other."""
    parts = []
    for blob in blobs:
        steps, tag, count, *rest = loosen(blob, np.int64, np.uint32, np.uint32, *kinds)
        parts.append((np.repeat(np.cumsum(steps), count), np.repeat(tag, count), *rest))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]
