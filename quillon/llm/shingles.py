"""Hashed word shingles of whole texts, in blocks of Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words kept with their hashes in a worker, at most; then the memory starts anew.
CACHE = 250_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text; a longer text stands alone."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int, known: WordHashes) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its k-word shingles.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer
    than k words is one shingle; a null text or one without words has none.
    """
    words = [t.encode().lower().split() if t else [] for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    total = int(size.sum())
    flat = np.fromiter((h for w in words for h in map(known.__getitem__, w)), np.uint64, total)
    first = np.cumsum(size) - size
    grams = np.zeros(max(0, total - k + 1), np.uint64)
    for j in range(k):
        grams += mixed(flat[j : j + len(grams)] + _ODD[j % 8] * np.uint64(j // 8 + 1)) * _ODD[(j + 3) % 8]
    grams = mixed(grams)
    out = []
    for n, at in zip(size.tolist(), first.tolist(), strict=True):
        if n >= k:
            s = np.sort(grams[at : at + n - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
