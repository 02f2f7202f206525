"""Elias-Fano sequences and the n-gram trie made of them, in memory-mapped levels."""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

U = np.uint64


class EliasFano:
    """A sorted sequence of unsigned 64-bit numbers: low bits packed, high parts as a unary bit map.

    ``bytes`` holds about ``2 + log2(universe / n)`` bits a number. Opening it derives the
    start of each high part from the bit map; reads go to the packed low bits in place.
    """

    def __init__(self, data):
        self.n, self.low, size = struct.unpack_from("<QQQ", data, 0)
        at = 24
        bits = np.frombuffer(data, np.uint8, size, at)
        zeros = np.flatnonzero(np.unpackbits(bits, bitorder="little") == 0)
        # the i-th zero ends high part i; before it stand as many ones as numbers with parts up to i
        self.start = np.concatenate([[0], np.minimum(zeros - np.arange(len(zeros)), self.n)]).astype(np.int64)
        held = self.low * -(-self.n // 64) * 8 + 8
        # a word at every byte: a number's low bits lie within one
        self.lows = np.ndarray((held - 7,), "<u8", data, at + size, (1,))
        self.most = int(np.diff(self.start).max(initial=0)).bit_length()
        self.size = at + size + held

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> U(low)).astype(np.int64)
        bits = np.zeros(n + (universe >> low) + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        # 64 numbers fill ``low`` words; the j-th of each 64 goes to the same place of its words
        rows = np.zeros((-(-n // 64), 64), np.uint64)
        rows.ravel()[:n] = values & U((1 << low) - 1)
        words = np.zeros((len(rows), low + 1), np.uint64)
        for j in range(64 if low else 0):
            w, shift = divmod(j * low, 64)
            words[:, w] |= rows[:, j] << U(shift)
            if shift + low > 64:
                words[:, w + 1] |= rows[:, j] >> U(64 - shift)
        return struct.pack("<QQQ", n, low, len(packed)) + packed + words[:, :low].astype("<u8").tobytes() + bytes(8)

    def lows_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low
        return (self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & U((1 << self.low) - 1)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of x by successor search, within places begin to end of each where given; -1 where it is missing."""
        if not self.n:
            return np.full(len(x), -1)
        high = np.minimum((x >> U(self.low)).astype(np.int64), len(self.start) - 2)
        want = x & U((1 << self.low) - 1)
        lo, hi = self.start[high], self.start[high + 1]
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop = hi.copy()
        for _ in range(self.most + 1):
            open_ = lo < hi
            if not open_.any():
                break
            mid = np.where(open_, (lo + hi) >> 1, 0)
            less = open_ & (self.lows_at(mid) < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        inside = lo < stop
        ok = inside & (self.lows_at(np.where(inside, lo, 0)) == want) & ((x >> U(self.low)).astype(np.int64) == high)
        return np.where(ok, lo, -1)

    def at(self, i: np.ndarray) -> np.ndarray:
        # in rising order, so that neighbouring places are read one after the other
        order = np.argsort(i)
        high = np.empty(len(i), np.int64)
        high[order] = np.searchsorted(self.start, i[order], side="right") - 1
        return high.astype(np.uint64) << U(self.low) | self.lows_at(i)


class Quantised:
    """Numbers in 2^16 even steps from their least to their largest."""

    def __init__(self, data):
        self.least, self.step, n = struct.unpack_from("<ddQ", data, 0)
        self.codes = np.frombuffer(data, "<u2", n, 24)
        self.size = 24 + 2 * n

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        least, top = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (top - least) / 65535 or 1.0
        return struct.pack("<ddQ", least, step, len(values)) + np.round((values - least) / step).astype("<u2").tobytes()

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[i] if len(self.codes) else np.zeros(len(i))


class Trie:
    """Three levels: words, below each the words seen before it, below each of those the words seen before both.

    Each level holds the keys of its nodes as one rising sequence: a node's key is made
    relative to its context by adding the context's place times 2^bits. A monotone sequence
    of pointers says where the children of each node begin; a search goes through the
    pointers to the children of one context and looks for the successor of a key there.
    Levels 2 and 3 hold quantised log10 probabilities, level 2 quantised weights of the
    context that the node makes for the next word.
    """

    #: Bits of the keys of words before: relative to their context, which has far fewer children.
    SECOND, THIRD = 36, 28

    @classmethod
    def pack(cls, words: np.ndarray, counts: np.ndarray, node2: np.ndarray, key2: np.ndarray, prob2: np.ndarray, weight2: np.ndarray, node3: np.ndarray, key3: np.ndarray, prob3: np.ndarray) -> bytes:
        """words: sorted keys; node2, key2: contexts (place of the word, key before it), sorted; node3, key3: the same for places of contexts."""
        first2 = np.searchsorted(node2, np.arange(len(words) + 1)).astype(np.uint64)
        first3 = np.searchsorted(node3, np.arange(len(node2) + 1)).astype(np.uint64)
        levels = [
            EliasFano.pack(words, 1 << 64),
            EliasFano.pack(first2, len(node2) + 1),
            EliasFano.pack((node2.astype(np.uint64) << U(cls.SECOND)) + key2, (len(words) + 1) << cls.SECOND),
            EliasFano.pack(first3, len(node3) + 1),
            EliasFano.pack((node3.astype(np.uint64) << U(cls.THIRD)) + key3, (len(node2) + 1) << cls.THIRD),
            *map(Quantised.pack, (prob2, weight2, prob3)),
        ]
        return struct.pack("<Q", len(words)) + counts.astype("<u8").tobytes() + b"".join(levels)

    def __init__(self, data: bytes):
        # the levels live in an unnamed file of this task alone, which a task run again makes anew; the mapping outlives its name
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        (n,) = struct.unpack_from("<Q", view, 0)
        self.counts = np.frombuffer(view, "<u8", n, 8)
        at, levels = 8 + 8 * n, []
        for kind in (EliasFano, EliasFano, EliasFano, EliasFano, EliasFano, Quantised, Quantised, Quantised):
            levels.append(kind(view[at:]))
            at += levels[-1].size
        self.words, self.first2, self.keys2, self.first3, self.keys3, self.prob2, self.weight2, self.prob3 = levels

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Places of words; -1 where one is unknown."""
        return self.words.find(words)

    @staticmethod
    def _children(pointers: EliasFano, keys: EliasFano, bits: int, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place of each (node, key) among the children of node; -1 where node is -1 or has no such child."""
        out = np.full(len(node), -1)
        known = np.flatnonzero(node >= 0)
        if len(known) and keys.n:
            places, at = np.unique(np.concatenate([n := node[known], n + 1]), return_inverse=True)
            begin, end = pointers.at(places).astype(np.int64)[at].reshape(2, -1)
            out[known] = keys.find((n.astype(np.uint64) << U(bits)) + key[known].astype(np.uint64), begin, end)
        return out

    def second(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self._children(self.first2, self.keys2, self.SECOND, word, before)

    def third(self, context: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self._children(self.first3, self.keys3, self.THIRD, context, before)
