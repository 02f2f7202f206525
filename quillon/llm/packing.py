"""Best-fit packing of tokenised documents by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so all that packing has to know is how
often each length occurs: at most ``capacity`` rows, whatever the corpus. On those counts
the driver (1) rounds large lengths up to the longest of their group, the groups having
equal numbers of pieces, (2) finds how often to use each configuration of the few
rounded sizes by column generation on the cutting-stock programme, (3) puts the actual
lengths in the places of the rounded ones, (4) puts small lengths, longest first, where
they fit best. The outcome says which sequence and offset the r-th piece of a length
gets; pieces learn their r by a salted exact rank, so no task holds a whole length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, salted_rank, stage

CAPACITY = 4096
END_ID = 1
#: Parts of text kept with their ids in a worker, at most; others are merged each time.
CACHE = 150_000


#: Latin-1 bytes of plain text: white space, printable ASCII, letters from U+00C0 on. Normalising it is lower-casing.
_PLAIN = bytes([*range(9, 14), *range(0x20, 0x7F), *(b for b in range(0xC0, 0x100) if b not in (0xD7, 0xF7))])
_LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


class _Parts(dict):
    """Parts of plain text (Latin-1, lower case) to the bytes of their ids."""

    def __init__(self, merge):
        self.merge = merge
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in turn
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(256, 512))
        self.letters = [chr(b if b in own else next(rest)) for b in range(256)]

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode("latin-1")
        if not part.isascii():
            text = "".join(map(self.letters.__getitem__, text.encode()))
        ids = array("I", [t.id for t in self.merge(text)]).tobytes()
        if len(self) < CACHE:
            self[part] = ids
        return ids


class _Ids:
    """A text's ids as bytes (little-endian unsigned 32 bits).

    The tokenizer drops white space and merges each part of a text alone. Plain texts are
    cut into parts here and each part is merged once; other texts go to the tokenizer.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer)
        self.parts = _Parts(self.whole.model.tokenize)
        tries = "a It's don't12.5% \u00c9t\u00e9, A'LLb'reX stra\u00dfe--x a_b=C3+/ $$$.!!\n\u00dc\u00f1\u00ff"
        self.alike = self.of_plain(tries.encode("latin-1")) == self.of_any(tries)  # a file that cuts otherwise does all texts itself

    def of_any(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def of_plain(self, raw: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(raw.translate(_LOWER))))

    def of(self, text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.of_any(text)
        if not self.alike or b"<|" in raw or raw.translate(None, _PLAIN):
            return self.of_any(text)
        return self.of_plain(raw)


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long) of each document's ids and an end.

    tokenizer: path of a ``tokenizers`` file. Only documents over capacity are cut, into pieces of
    capacity and a rest. A null or empty text is the end alone; repeated rows have pieces each.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about 3 MB
    kind = docs.schema[key].dataType
    end = np.asarray([end_id], "<u4").tobytes()

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(source.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                row, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    data = memoryview((ids.of(t) if t else b"") + end)
                    for p, s in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[s : s + 4 * capacity]
                        row.append(i), piece.append(p), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(cut, f"{key} {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 600) -> list[tuple[int, list[int]]]:
    """Whole uses of configurations from the linear programme's optimum, rounded down: [(uses, number of each size)].

    Column generation: the basis starts from configurations of one size each; a knapsack
    over the dual prices brings in the next one until none prices out over 1, or for
    ``most`` steps; what it has then packs all the same, with a few sequences more.
    """
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    basis = np.array(columns).T.copy()
    want = np.asarray(demand, float)
    x = np.linalg.solve(basis, want)
    fit = capacity // min(sizes)
    for _ in range(most):
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros((fit + 1, capacity + 1))
        pick = np.full((fit + 1, capacity + 1), -1)
        for j in range(1, fit + 1):
            best[j] = best[j - 1]
            for i, s in enumerate(sizes):
                if price[i] > 0:
                    got = best[j - 1][: capacity + 1 - s] + price[i]
                    better = got > best[j][s:] + 1e-12
                    best[j][s:][better] = got[better]
                    pick[j][s:][better] = i
        if best[fit][capacity] <= 1 + 1e-7:
            break
        a, c = np.zeros(k), capacity
        for j in range(fit, 0, -1):
            if (i := pick[j][c]) >= 0:
                a[i] += 1
                c -= sizes[i]
        d = np.linalg.solve(basis, a)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = a
        x = np.maximum(np.linalg.solve(basis, want), 0)
    return [(int(u), [int(v) for v in basis[:, i]]) for i, u in enumerate(np.floor(x + 1e-9)) if u >= 1]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 40, small: int | None = None) -> list[tuple[int, list[int]]]:
    """[(number of sequences, lengths in each)] that holds every length as often as counts says."""
    small = capacity // 8 if small is None else small
    runs = sorted(((n, c) for n, c in counts.items() if n > small and c > 0), reverse=True)
    total = sum(c for _, c in runs)
    bins: list[list] = []  # [count, lengths]
    if total:
        # equal numbers of pieces in each group; a run of one length may lie in several
        members: list[list[list[int]]] = []
        size, room = -(-total // groups), 0
        for n, c in runs:
            while c:
                if not room:
                    members.append([])
                    room = size
                take = min(c, room)
                members[-1].append([n, take])
                c, room = c - take, room - take
        by_top: dict[int, list[list[int]]] = {}
        for g in members:
            by_top.setdefault(g[0][0], []).extend(g)
        tops = list(by_top)
        pools = [by_top[t] for t in tops]
        plan = _configurations(tops, [sum(c for _, c in p) for p in pools], capacity)
        heads = [0] * len(pools)

        def fill(need: list[tuple[int, int]], uses: int) -> None:
            while uses:
                here = []
                for g, m in need:
                    while heads[g] < len(pools[g]) and not pools[g][heads[g]][1]:
                        heads[g] += 1
                    if heads[g] < len(pools[g]):
                        here.append((g, m))
                if not here:
                    return
                times = min([uses, *(pools[g][heads[g]][1] // m for g, m in here)])
                if times:
                    bins.append([times, [n for g, m in here for n in [pools[g][heads[g]][0]] * m]])
                    for g, m in here:
                        pools[g][heads[g]][1] -= times * m
                    uses -= times
                else:
                    one = []
                    for g, m in here:
                        for _ in range(m):
                            while heads[g] < len(pools[g]) and not pools[g][heads[g]][1]:
                                heads[g] += 1
                            if heads[g] < len(pools[g]):
                                pools[g][heads[g]][1] -= 1
                                one.append(pools[g][heads[g]][0])
                    bins.append([1, one])
                    uses -= 1

        for uses, numbers in plan:
            fill([(g, m) for g, m in enumerate(numbers) if m], uses)
        rest = defaultdict(int)
        for p in pools:
            for n, c in p:
                rest[n] += c
    else:
        rest = defaultdict(int)
    for n, c in counts.items():
        if 0 < n <= small and c > 0:
            rest[n] += c
    # best fit on counts: the fullest sequences that still take the length take as many as they can
    free: dict[int, list[int]] = defaultdict(list)
    for i, (_, items) in enumerate(bins):
        free[capacity - sum(items)].append(i)
    for n in sorted((n for n, c in rest.items() if c), reverse=True):
        left = rest[n]
        for r in range(n, capacity + 1):
            while left and free[r]:
                i = free[r][-1]
                q = r // n
                times = min(bins[i][0], left // q)
                if not times:
                    q, times = left, 1
                if times < bins[i][0]:
                    bins[i][0] -= times
                    bins.append([times, [*bins[i][1], *[n] * q]])
                    i = len(bins) - 1
                else:
                    free[r].pop()
                    bins[i][1] = [*bins[i][1], *[n] * q]
                free[r - n * q].append(i)
                left -= times * q
            if not left:
                break
        if left:
            q = capacity // n
            for times, m in ((left // q, q), (1, left % q)):
                if times and m:
                    bins.append([times, [n] * m])
                    free[capacity - n * m].append(len(bins) - 1)
    return [(c, items) for c, items in bins if c]


def pack(pieces: DataFrame, salt: list[str], capacity: int = CAPACITY, groups: int = 40, small: int | None = None, buckets: int = 1024, most_slots: int = 4_000_000) -> DataFrame:
    """pieces (with length long from 1 to capacity) with sequence_id and offset (long): gapless sequences of at most capacity.

    salt: columns that spread and order pieces of a length; pieces alike in all of them are
    the same row. Reruns on the same rows agree. An empty table gives an empty table.
    The plan's size depends on capacity, not on the number of pieces; over most_slots it raises.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).limit(capacity + 2).collect()  # one row per length
    counts = {int(r.length): int(r.n) for r in rows}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    used: dict[int, int] = defaultdict(int)
    slots, first = [], 0
    for times, items in packing_plan(counts, capacity, groups, small):
        at = 0
        for n in items:
            slots.append((n, used[n], first, at))
            used[n] += times
            at += n
        first += times
    if used != counts or len(slots) > most_slots:
        raise RuntimeError(f"{len(slots)} slots; the plan holds {sum(used.values())} of {sum(counts.values())} pieces")
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    keys = spark.sparkContext.broadcast(((table[:, 0] << 48) | table[:, 1], table[:, 1:]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, rest = keys.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": rest[at, 1] + rank - rest[at, 0], "offset": rest[at, 2]})

    ranked = salted_rank(pieces, ["length"], [F.col(c) for c in salt], F.xxhash64(*salt), buckets)
    return ranked.withColumn("__at", place("length", "rank")).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, groups: int = 40) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    pieces = stage(token_pieces(docs, tokenizer, key, text, capacity, end_id), "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], capacity, groups)
