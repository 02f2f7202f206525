"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks, one row of the index each. Of every term of the vocabulary a block
holds the places of its documents and, for each bit of their impacts, a bitmap over those
places: the term's slices. A document's impact is what the term adds to its score,
``w * ((1000000000 tf) div (1000 tf + 12 m))``, so scores are sums of slices.

Search adds slices as numbers are added by hand, one bit of all documents and all items at a
time: ``sum = a ^ b ^ carry``, ``carry = a & b | carry & (a ^ b)``. The top k of a block are
found from the most significant slice down: while more than k documents can still be in, those
without the bit go; when fewer have it, they are in for certain and the rest is searched on.
What ties at the end goes by key. Each block yields k rows an item; ranks over blocks follow.

One scan of the texts makes postings, one pass over those the index once the counts that
weights need are known. Only the vocabulary of the items asked is indexed; what is told to all
tasks is that vocabulary and the items, in lots of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from .common import done_with, lean, stage
from .shingles import text_blocks

#: Terms: what is neither an ASCII letter or digit nor beyond ASCII stands between them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 as terms have them: A-Z lower-cased, blanks for what stands between.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Documents and terms of a block, at most; one longer text is a block by itself.
DOCS, TERMS = 16_384, 4_000_000
#: Terms of all items of a lot, about: it bounds what is broadcast. A lot of one item may be larger, up to WHOLE.
LOT, WHOLE = 200_000, 4_000_000
#: Items whose sums a task holds at a time, and MB of slices that it keeps unpacked.
ITEMS, KEPT_MB = 128, 64
#: Bytes of a text whose terms are held as a list at a time.
PART = 1 << 20


class ImpactIndex(NamedTuple):
    """blocks: staged rows (keys, terms, places, slices); vocabulary: term to number; n_docs, n_terms: N and L; weights: w by number of term."""

    blocks: DataFrame
    vocabulary: dict[bytes, int]
    n_docs: int
    n_terms: int
    weights: np.ndarray


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in parts, so that a long text isn't held as a list of terms."""
    raw = text.encode().translate(_BYTES) if text else b""
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PART)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def _postings(told, kind: pa.DataType):
    """Rows of a block: keys (ascending), their numbers of terms, and of each term met the places of its documents and its occurrences there."""

    def block(keys: list, sizes: list[int], ids: list[np.ndarray], rows: list[int]) -> pa.RecordBatch:
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        at = place[np.repeat(np.array(rows, np.int64), [len(x) for x in ids])] if ids else flat
        both, tf = np.unique(flat * len(keys) + at, return_counts=True)
        term, where = np.divmod(both, len(keys))
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(first, len(term)))
        values = [[keys[i] for i in order], np.array(sizes, np.int64)[order].tobytes(), int(sum(sizes)), term[first].astype(np.int32), df.astype(np.int32), where.astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    names = ["keys", "sizes", "total", "terms", "df", "places", "tf"]
    types = [pa.list_(kind), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = told.value
        keys, sizes, ids, rows, held = [], [], [], [], 0
        for b in text_blocks(batches, 1):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = 0
                for part in term_lists(text):
                    n += len(part)
                    ids.append(np.array([number[t] for t in part if t in number], np.int32))
                    rows.append(len(keys))
                if n:
                    keys.append(key), sizes.append(n)
                    held += n
                else:  # a text without terms isn't counted and is found by none
                    while rows and rows[-1] == len(keys):
                        rows.pop(), ids.pop()
                if held >= TERMS or len(keys) >= DOCS:
                    yield block(keys, sizes, ids, rows)
                    keys, sizes, ids, rows, held = [], [], [], [], 0
        if keys:
            yield block(keys, sizes, ids, rows)

    return f


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of postings, what a weight is multiplied by; size: terms of the document."""
    big = len(size) and 25 * int(size.max()) * n_docs >= 1 << 63
    m = 75 + np.array([25 * s * n_docs // n_terms for s in size.tolist()], np.int64) if big else 75 + 25 * size * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def sliced(values: np.ndarray) -> bytes:
    """Bitmaps over the values, one for each bit up to the largest value's, least significant first."""
    bits = max(1, int(values.max()).bit_length())
    return np.packbits((values[None, :] >> np.arange(bits)[:, None]) & 1, axis=1, bitorder="little").tobytes()


def unsliced(slices: bytes, places: np.ndarray, words: int) -> np.ndarray:
    """(bits, words) bitmaps over a block's documents."""
    bits = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(-1, -(-len(places) // 8)), axis=1, count=len(places), bitorder="little")
    out = np.zeros((len(bits), 64 * words), np.uint8)
    out[:, places] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def added(sums: np.ndarray, more: np.ndarray) -> None:
    """Adds bit-sliced numbers ``more`` (bits, ...) to ``sums`` (as many bits or more) in place."""
    carry = np.zeros(sums.shape[1:], sums.dtype)
    for b in range(len(sums)):
        a = sums[b].copy()
        if b < len(more):
            x = more[b]
            half = a ^ x
            np.bitwise_xor(half, carry, out=sums[b])
            carry = (a & x) | (carry & half)
        else:
            np.bitwise_xor(a, carry, out=sums[b])
            carry &= a
            if not carry.any():
                break


def top_k(sums: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of (bits, items, words) sums, each item's places and scores of the k highest above 0; ties go to smaller places."""
    rest = np.bitwise_or.reduce(sums, axis=0)
    sure = np.zeros_like(rest)
    for b in range(len(sums) - 1, -1, -1):
        has = rest & sums[b]
        n = np.bitwise_count(sure | has).sum(axis=1, dtype=np.int64)
        few = (n <= k)[:, None]  # all that have the bit are in
        sure = np.where(few, sure | has, sure)
        rest = np.where(few, rest & ~sums[b], has)
    spread = lambda row: np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
    out, shift = [], np.arange(len(sums))
    for i in range(sums.shape[1]):
        at = spread(sure[i])
        if len(at) < k:
            at = np.append(at, spread(rest[i])[: k - len(at)])
        bits = (sums[:, i, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        score = (bits.astype(np.int64) << shift[:, None]).sum(axis=0)
        order = np.lexsort((at, -score))
        out.append((at[order], score[order]))
    return out


def impact_index(docs: DataFrame, vocabulary: list[bytes], key: str = "doc_id", text: str = "text") -> ImpactIndex:
    """An index of docs for the terms of vocabulary. Its keys may be of any type that sorts, null last; null texts and texts without a term aren't in it."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema["key"].dataType
    number = {t: i for i, t in enumerate(vocabulary)}
    told = spark.sparkContext.broadcast(number)  # the terms of a lot
    held = f"keys array<{kind.simpleString()}>, sizes binary, total long, terms array<int>, df array<int>, places binary, tf binary"
    found = stage(docs.mapInArrow(_postings(told, to_arrow_type(kind)), held), "postings")
    done_with(told)
    size = found.agg(F.sum(F.size("keys")).alias("docs"), F.sum("total").alias("terms")).first()
    n_docs, n_terms = size.docs or 0, size.terms or 0
    df = np.zeros(len(vocabulary), np.int64)
    pairs = found.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy("p.terms").agg(F.sum("p.df").alias("n")).toArrow()  # a row a term of the vocabulary
    df[pairs.column(0).to_numpy()] = pairs.column(1).to_numpy()
    w = np.array([weight(n_docs, int(d)) for d in df], np.int64)

    @lean
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes = np.frombuffer(b.column(1)[i].as_py(), np.int64)
                terms, per = (np.array(b.column(j)[i].as_py(), np.int64) for j in (3, 4))
                places, tf = (np.frombuffer(b.column(j)[i].as_py(), np.uint32).astype(np.int64) for j in (5, 6))
                values = impacts(tf, sizes[places], n_docs, n_terms) * np.repeat(w[terms], per)
                ends = np.cumsum(per)
                slices = [sliced(values[e - n : e]) for n, e in zip(per.tolist(), ends.tolist(), strict=True)]
                where = [places[e - n : e].astype(np.uint32).tobytes() for n, e in zip(per.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(3).slice(i, 1), pa.array([where], pa.list_(pa.binary())), pa.array([slices], pa.list_(pa.binary()))], ["keys", "terms", "places", "slices"])

    blocks = stage(found.mapInArrow(build, f"keys array<{kind.simpleString()}>, terms array<int>, places array<binary>, slices array<binary>"), "index")
    done_with(found)
    return ImpactIndex(blocks, number, n_docs, n_terms, w)


def search_block(n_docs: int, terms: list[int], places: list[bytes], slices: list[bytes], items: list[dict[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, places, scores) of a block's k best documents of each item; items: term to repeats."""
    words = -(-n_docs // 64)
    own = {t: (np.frombuffer(p, np.uint32), s) for t, p, s in zip(terms, places, slices, strict=True)}
    asked, kept, room = Counter(t for x in items for t in x if t in own), {}, KEPT_MB << 20

    def bitmaps(t: int) -> np.ndarray:
        nonlocal room
        if t in kept:
            return kept[t]
        out = unsliced(own[t][1], own[t][0], words)
        if asked[t] > 1 and room >= out.nbytes:
            kept[t] = out
            room -= out.nbytes
        return out

    for lo in range(0, len(items), ITEMS):
        # a term that an item has several times is added once for each bit of that number, moved by it
        steps = [[(t, j) for t, n in x.items() if t in own for j in range(n.bit_length()) if n >> j & 1] for x in items[lo : lo + ITEMS]]
        most = max((sum(1 << len(own[t][1]) // -(-len(own[t][0]) // 8) + j for t, j in s) for s in steps), default=0)
        if not most:
            continue
        sums = np.zeros((most.bit_length(), len(steps), words), np.uint64)
        for turn in range(max(map(len, steps))):
            more = np.zeros_like(sums)
            high = 0
            for i, s in enumerate(steps):
                if turn < len(s):
                    t, j = s[turn]
                    x = bitmaps(t)
                    more[j : j + len(x), i] = x
                    high = max(high, j + len(x))
            added(sums, more[:high])
        for i, (at, score) in enumerate(top_k(sums, k)):
            if len(at):
                yield lo + i, at, score


def search(index: ImpactIndex, items: list[dict[bytes, int]], k: int = 20) -> DataFrame:
    """(item int, key, score long): of each partition of the index the k best documents of each item; ranks over all follow from these rows."""
    spark = index.blocks.sparkSession
    told = spark.sparkContext.broadcast([{index.vocabulary[t]: n for t, n in x.items()} for x in items])
    kind = index.blocks.schema["keys"].dataType.elementType

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = told.value
        best: list[list[tuple]] = [[] for _ in asked]
        names = ["item", "key", "score"]

        def cut(rows: list[tuple]) -> list[tuple]:
            return sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] if r[0] is not None else 0))[:k]

        keys_type = None
        for b in batches:
            keys_type = b.column(0).type.value_type
            for i in range(b.num_rows):
                keys = b.column(0)[i].as_py()
                for item, at, score in search_block(len(keys), *(b.column(j)[i].as_py() for j in (1, 2, 3)), asked, k):
                    best[item] += [(keys[p], s) for p, s in zip(at.tolist(), score.tolist(), strict=True)]
                    if len(best[item]) > 16 * k:
                        best[item] = cut(best[item])
        for item, rows in enumerate(best):
            if rows:
                rows = cut(rows)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int32()), pa.array([r[0] for r in rows], keys_type), pa.array([r[1] for r in rows], pa.int64())], names)

    return index.blocks.mapInArrow(f, f"item int, key {kind.simpleString()}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(item_key, rank int, key, score long): each item's k best documents with a score above 0, ties to smaller keys.

    All documents and whole texts are ranked; null texts and texts without a term have no score
    and count nowhere. Null keys rank behind all others of a score. Repeated documents are
    ranked each; repeated items are answered each. An item without a term known to any
    document has no rows, nor has anything where documents or items are an empty table. Other
    columns aren't read, so their names don't matter. An item of over WHOLE terms raises.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item}`").alias("item"), F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    lots = -(-total // LOT)
    out = None
    for lot in range(lots):
        own = asked if lots == 1 else asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(lots)) == lot)
        if lots > 1 and (own.agg(F.sum(F.size("terms"))).first()[0] or 0) > WHOLE:
            raise ValueError(f"an item has over {WHOLE - LOT} terms")
        rows = own.toArrow()  # about LOT terms
        terms = [Counter(t.encode() for t in x) for x in rows.column("terms").to_pylist()]
        vocabulary = sorted(set().union(*terms)) if terms else []
        if not vocabulary:
            continue
        index = impact_index(docs, vocabulary, key, text)
        found = stage(search(index, terms, k), "found")
        done_with(index.blocks)
        best = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"))
        # first of parts of an item's rows, then of what these leave
        first = found.withColumn("part", F.pmod(F.xxhash64("key", "score"), F.lit(64))).withColumn("at", F.row_number().over(best("item", "part"))).where(F.col("at") <= k)
        ranked = first.withColumn("rank", F.row_number().over(best("item"))).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(rows.num_rows), pa.int32()), "name": rows.column("item")}))  # the lot's items
        ranked = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_key), "rank", F.col("key").alias(key), "score")
        out = ranked if out is None else out.unionAll(ranked)
    if out is None:
        of = T.StructType().add(item_key, asked.schema["item"].dataType).add("rank", T.IntegerType()).add(key, docs.schema[key].dataType).add("score", "long")
        return spark.createDataFrame([], of)
    return out
