"""Language-model scoring with an Elias-Fano n-gram trie.

The model is of order three. Counts of longer contexts are added to a share of those of
shorter ones, down to the add-one unigram share ``P1(w) = (c(w) + 1) / (N + V + 1)``:

    num2(h, w)    = c(h, w) + MU P1(w)             den2(h)    = c(h) + MU
    num3(g, h, w) = c(g, h, w) + B num2(h, w)      den3(g, h) = c(g, h) + B den2(h)
    P(w | g, h)   = num3(g, h, w) / den3(g, h)

Every sum over w is 1. The numerator needs only counts of n-grams that end in w, the
denominator only counts of n-grams that end in h, so a text's log probability is a sum over
its tokens of ``log10 num3`` less ``log10 den3`` of the context that the token makes for the
next one, and both stand in the shard of that token. Words go to shards by hash; a shard
builds the trie of its words (below each the words before it, below each pair the word
before both), maps it, and answers the triples of all blocks of documents that end in its
words. Very frequent words (a 2000th of all tokens or more: 2000 words at most) are dealt
to several shards by the word before.

A block of documents ships each distinct triple once, with the documents that hold it, in
packed arrays to the shards that it has words for; shards return sums per document. Counts
cover every training document; nothing is pruned. What a task holds is one block or one
shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import even_homes, lean, shards_for, stage
from .ef_trie import Trie
from .shingles import mixed, text_blocks

#: Smoothing, chosen by the likelihood of held-out documents.
MU, B = 1000.0, 0.002
#: Tokens of a block of documents.
BLOCK = 1_000_000
#: Words with a share of 1 / FREQUENT of the tokens or more are split into SPLIT shards.
FREQUENT, SPLIT = 2_000, 16
#: MB of the table a shard: small ones up to MANY shards, beyond that larger ones, so that a block's rows stay long.
SMALL_MB, LARGE_MB, MANY = 5, 40, 4096
#: Partitions of a shuffle, at most; each then holds several shards or blocks, one after the other.
PARTS = 20_000
_END, _START = (xxhash.xxh3_64_intdigest(x, seed=1) for x in (b"end", b"start"))
_BITS = 21  # block-local numbers of words, if a triple is to be one 64-bit number


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the n-th bytes of all numbers together, compressed."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        parts.append(struct.pack("<4sQ", raw.dtype.str[1:].encode(), len(raw)) + raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<4sQ", raw, at)
        kind = np.dtype("<" + kind.rstrip(b"\0").decode())
        at += 12
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += n * kind.itemsize
    return out


def _opened(payload: bytes) -> list[np.ndarray]:
    """A payload's words, their counts, which is the end; of each triple its word, the word before, the one before that, count, times; documents."""
    *words, index, second, sizes, third, counted, times, docs = _unpack(payload)
    return [*words, np.repeat(index, sizes), np.repeat(second, sizes), third, counted, times, docs]


class _Words(dict):
    """Word to its number in the block; 0 is the end, 1 the start."""

    def __init__(self):
        self.hashes = [_END, _START]

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return i

    def numbers(self, text: str | None) -> np.ndarray:
        w = text.encode().lower().split() if text else []
        return np.fromiter(map(self.__getitem__, w), np.int32, len(w))


@lean
def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (key, n) of the words and ends of texts."""
    words, ids, size, ends = _Words(), [], 0, 0

    def flush() -> pa.RecordBatch:
        n = np.bincount(np.concatenate(ids), minlength=len(words.hashes))
        n[0] = ends
        keep = n > 0
        return pa.RecordBatch.from_arrays([pa.array(np.array(words.hashes, np.uint64)[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["key", "n"])

    for b in text_blocks(batches, 0):
        for t in b.column(0).to_pylist():
            ids.append(words.numbers(t))
            size += len(ids[-1])
            ends += 1
        if size > 4_000_000:  # fold what is counted
            yield flush()
            words, ids, size, ends = _Words(), [], 0, 0
    if ends:
        yield flush()


def _order(word: np.ndarray, h: np.ndarray, g: np.ndarray, words: int) -> np.ndarray:
    """Places of triples in the order of (word, h, g), equal ones as they come."""
    if words < 1 << _BITS:
        return np.argsort(word << 2 * _BITS | h << _BITS | g, kind="stable")
    return np.lexsort((g, h, word))


def _encode(shards: int, frequent: np.ndarray, hashes: np.ndarray, ids: list[np.ndarray], trained: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, payload) of a block of documents: the distinct triples that end in words of the shard, and their documents."""
    size = np.array([len(x) for x in ids], np.int64)
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32), size)
    word = np.concatenate(ids).astype(np.int64)
    begins = np.cumsum(size) - size
    h = np.empty_like(word)
    h[1:] = word[:-1]
    h[begins] = 1
    g = np.empty_like(word)
    g[1:] = h[:-1]
    g[begins] = 1
    order = _order(word, h, g, len(hashes))
    word, h, g, doc = word[order], h[order], g[order], doc[order]
    head = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    times = np.diff(np.append(head, len(word)))
    w, h, g = word[head], h[head], g[head]
    counted = np.add.reduceat(trained[doc].astype(np.int64), head)
    heavy = np.isin(hashes, frequent)
    part = np.where(heavy[w], mixed(hashes[h]) % np.uint64(SPLIT), np.uint64(0))
    shard = (mixed(hashes[w] + part) % np.uint64(shards)).astype(np.int64)
    total = np.bincount(w, counted, len(hashes)).astype(np.int64)
    # a frequent word's count goes to all its shards, as other blocks' triples may be there
    many = np.flatnonzero(heavy & (total > 0))
    told = np.unique(np.concatenate([(mixed(hashes[many] + np.uint64(j)) % np.uint64(shards)).astype(np.int64) * len(hashes) + many for j in range(SPLIT)])) if len(many) else np.zeros(0, np.int64)
    told_shard, told_word = told // len(hashes), told % len(hashes)
    by = np.argsort(shard, kind="stable")
    place = np.cumsum(times) - times
    # only the shards that the block has something for: rows are never more than triples and told words
    for s in np.unique(np.concatenate([shard, told_shard])).tolist():
        own = by[np.searchsorted(shard, s, sorter=by) : np.searchsorted(shard, s, "right", sorter=by)]
        more = told_word[np.searchsorted(told_shard, s) : np.searchsorted(told_shard, s, "right")]
        here, index = np.unique(np.concatenate([w[own], more]), return_inverse=True)
        n = times[own]
        lists = np.repeat(place[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # the word and the one before it once for each pair, then what differs
        begin = np.flatnonzero(np.append(True, (w[own][1:] != w[own][:-1]) | (h[own][1:] != h[own][:-1]))) if len(own) else np.zeros(0, np.int64)
        pair = own[begin]
        second, third = (mixed(hashes[x]) >> np.uint64(64 - bits) for x, bits in ((h[pair], Trie.SECOND), (g[own], Trie.THIRD)))
        sizes = np.diff(np.append(begin, len(own))).astype(np.uint32)
        yield s, _pack(hashes[here], total[here].astype(np.uint32), (here == 0).astype(np.uint8), index[begin].astype(np.uint32), second, sizes, third.astype(np.uint32), counted[own].astype(np.uint32), n.astype(np.uint32), doc[lists])


_FLOW = ["home", "shard", "block", "kind", "payload", "keys"]


def _row(home: int, shard: int, block: int, kind: int, payload: bytes, keys: pa.Array) -> pa.RecordBatch:
    """One row; home: what it is dealt by; keys: the keys of a block's documents, or none."""
    held = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.RecordBatch.from_arrays([pa.array([home]), pa.array([shard]), pa.array([block]), pa.array([kind]), pa.array([payload], pa.binary()), held], _FLOW)


def _blocks(shards: int, homes: list[int], frequent: np.ndarray):
    """Rows (home, shard, block, kind, payload, keys) of documents (key, trained, text): kind 0 the documents themselves, 1 a shard's words and triples."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = TaskContext.get().partitionId(), 0
        words, ids, keys, train, n = _Words(), [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            number, trained = at << 24 | block, np.array(train, bool)
            whole = pa.concat_arrays(keys)
            size = np.array([len(x) for x in ids], np.uint32)
            yield _row(homes[number % len(homes)], -1, number, 0, _pack(size, trained.astype(np.uint8)), whole)
            for s, payload in _encode(shards, frequent, np.array(words.hashes, np.uint64), ids, trained):
                yield _row(homes[s % len(homes)], s, number, 1, payload, whole[:0])

        for b in text_blocks(batches, 2):
            keys.append(b.column(0))
            train += b.column(1).to_pylist()
            for t in b.column(2).to_pylist():
                ids.append(np.append(words.numbers(t), np.int32(0)))
                n += len(ids[-1])
            if n >= BLOCK:
                yield from out()
                words, ids, keys, train, n, block = _Words(), [], [], [], 0, block + 1
        if ids:
            yield from out()

    return f


def _build(parts: list[list[np.ndarray]], mu: float, share: float, total: int) -> Trie:
    """The trie of a shard's words from the payloads of all blocks."""
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(float), len(words)).astype(np.int64)
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    word = np.concatenate([at[a:b][p[3]] for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)])
    h, g, n = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    seen, known = n > 0, counts > 0
    word, h, g, n = (np.cumsum(known) - 1)[word[seen]].astype(np.uint64), h[seen], g[seen].astype(np.uint64), n[seen].astype(float)
    words, counts = words[known], counts[known]
    pair, inv = np.unique(word << np.uint64(Trie.SECOND) | h, return_inverse=True)
    c2 = np.bincount(inv, n, len(pair))
    triple, inv = np.unique(inv.astype(np.uint64) << np.uint64(Trie.THIRD) | g, return_inverse=True)
    c3 = np.bincount(inv, n, len(triple))
    node2 = (pair >> np.uint64(Trie.SECOND)).astype(np.int64)
    node3 = (triple >> np.uint64(Trie.THIRD)).astype(np.int64)
    low = share * (c2 + mu * (counts[node2] + 1.0) / total)
    weight = np.log10(c2 + share * (counts[node2] + mu))
    mask = lambda bits: np.uint64((1 << bits) - 1)
    return Trie(Trie.pack(words, counts, node2, pair & mask(Trie.SECOND), np.log10(low), weight, node3, triple & mask(Trie.THIRD), np.log10(c3 + low[node3])))


def _answers(trie: Trie, p: list[np.ndarray], mu: float, share: float, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's triples: log10(c + 1), log10 of what the token and the context that it makes give, and whether the word is known."""
    at = trie.lookup(p[0])
    c = np.where(at >= 0, trie.counts[np.maximum(at, 0)] if len(trie.counts) else 0, 0).astype(float)
    two = trie.second(at[p[3]], p[4])
    three = trie.third(two, p[5])
    prob = np.log10(share * mu * (c + 1) / total)[p[3]]
    weight = np.log10(share * (c + mu))[p[3]]
    pair, triple = two >= 0, three >= 0
    prob[pair], weight[pair] = trie.prob2.at(two[pair]), trie.weight2.at(two[pair])
    prob[triple] = trie.prob3.at(three[triple])
    weight[(p[2] == 1)[p[3]]] = 0.0  # nothing follows an end
    return np.log10(c + 1)[p[3]], prob - weight, (c > 0)[p[3]]


def _shard(homes: list[int], mu: float, share: float, total: int):
    """Of rows sorted by shard: sums by document of each block, from the shard's trie. total: N + V + 1."""

    def solve(blobs: list[tuple[int, bytes]], none: pa.Array) -> Iterator[pa.RecordBatch]:
        trie = _build([_opened(p) for _, p in blobs], mu, share, total)
        for block, payload in blobs:
            p = _opened(payload)
            times, docs = p[7], p[8]
            if not len(docs):
                continue
            # documents of the block that the shard has a token of
            here, at = np.unique(docs, return_inverse=True)
            base, score, known = (np.bincount(at, np.repeat(v, times), len(here)) for v in _answers(trie, p, mu, share, total))
            yield _row(homes[block % len(homes)], 0, block, 1, _pack(here, base, score, known.astype(np.uint32)), none)

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blobs, none = None, [], None
        for b in batches:
            none = b.column(5).flatten()[:0]
            for i, (shard, block, kind) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
                if kind != 1:
                    yield b.slice(i, 1)
                    continue
                if shard != key:
                    if blobs:
                        yield from solve(blobs, none)
                    key, blobs = shard, []
                blobs.append((block, b.column(4)[i].as_py()))
        if blobs:
            yield from solve(blobs, none)

    return f


def _texts(mu: float, share: float, total: int, starts: int):
    """Of rows sorted by block: the scores of each block's documents."""
    names = ["key", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def solve(keys: pa.Array, own: bytes, sums: list[bytes]) -> pa.RecordBatch:
        size, trained = _unpack(own)
        base, score, known = (np.zeros(len(size)) for _ in range(3))
        for blob in sums:
            here, *parts = _unpack(blob)
            for to, part in zip((base, score, known), parts, strict=True):
                to[here] += part
        size = size.astype(np.int64)
        # before the first token stand two starts, as often as there are documents
        score -= np.log10(starts + share * (starts + mu))
        return pa.RecordBatch.from_arrays([keys, pa.array(trained == 0), pa.array(size), pa.array(np.round(known).astype(np.int64)), pa.array(base - size * np.log10(total)), pa.array(score)], names)

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keys, own, sums = None, None, None, []
        for b in batches:
            for i, (block, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if block != key:
                    if own is not None:
                        yield solve(keys, own, sums)
                    key, keys, own, sums = block, None, None, []
                if kind == 1:
                    sums.append(b.column(2)[i].as_py())
                else:
                    keys, own = b.column(3).slice(i, 1).flatten(), b.column(2)[i].as_py()
        if own is not None:
            yield solve(keys, own, sums)

    return f


def score_texts(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", mu: float = MU, share: float = B) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    trained: which documents the model learns from; null counts as not. Words are runs of
    anything but ASCII white space with A-Z lower-cased, and an end follows each text; a
    null or empty text is its end alone. base_score: sum of log10 P1; score: the model's
    log10 probability, of quantised parts. Repeated rows give a row each and count each;
    keys may be of any type and null. Without any training document P1 is 1 for every token
    (N = V = 0). An empty table gives an empty table. Words that share 64 bits of a hash are
    one; so are words before a word that share 36 bits, and before a pair that share 28,
    which touches score alone.
    """
    kind = docs.schema[key].dataType
    use = docs.select(F.col(key).alias("key"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col(text).alias("text"))
    words = use.where("trained").select("text").mapInArrow(_unigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    seen = Observation("unigrams")
    end = int(np.array(_END, np.uint64).view(np.int64))
    watched = words.observe(seen, F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.sum(F.when(F.col("key") == end, F.col("n"))).alias("ends"))
    top = watched.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    got = seen.get
    n, v, starts = int(got.get("n") or 0), int(got.get("v") or 0), int(got.get("ends") or 0)
    frequent = np.array([r.key for r in top if r.n * FREQUENT >= n], np.int64).view(np.uint64)
    shards = shards_for(use, SMALL_MB)
    if shards > MANY:
        shards = max(MANY, shards_for(use, LARGE_MB))
    parts = min(shards, PARTS)
    to_arrow_type(kind)  # a key that Arrow can't carry fails here, not in a task
    keys = f"keys array<{kind.simpleString()}>"
    homes = even_homes(docs.sparkSession, parts)
    flow = f"home long, shard long, block long, kind long, payload binary, {keys}"
    sent = use.mapInArrow(_blocks(shards, homes, frequent), flow).repartition(parts, "home").sortWithinPartitions("shard")
    sums = sent.mapInArrow(_shard(homes, mu, share, n + v + 1), flow).select("home", "block", "kind", "payload", "keys")
    by_block = sums.repartition(parts, "home").sortWithinPartitions("block").drop("home")
    out = by_block.mapInArrow(_texts(mu, share, n + v + 1, starts), f"key {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = stage(out, "scores")  # one short row a document; the job's batches are kept small
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
