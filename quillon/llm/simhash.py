"""SimHash near-duplicates by pigeonhole blocks.

1. A text's fingerprint has a bit wherever over half of its shingles' hashes have it.
2. Equal fingerprints are one class; only classes go on, with the bits by themselves.
3. The 64 bits fall into four blocks of 16. Fingerprints that differ in three bits at most
   are equal in one block at least, so they meet in a bucket (block, its value).
4. A bucket with over ``MANY`` classes is dealt out again by the same rule: what its members
   have not in common falls into four blocks, one of which is equal for every close pair.
   After four rounds they share at least 44 bits, so a bucket has 2^20 classes at most
   whatever the input, and a round costs four rows for each row of a large bucket only.
5. In a bucket a class is taken from those that aren't reached yet, and all classes at a
   Hamming distance of three or less from it are linked to it and searched from in turn.
   What is reached is compared no more, so a dense group costs little more than its size.
6. Those links span the components of all links. Components by stars, then the smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, done_with, heavy_of, joined_by, lean, shards_for, stage
from .shingles import text_blocks

#: Seed of the hash of a shingle, and differing bits of a link at most.
SEED, NEAR = 42, 3
#: Classes of a bucket beyond which it is dealt out again.
MANY = 1024
#: Rounds of blocks: after these, bits that a bucket's members needn't share are 64 - 16 - 12 - 9 - 7 = 20.
ROUNDS = 4
#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 16
#: Bytes of a text whose words are held as a list at a time.
PART = 1 << 19


def bit_counts(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 64): how many of a row's hashes have each bit; row: the row of each hash, ascending."""
    ones = np.zeros((rows, 64), np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part, own = hashes[at : at + AT_ONCE], row[at : at + AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return ones


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in parts of some 100,000, so that a long text isn't held as a list of words."""
    raw = text.encode().lower() if text else b""
    at = 0
    while at < len(raw):
        to = at + PART
        while to < len(raw) and not raw[to : to + 1].isspace():  # words aren't cut
            to += 1
        if part := raw[at:to].split():
            yield part
        at = to


def shingle_hashes(text: str | None, k: int) -> Iterator[list[int]]:
    """XXH64 of each k-word shingle of a text, repeats included, in parts; of fewer words, of all of them; of none, nothing."""
    hashed, held, any_ = xxhash.xxh64_intdigest, [], False
    for part in word_parts(text):
        words = held + part
        if len(words) >= k:
            whole = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.append(0, ends[:-1] + 1)
            yield [hashed(whole[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
            any_, held = True, words[len(words) - k + 1 :]
        else:
            held = words
    if held and not any_:
        yield [hashed(b" ".join(held), SEED)]


def fingerprints(texts: list[str | None], k: int) -> np.ndarray:
    """Of each text the bits that over half of its shingles' hashes have."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    parts, rows, n = [], [], 0

    def count() -> None:
        row = np.repeat(rows, [len(p) for p in parts])
        ones[:] += bit_counts(np.fromiter((h for p in parts for h in p), np.uint64, n), row, len(texts))

    for i, t in enumerate(texts):
        for p in shingle_hashes(t, k):
            parts.append(p), rows.append(i)
            n += len(p)
            total[i] += len(p)
            if n > 500_000:
                count()
                parts, rows, n = [], [], 0
    if n:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _fingerprints(k: int):
    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist(), k).view(np.int64))], ["key", "fp"])

    return f


def _blocks(free: int) -> list[int]:
    """Masks of the free bits' four blocks, as equal in size as they can be; free is a mask of 64 bits."""
    places = [i for i in range(64) if free >> i & 1]
    return [sum(1 << p for p in part.tolist()) for part in np.array_split(places, NEAR + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt_out(rows: DataFrame) -> DataFrame:
    """Rows (free, kept, fp): those of the four blocks of what is free. free: the bits that a bucket needn't share, kept: the values of the others."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for b in batches:
            free, fp = (np.asarray(b.column(i)) for i in (0, 1))
            for mask in np.unique(free):
                own = fp[free == mask]
                whole = int(mask) & (1 << 64) - 1
                for block in known.setdefault(whole, _blocks(whole)):
                    left = np.int64(_signed(whole & ~block))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), left)), pa.array(own & ~left), pa.array(own)], ["free", "kept", "fp"])

    return rows.select("free", "fp").mapInArrow(f, "free long, kept long, fp long")


def close_links(fp: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Links (n, 2) among distinct fingerprints that span the components of all pairs at a distance of ``near`` or less."""
    left, out = fp.astype(np.uint64), []
    while len(left) > 1:
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            x = ahead.pop()
            hit = np.bitwise_count(left ^ x) <= near
            if hit.any():
                met = left[hit]
                out.append(np.stack([np.full(len(met), x), met], axis=1))
                ahead.extend(met)
                left = left[~hit]
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


@lean
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of (free, kept, fp), sorted, whole buckets in it: links (a, b)."""
    held, now = [], None

    def ended() -> Iterator[pa.RecordBatch]:
        e = close_links(np.concatenate(held).view(np.uint64)).view(np.int64)
        if len(e):
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

    for b in batches:
        free, kept, fp = (np.asarray(b.column(i)) for i in range(3))
        cuts = np.flatnonzero((free[1:] != free[:-1]) | (kept[1:] != kept[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            if lo == hi:
                continue
            if (name := (free[lo], kept[lo])) != now:
                if held:
                    yield from ended()
                held, now = [], name
            held.append(fp[lo:hi])
    if held:
        yield from ended()


def near_links(classes: DataFrame, parts: int, many: int = MANY) -> DataFrame:
    """Staged links (a, b) among the distinct fingerprints ``fp`` of classes that span the components of all links."""
    found, made = None, []
    rows = _dealt_out(classes.select(F.lit(-1).cast("long").alias("free"), "fp"))
    for left in range(ROUNDS, 0, -1):
        dealt = stage(rows, "buckets")
        # counts of buckets with over ``many`` members, so there are few of them for the rows that they stand for
        large = stage(dealt.groupBy("free", "kept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (many if left > 1 else 1 << 62)), "large")
        more = bool(large.limit(1).count())
        small = dealt
        if more:
            marked = large.select("free", "kept", F.lit(True).alias("large"))
            dealt = stage(joined_by(dealt, marked, ["free", "kept"], heavy_of(large)).select("free", "kept", "fp", F.coalesce("large", F.lit(False)).alias("large")), "sized")
            small = dealt.where("not large")
        links = stage(small.select("free", "kept", "fp").repartition(parts, "free", "kept").sortWithinPartitions("free", "kept").mapInArrow(_links, "a long, b long").distinct(), "links")
        found = links if found is None else found.unionAll(links)
        if not more:
            break
        rows = _dealt_out(dealt.where("large"))
    return found


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fingerprint string, component_id): documents linked at three or fewer differing bits.

    Shingles are of ``words`` words with A-Z lower-cased, joined by a space, repeats included;
    a text of fewer words is one shingle. A null text or one without words has fingerprint
    zero and is linked like any other. fingerprint is 16 lower-case hex digits; component_id is
    the smallest key of the component. Repeated rows give a row each; rows with a null key take
    part, and a component of such rows alone has a null id. An empty table gives an empty one.
    Other columns are not read, so their names don't matter. Texts are taken whole.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    prints = stage(docs.mapInArrow(_fingerprints(words), f"key {kind}, fp long"), "prints")
    classes = stage(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")), "classes")
    parts = shards_for(classes, 2)
    links = near_links(classes, parts)
    label = components(links)
    # one row a class from here on: its component's smallest key
    named = classes.join(label, classes["fp"] == label["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    named = stage(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    ids = stage(joined_by(named, smallest.drop("members"), "component", heavy_of(smallest.select("component", F.col("members").alias("n")))).select("fp", "n", "component_id"), "ids")
    done_with(classes, named)
    return joined_by(prints, ids.drop("n"), "fp", heavy_of(ids.select("fp", "n"))).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
