"""Media columns: content-defined chunks, deduplicated, and media rebuilt from them.

A payload is stored as an 8-bit media file (a WAVE header and the payload as samples). The
file is cut where a rolling gear hash has its top bits zero. Of equal chunks, by SHA-256, one
place is the owner: the smallest (media hash, number). Only digests are shuffled to find it.

The store is a Parquet table of two kinds of rows: for each distinct media the compressed
run of the chunks that it owns, and its ordered chunk list with the owner's place of each.
Reading a media back takes what it owns from its own row and joins the rest from the
owners; the rebuilt bytes are verified against digest and length.
"""

from __future__ import annotations

import bz2
import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, heavy_of, joined_by, lean, stage, unstage
from .shingles import text_blocks

LEAST, MOST, BITS = 512, 8192, 11
RATE = 8000
UNIT = 64


@functools.cache
def _gear() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), "<u4")


def gear_cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data: after a byte where the gear hash of the last 32 bytes has its top ``bits`` bits zero.

    No chunk is shorter than least, but for the last, or longer than most.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _gear()[np.frombuffer(data, np.uint8)]
    for j in (1, 2, 4, 8, 16):
        h[j:] = h[j:] + (h[:-j] << np.uint32(j))
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i = np.searchsorted(marks, at + least)
        to = int(marks[i]) if i < len(marks) else n
        at = min(to, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def encode(payload: bytes) -> bytes:
    """The payload as samples of an 8-bit mono WAVE file."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def decode(media: bytes) -> bytes:
    """The samples of an 8-bit WAVE file, by walking its parts."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def features(samples: bytes) -> str:
    """Mean, deviation, share of centre crossings and entropy of the samples, then 16 block means."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / len(x)
    mean = float((count * np.arange(256)).sum() / len(x))
    dev = float(np.sqrt((count * (np.arange(256) - mean) ** 2).sum() / len(x)))
    over = x >= 128
    cross = int(np.count_nonzero(over[1:] != over[:-1]))
    blocks = np.add.reduceat(x.astype(np.int64), np.arange(16) * len(x) // 16) // np.diff(np.append(np.arange(16) * len(x) // 16, len(x)))
    return f"mean={mean:.4f};dev={dev:.4f};cross={cross / len(x):.6f};bits={float(-(p * np.log2(p)).sum()):.4f};blocks={bytes(blocks.astype(np.uint8)).hex()}"


@lean
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text): the media's digest, lengths and digests of its chunks."""
    for b in text_blocks(batches, 0):
        rows = []
        for text in b.column(0).to_pylist():
            media = encode(payload_of(text)[1])
            ends = gear_cuts(media)
            starts = [0, *ends[:-1]]
            rows.append((hashlib.sha256(media).digest(), [e - s for s, e in zip(starts, ends, strict=True)], [hashlib.sha256(media[s:e]).digest() for s, e in zip(starts, ends, strict=True)]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())), strict=True)], ["media", "sizes", "digests"])


@lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text): the media's digest and its bytes, compressed; a media that the task has packed already is left out."""
    met = set()
    for b in text_blocks(batches, 0):
        rows = []
        for text in b.column(0).to_pylist():
            media = encode(payload_of(text)[1])
            digest = hashlib.sha256(media).digest()
            if digest not in met:
                if len(met) < 1_000_000:  # beyond this a media may be packed twice, which does no harm
                    met.add(digest)
                rows.append((digest, len(media), bz2.compress(media)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["media", "media_bytes", "packed"])


@lean
def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (media, media_bytes, packed, sizes, foreign, lent): the stored row, with own chunks only."""
    for b in batches:
        packed = []
        for p, sizes, foreign in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if foreign:
                media, skip, at, own = bz2.decompress(p), {f["seq"] for f in foreign}, 0, []
                for i, n in enumerate(sizes):
                    if i not in skip:
                        own.append(media[at : at + n])
                    at += n
                p = bz2.compress(b"".join(own))
            packed.append(p)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), *(b.column(i) for i in (3, 4, 5))], ["media", "media_bytes", "packed", "sizes", "foreign", "lent"])


def build_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The chunk store of the texts' media: (media binary, media_bytes, packed, sizes, foreign, lent), one row for each distinct media.

    packed: the compressed chunks that this media owns. sizes: of all its chunks, in order.
    foreign: [(seq, owner, owner_seq)], the chunks that another media (owner) holds, or null.
    lent: numbers of own chunks that others refer to, or null.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    lists = stage(texts.mapInArrow(_chunks, "media binary, sizes array<long>, digests array<binary>").dropDuplicates(["media"]), "chunks")
    places = lists.select("media", F.posexplode("digests").alias("seq", "digest"))
    owner = stage(places.groupBy("digest").agg(F.min(F.struct("media", "seq")).alias("own"), F.max(F.struct("media", "seq")).alias("last"), F.count(F.lit(1)).alias("n")).where("own <> last").select("digest", "own", "n"), "owners")
    foreign = joined_by(places, owner.drop("n"), "digest", heavy_of(owner.select("digest", "n")), "inner").where(F.struct("media", "seq") != F.col("own")).select("media", F.struct("seq", F.col("own.media").alias("owner"), F.col("own.seq").alias("owner_seq")).alias("f"))
    foreign = stage(foreign, "foreign")
    lent = foreign.select(F.col("f.owner").alias("media"), F.col("f.owner_seq").alias("seq")).distinct().groupBy("media").agg(F.collect_list("seq").alias("lent"))  # at most a media's chunks
    told = foreign.groupBy("media").agg(F.sort_array(F.collect_list("f")).alias("foreign"))  # as above
    held = texts.mapInArrow(_packed, "media binary, media_bytes long, packed binary").dropDuplicates(["media"])
    held = held.join(lists.select("media", "sizes"), "media").join(told, "media", "left").join(lent, "media", "left").select("media", "media_bytes", "packed", "sizes", "foreign", "lent")
    kept = "media binary, media_bytes long, packed binary, sizes array<long>, foreign array<struct<seq:int,owner:binary,owner_seq:int>>, lent array<int>"
    store = stage(held.mapInArrow(_owned, kept), "store")
    done_with(lists, foreign, owner)
    return store


@lean
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (media, packed, sizes, foreign, lent): the lent chunks, (owner, owner_seq, chunk)."""
    for b in batches:
        out = []
        for media, p, sizes, foreign, lent in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            skip, own, at, asked = {f["seq"] for f in foreign or ()}, bz2.decompress(p), 0, set(lent)
            for i, n in enumerate(sizes):
                if i in skip:
                    continue
                if i in asked:
                    out.append((media, i, own[at : at + n]))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["owner", "owner_seq", "chunk"])


@lean
def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stored rows (media, media_bytes, packed, sizes, foreign, got [(seq, chunk)]): what reading the media gives, verified."""
    for b in batches:
        rows = []
        for digest, size, p, sizes, foreign, got in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            own = bz2.decompress(p)
            if foreign:
                more, at, parts = {g["seq"]: g["chunk"] for g in got}, 0, []
                for i, k in enumerate(sizes):
                    if i in more:
                        parts.append(more[i])
                    else:
                        parts.append(own[at : at + k])
                        at += k
                own = b"".join(parts)
            if len(own) != size or hashlib.sha256(own).digest() != digest:
                raise ValueError(f"media {digest.hex()} doesn't match its digest")
            samples = decode(own)
            rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), size, digest.hex(), features(samples), len(sizes), len(sizes) - len(foreign or ())))
        names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks", "n_owned"]
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_media(store: DataFrame) -> DataFrame:
    """One verified row for each media of the store; a missing or changed chunk raises."""
    asked = store.where("foreign is not null").select("media", F.explode("foreign").alias("f")).select("media", "f.seq", "f.owner", "f.owner_seq")
    lending, lent = ("media", "packed", "sizes", "foreign", "lent"), "owner binary, owner_seq int, chunk binary"
    fetch = store.where("lent is not null").select(*lending).mapInArrow(_fetch, lent)
    # a chunk that very many media lack (their number bounds what is broadcast: MOST_HEAVY chunks) isn't shuffled to them
    place = ["owner", "owner_seq"]
    heavy = heavy_of(asked.groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    met = asked.join(fetch, place) if heavy is None else None
    if heavy is not None:
        told = F.broadcast(heavy)
        some = store.where("lent is not null").join(F.broadcast(heavy.select(F.col("owner").alias("media")).distinct()), "media", "left_semi")
        hot = stage(some.select(*lending).mapInArrow(_fetch, lent).join(told, place, "left_semi"), "hot")
        met = asked.join(told, place, "left_semi").join(F.broadcast(hot), place).unionByName(asked.join(told, place, "left_anti").join(fetch, place))
    got = met.groupBy("media").agg(F.collect_list(F.struct("seq", "chunk")).alias("got"))  # at most a media's bytes
    out = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long, n_owned long"
    columns = ["media", "media_bytes", "packed", "sizes", "foreign"]
    alone = store.where("foreign is null").select(*columns, F.lit(None).cast("array<struct<seq:int,chunk:binary>>").alias("got")).mapInArrow(_rebuild, out)
    joined = store.where("foreign is not null").join(got, "media", "left").select(*columns, "got").mapInArrow(_rebuild, out)
    return alone.unionAll(joined)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks, n_owned) of every document.

    A payload is a text's UTF-8 (null: empty) with zero bytes up to a positive multiple of
    64. All figures but n_bytes come from bytes read back from the chunk store. Repeated
    texts are stored once and give a row each, null and empty ones too; an empty table gives
    an empty one. Texts of any length are stored whole, in chunks. Other columns aren't read,
    so their names don't matter.
    """
    store = build_store(docs, text)
    read = stage(read_media(store), "media")
    unstage(store)

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([hashlib.sha256(encode(payload_of(t)[1])).digest() for t in b.column(1).to_pylist()], pa.binary())], [key, "n_bytes", "media"])

    ids = stage(docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(digest, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"), "ids")
    # a media that very many documents share isn't shuffled to them
    return joined_by(ids, read, "media", heavy_of(ids.groupBy("media").agg(F.count(F.lit(1)).alias("n"))), "inner").select(key, "n_bytes", *[c for c in read.columns if c != "media"])
