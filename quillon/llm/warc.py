"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Both derived records name the response in WARC-Refers-To and keep its target and date; the
metadata record carries the response's WARC and HTTP headers and digests as they are.
A record is derived by one task from its own bytes, so there is no shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, in_bit_map, lean
from .shingles import text_blocks

DATE = "2024-01-01T00:00:00Z"
#: Bits of the map of repeated pages, at most (16 MB): it bounds a broadcast; beyond it more ids than needed hold places.
REPEATED = 1 << 27
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|blockquote|pre|hr|dt|dd)\b)[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_HREF = re.compile(r"""<(a|link|img|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*["']?([^"'\s>]+)""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_:.\-]+)""", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(parts))}>"


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length and WARC-Block-Digest are added. Line breaks in values become spaces."""
    lines = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _members(data: bytes) -> Iterator[bytes]:
    """What WARC data holds, in pieces: gzip members unpacked one bit after the other, or plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            piece = unpack.decompress(data, 1 << 20)
            if not piece and not unpack.unconsumed_tail and not unpack.eof:
                raise ValueError("cut gzip member")
            data = unpack.unconsumed_tail
            yield piece
        data = unpack.unused_data.lstrip(b"\0")  # some writers fill up with zeros


def _headers(head: bytes) -> list[tuple[str, str]]:
    """Header lines in order, repeated ones too; white space around values is no part of them, and indented lines go on the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def raw_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, bytes]]:
    """(headers, block, the record's own bytes) of each record; what is unpacked is held one record at a time. A cut or malformed record raises ValueError."""
    held, pieces = bytearray(), _members(data)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while len(held) < 5 and more():
            pass
        if not held:
            return
        if held[:5] != b"WARC/":
            raise ValueError("no record where one should begin")
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("cut record")
        _, _, lines = bytes(held[:end]).partition(b"\r\n")
        headers = _headers(lines)
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not size.isdigit():
            raise ValueError("no content length")
        to = end + 8 + int(size)
        while len(held) < to:
            if not more():
                raise ValueError("cut record")
        yield headers, bytes(held[end + 4 : to - 4]), bytes(held[:to])
        del held[:to]


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record in WARC data, gzip members or plain."""
    for headers, block, _ in raw_records(data):
        yield headers, block


_HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def verify(what: str, claimed: str | None, data: bytes) -> None:
    """Raises ValueError where data hasn't the claimed digest (base 32 or hex); unknown algorithms are taken as they are."""
    name, _, value = (claimed or "").partition(":")
    if (make := _HASHES.get(name.lower().replace("-", ""))) and value:
        got = make(data).digest()
        if value.upper().rstrip("=") != base64.b32encode(got).decode().rstrip("=") and value.lower() != got.hex():
            raise ValueError(f"{what} doesn't match its digest")


def content(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """A payload with its chunks joined, gzip and deflate unpacked; what can't be unpacked stays as it is."""
    at = {k.lower(): v for k, v in http}
    if at.get("transfer-encoding", "").lower() == "chunked":
        payload = _joined(payload)
    if at.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                return zlib.decompressobj(bits).decompress(payload)
            except zlib.error:
                pass
    return payload


def payload_text(http: list[tuple[str, str]], payload: bytes) -> str:
    """Content as text in the charset of its header or its own meta tag, else UTF-8; bytes that aren't of the charset become U+FFFD."""
    at = {k.lower(): v for k, v in http}
    said = _CHARSET.search(at.get("content-type", "")) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _joined(payload: bytes) -> bytes:
    """A chunked body's content; the body as it is, where it isn't chunked after all."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return payload
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 4 + n
    return payload


def response_record(key: str, url: str | None, body: str | None, date: str = DATE, again: str = "") -> bytes:
    """A page's response record; its id depends on key, url and body, and on ``again``, which tells rows apart that are alike."""
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", digest(payload), *([again] if again else []))), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", url))
    return build_record([*headers, ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], block)


def plain_text(page: str) -> str:
    """Text of a page: lines at block elements, entities resolved, runs of white space one space, no empty lines."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page))))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def media_type(http: list[tuple[str, str]], payload: bytes) -> str:
    """The payload's media type by its header, lower case; without one text/html where it looks like text, else application/octet-stream."""
    said = next((v for k, v in http if k.lower() == "content-type"), "").split(";")[0].strip().lower()
    return said or ("application/octet-stream" if b"\0" in payload[:1024] else "text/html")


def is_text(media: str) -> bool:
    return media.startswith("text/") or media.endswith(("+xml", "+json")) or media in ("application/xml", "application/json", "application/javascript")


def is_markup(media: str) -> bool:
    return media in ("text/html", "text/xml", "application/xml") or media.endswith("+xml")


def derive_record(record: bytes) -> Iterator[dict]:
    """The metadata and, for payloads of text, the conversion record of one response record; nothing for records of other types.

    A record that can't be read, has no id or doesn't match its digests raises ValueError.
    """
    for headers, block in parse_records(record):
        at = {k.lower(): v for k, v in headers}
        if at.get("warc-type") != "response":
            continue
        source = at.get("warc-record-id")
        if not source:
            raise ValueError("no record id")
        head, _, payload = block.partition(b"\r\n\r\n")
        status, _, lines = head.partition(b"\r\n")
        http = _headers(lines)
        verify(f"block of {source}", at.get("warc-block-digest"), block)
        verify(f"payload of {source}", claimed := at.get("warc-payload-digest"), payload)
        payload = content(http, payload)
        media = media_type(http, payload)
        page = payload_text(http, payload) if is_text(media) else ""
        marked = is_markup(media)
        title = _TITLE.search(page) if marked else None
        links = [{"tag": t.lower(), "url": html.unescape(u)} for t, u in _HREF.findall(_DROP.sub(" ", page))] if marked else []
        meta = {"warc": headers, "status": status.decode("utf-8", "replace"), "http": http, "title": " ".join(html.unescape(title[1]).split()) if title else None, "links": links}
        shared = [("WARC-Date", at.get("warc-date", DATE)), *([("WARC-Target-URI", at["warc-target-uri"])] if "warc-target-uri" in at else []), ("WARC-Refers-To", source)]
        made = [("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True).encode())]
        if is_text(media):
            made.append(("conversion", "text/plain; charset=utf-8", (plain_text(page) if marked else page).encode()))
        for kind, mime, body in made:
            name = record_id(kind, source)
            data = build_record([("WARC-Type", kind), ("WARC-Record-ID", name), *shared, ("Content-Type", mime)], body)
            yield {"record_type": kind, "record_id": name, "refers_to": source, "target_uri": at.get("warc-target-uri"), "warc_date": shared[0][1], "content_type": mime, "content_length": len(body), "block_digest": digest(body), "source_payload_digest": claimed, "source_block_digest": at.get("warc-block-digest"), "n_links": len(links), "body": body.decode(), "record": data}


_OUT = {"record_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "warc_date": "string", "content_type": "string", "content_length": "long", "block_digest": "string", "source_payload_digest": "string", "source_block_digest": "string", "n_links": "long", "body": "string", "problem": "string", "record": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, record binary): a response record for each page; a null url has no target, a null body is empty, a null key names nothing.

    Ids are hashes of key, url and body, so pages that differ have different ones. Repeated
    rows give a record each, and their places (partition, row) go into their ids; a bit map of
    bounded size tells them from the others. Other columns aren't read; an empty table has no
    records.
    """
    kind = pages.schema[key].dataType.simpleString()
    mark = F.xxhash64(F.col(f"`{key}`").cast("string"), f"`{url}`", f"`{body}`")
    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`").cast("string"), F.col(f"`{body}`").cast("string"), F.xxhash64(mark).alias("_again"))
    alike = pages.select(mark.alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    told = pages.sparkSession.sparkContext.broadcast(bit_map(alike, "mark", REPEATED))

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in text_blocks(batches, 2):
            again = in_bit_map(told.value, np.asarray(b.column(3), np.int64).view(np.uint64))
            out = []
            for k, u, t, twice in zip(*(c.to_pylist() for c in b.columns[:3]), again.tolist(), strict=True):
                out.append(response_record("" if k is None else str(k), u, t, again=f"{part}:{at}" if twice else ""))
                at += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "record"])

    return rows.mapInArrow(f, f"`{key}` {kind}, record binary")


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, record_type, record_id, refers_to, target_uri, ..., problem, record) of the records derived from each response in ``record``.

    A response has a metadata record and, where its media type is of text, a conversion
    record. Null and empty records derive nothing, nor do records of other types. A record
    that is cut, has no id or length, or doesn't match a digest gives one row with
    ``record_type`` invalid, the reason in ``problem`` and nothing else; the others go on. The
    metadata record lists the response's WARC and HTTP headers in order, repeated ones too.
    Repeated rows derive theirs each, an empty table nothing. Columns but the key and
    ``record`` aren't read.
    """
    kind = records.schema[key].dataType.simpleString()

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, 1):
            row, out = [], []
            for i, r in enumerate(b.column(1).to_pylist()):
                try:
                    found = list(derive_record(r or b""))
                except ValueError as e:
                    found = [{"record_type": "invalid", "problem": str(e)}]
                row += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array([d.get(c) for d in out], _ARROW[t]) for c, t in _OUT.items())], [key, *_OUT])

    return records.select(F.col(f"`{key}`"), "record").mapInArrow(f, f"`{key}` {kind}, " + ", ".join(f"{c} {t}" for c, t in _OUT.items()))


def read_warc(spark, path: str) -> DataFrame:
    """(path, seq, record binary, problem) of the records in WARC files, gzip or plain, byte for byte; an empty file has none.

    Where a file can't be read on, a last row has the reason in ``problem`` and a null record;
    what stands before it is whole. A file's packed bytes (2 GB at most, as Spark's reader of
    whole files has it) and one unpacked record are held at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name = b.column(0)[i].as_py()
                row = lambda n, record, problem, name=name: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([record], pa.binary()), pa.array([problem], pa.string())], ["path", "seq", "record", "problem"])
                n = 0
                try:
                    for n, (_, _, record) in enumerate(raw_records(b.column(1)[i].as_py()), 1):
                        yield row(n - 1, record, None)
                except (ValueError, zlib.error) as e:
                    yield row(n, None, str(e))

    return files.mapInArrow(f, "path string, seq long, record binary, problem string")


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Writes ``record`` as .warc.gz files under path, one a task, a gzip member a record; returns (file, records).

    path: a URI that pyarrow's file systems open on executors. A file gets its name when it is
    whole, so a task that is run again replaces its own. Null and empty records aren't written.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, n = f"{root}/part-{task.partitionId():05d}.warc.gz", 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None) as out:
            for b in batches:
                for r in b.column(0).to_pylist():
                    if r:
                        out.write(gzip.compress(r, mtime=0))
                        n += 1
        store.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    return records.select(F.col("record")).mapInArrow(f, "file string, records long")
