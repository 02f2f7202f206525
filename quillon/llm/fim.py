"""Fill-in-middle transformation of whole Arrow batches of UTF-8 text.

A batch's texts are one run of bytes, and all its rows are cut at once:

1. a table of 256 classes tells of each byte what it is;
2. the classes of two adjacent bytes tell whether a unit begins between them, which gives one
   mask over the run (the first byte of a text always begins one);
3. the running count of the mask, less its value where a document begins, numbers the units of
   each document from 0;
4. one ``searchsorted`` in that count finds the bytes of all cuts of all rows;
5. outputs are gathered from the run, piece by piece, into one new run.

``restore`` is the inverse: it finds the markers in a run of outputs and gathers the texts back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, quoted
from .shingles import text_blocks

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Bytes gathered at a time: an index of eight bytes a byte is held.
GATHER = 1 << 22

# classes of bytes: continuation of a code point, white space, line feed, others
_TAIL, _SPACE, _LINE, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _TAIL
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0x0A] = _LINE


def _begins(unit: str) -> np.ndarray:
    """By 4 * class of a byte + class of the next one: whether a unit begins at the next one."""
    before, after = np.meshgrid(np.arange(4), np.arange(4), indexing="ij")
    if unit == "char":
        on = after != _TAIL
    elif unit == "word":  # a word and the white space behind it
        blank = lambda c: (c == _SPACE) | (c == _LINE)
        on = blank(before) & ~blank(after)
    elif unit == "line":
        on = before == _LINE
    else:
        raise ValueError(f"unit {unit!r}: char, word or line")
    return on.ravel()


def check_markers(markers: Sequence[str]) -> list[bytes]:
    """The markers as bytes. Outputs can be told apart only if no marker is within another or begins as one ends."""
    raw = [m.encode() for m in markers]
    if len(raw) != 3 or not all(raw):
        raise ValueError("three markers are needed, none empty")
    for i, a in enumerate(raw):
        for j, b in enumerate(raw):
            if (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {markers[i]!r} and {markers[j]!r} overlap")
    return raw


def run_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each row begins in them, with the end behind; nulls are empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def array_of(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """A string array of a run of bytes."""
    return pa.Array.from_buffers(pa.large_utf8(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.utf8())


def unit_counts(raw: np.ndarray, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The running count of unit starts over the run; of each row, the count before it and its number of units."""
    kind = _CLASS[raw]
    mask = np.zeros(len(raw), bool)
    if len(raw):
        mask[1:] = begins[(kind[:-1] << 2) | kind[1:]]
        mask[at[:-1][at[:-1] < at[1:]]] = True
    count = np.cumsum(mask, dtype=np.int64 if len(raw) >> 31 else np.int32)
    ends = np.append(0, count)[at].astype(np.int64)
    return count, ends[:-1], np.diff(ends)


def cut_bytes(count: np.ndarray, base: np.ndarray, n: np.ndarray, end: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Of each row, the byte where its unit number ``cut`` begins, or the row's end where it has just so many."""
    where = np.searchsorted(count, (base + cut + 1).astype(count.dtype), side="left")
    return np.where(cut >= n, end, where)


def found_at(raw: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Bytes of the run where mark begins, whole within a row."""
    if len(raw) < len(mark):
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(raw[: len(raw) - len(mark) + 1] == mark[0])
    for i, byte in enumerate(mark[1:], 1):
        hit = hit[raw[hit + i] == byte]
    row = np.searchsorted(at, hit, side="right") - 1
    return hit[hit + len(mark) <= at[row + 1]]


def gathered(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces [start, start + length) of source, one behind the other."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    i = 0
    while i < len(length):
        base = int(ends[i - 1]) if i else 0
        if length[i] > GATHER:
            out[base : ends[i]] = source[start[i] : start[i] + length[i]]
            i += 1
            continue
        to = max(i + 1, int(np.searchsorted(ends, base + GATHER, side="right")))
        shift = start[i:to] - (np.append(base, ends[i : to - 1]) - base)
        out[base : ends[to - 1]] = source[np.repeat(shift, length[i:to]) + np.arange(int(ends[to - 1]) - base)]
        i = to
    return out


def transform_run(raw: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray, begins: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rows of a run: units, forms, prefix and middle units, outputs and their offsets.

    first, second: any numbers; a row of n units is cut after the smaller and the larger of
    both modulo n + 1. form: the form asked for; empty rows and rows with a marker are plain.
    """
    count, base, n = unit_counts(raw, at, begins)
    a, b = first % (n + 1), second % (n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    form = np.where(n == 0, PLAIN, form)
    for m in marks:
        form[np.searchsorted(at, found_at(raw, at, m), side="right") - 1] = PLAIN
    begin, end = at[:-1], at[1:]
    p, q = (cut_bytes(count, base, n, end, c) for c in (lo, hi))
    source = np.concatenate([raw, *(np.frombuffer(m, np.uint8) for m in marks)])
    mark_at = len(raw) + np.cumsum([0, *(len(m) for m in marks)])
    rows = len(n)
    start, length = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    plain = form == PLAIN
    start[plain, 0], length[plain, 0] = begin[plain], (end - begin)[plain]
    spans = ((begin, p), (q, end), (p, q))  # prefix, suffix, middle as the markers stand
    for which, order in ((PSM, (0, 1, 2)), (SPM, (1, 0, 2))):
        own = form == which
        for place, part in enumerate(order):
            start[own, 2 * place], length[own, 2 * place] = mark_at[part], len(marks[part])
            start[own, 2 * place + 1], length[own, 2 * place + 1] = spans[part][0][own], (spans[part][1] - spans[part][0])[own]
    out_at = np.append(0, np.cumsum(length.sum(axis=1)))
    return n, form, lo, hi - lo, gathered(source, start.ravel(), length.ravel()), out_at


def restore_run(raw: np.ndarray, at: np.ndarray, form: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a run of outputs, and their offsets. A row without its three markers in their order raises ValueError."""
    begin, end = at[:-1], at[1:]
    cut = form != PLAIN
    where = []
    for m in marks:
        hit = found_at(raw, at, m)
        row = np.searchsorted(at, hit, side="right") - 1
        row, hit = row[cut[row]], hit[cut[row]]
        place = np.full(len(form), -1, np.int64)
        place[row] = hit
        if len(row) != len(np.unique(row)) or (place[cut] < 0).any():
            raise ValueError("an output hasn't each marker once")
        where.append(place)
    wp, ws, wm = where
    p, s, m = (len(x) for x in marks)
    psm = form == PSM
    lead, then = np.where(psm, wp, ws), np.where(psm, ws, wp)
    if (lead[cut] != begin[cut]).any() or (then[cut] > wm[cut]).any():
        raise ValueError("the markers of an output aren't in their form's order")
    start, length = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    start[:, 0] = np.where(cut, wp + p, begin)
    length[:, 0] = np.where(cut, np.where(psm, ws, wm), end) - start[:, 0]
    start[:, 1] = np.where(cut, wm + m, end)
    length[:, 1] = end - start[:, 1]
    start[:, 2] = np.where(cut, ws + s, end)
    length[:, 2] = np.where(cut, np.where(psm, wm, wp), end) - start[:, 2]
    return gathered(raw, start.ravel(), length.ravel()), np.append(0, np.cumsum(length.sum(axis=1)))


def fill_in_middle(docs: DataFrame, first: Column, second: Column, form: Column, text: str = "text", unit: str = "char", markers: Sequence[str] = MARKERS) -> DataFrame:
    """Adds n, form, prefix_units, middle_units and output to the rows of docs.

    Texts are cut into n units: code points (``char``), words with the white space behind them
    (``word``) or lines (``line``). first and second are non-negative longs; the prefix ends
    after the smaller of both modulo n + 1 units, the middle after the larger one. form is
    ``plain``, ``psm`` or ``spm``; anything else, null too, is plain, as is an empty text and
    one that holds a marker. The counts of a plain row are null and its output is the text.

    A null text is empty (n 0, output empty). Repeated rows are alike, an empty table gives an
    empty one. Columns of docs with the names of the new ones are replaced. Texts of any length
    are cut whole; beside other rows a task holds one block of about two MB of text, or one
    longer text, and about six bytes a byte of it. Nothing is shuffled.
    """
    marks, begins, added = check_markers(markers), _begins(unit), ["n", "form", "prefix_units", "middle_units", "output"]
    keep = [c for c in docs.columns if c.lower() not in added]
    a, b, f, t = fresh(docs, "first", "second", "form", "text")
    number = lambda x: F.when(x >= 0, x).otherwise(F.lit(0)).cast("long")
    code = F.when(form == FORMS[PSM], F.lit(PSM)).when(form == FORMS[SPM], F.lit(SPM)).otherwise(F.lit(PLAIN)).cast("long")
    rows = docs.select(F.col(f"`{text}`").cast("string").alias(t), number(first).alias(a), number(second).alias(b), code.alias(f), *[F.col(c) for c in quoted(keep)])
    schema = T.StructType([*rows.select(quoted(keep)).schema.fields, T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, 0):
            raw, at = run_of(b.column(0))
            asked = [b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            n, form, prefix, middle, out, out_at = transform_run(raw, at, *asked, begins, marks)
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), array_of(out, out_at)], [*keep, *added])

    return rows.mapInArrow(cut, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form", markers: Sequence[str] = MARKERS, into: str = "restored") -> DataFrame:
    """Adds ``into``, the text from which an output of a form was made; a null output gives an empty text, other forms than psm and spm the output itself."""
    marks = check_markers(markers)
    keep = [c for c in rows.columns if c.lower() != into.lower()]
    t, f = fresh(rows, "output", "form")
    asked = rows.select(F.col(f"`{output}`").alias(t), F.when(F.col(f"`{form}`") == "psm", PSM).when(F.col(f"`{form}`") == "spm", SPM).otherwise(PLAIN).cast("long").alias(f), *[F.col(c) for c in quoted(keep)])
    schema = T.StructType([*rows.select(quoted(keep)).schema.fields, T.StructField(into, T.StringType())])

    @lean
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, 0):
            raw, at = run_of(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], array_of(*restore_run(raw, at, b.column(1).to_numpy(zero_copy_only=False), marks))], [*keep, into])

    return asked.mapInArrow(back, schema)
