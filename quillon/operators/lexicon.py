"""Whole-word matching of a lexicon: one automaton for all terms, one pass over each text.

Terms may have several words and any characters; case doesn't count. A term is found where
a word boundary is at both of its ends. The automaton is built once a worker for each lot of
terms, of LOT at most, so a lexicon may have any size; its terms come as a table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of one automaton, at most, about: it bounds a broadcast. More are matched in several passes.
LOT = 500_000

# Identity groups and their surface terms.
IDENTITY = {
    "gender": ("woman", "women", "man", "men", "female", "male", "girl", "girls", "boy", "boys", "wife", "husband", "mother", "father", "transgender", "trans", "nonbinary", "non-binary"),
    "sexual orientation": ("gay", "gays", "lesbian", "lesbians", "bisexual", "homosexual", "homosexuals", "queer", "lgbt", "lgbtq", "heterosexual", "straight"),
    "religion": ("christian", "christians", "catholic", "catholics", "protestant", "jew", "jews", "jewish", "muslim", "muslims", "islam", "islamic", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists", "sikh", "mormon", "evangelical"),
    "race / ethnicity": ("black", "blacks", "white", "whites", "asian", "asians", "latino", "latina", "latinos", "hispanic", "hispanics", "african", "africans", "arab", "arabs", "mexican", "mexicans", "chinese", "indian", "indians", "native american", "indigenous"),
    "disability": ("disabled", "disability", "disabilities", "wheelchair", "blind", "deaf", "autistic", "autism", "mentally ill", "mental illness", "schizophrenic", "bipolar", "retarded", "handicapped"),
}


def identity_lexicon(spark) -> DataFrame:
    """(term, category) of the identity groups."""
    return spark.createDataFrame([(t, c) for c, terms in IDENTITY.items() for t in terms], "term string, category string")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("ſ", "s")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(text: str, at: int) -> bool:
    return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))


@functools.lru_cache(maxsize=2)
def _automaton(entries: tuple[tuple[str, str], ...]):
    found: dict[str, list[tuple[str, str]]] = {}
    for term, category in entries:
        found.setdefault(folded(term), []).append((term, category))
    out = ahocorasick.Automaton()
    for low, own in found.items():
        out.add_word(low, (len(low), own))
    out.make_automaton()
    return out


def matches(text: str, entries: tuple[tuple[str, str], ...]) -> Iterator[tuple[int, str, str]]:
    """(start, term, category) of every whole-word occurrence, overlapping ones too."""
    low = folded(text)
    for end, (size, own) in _automaton(entries).iter(low):
        start = end - size + 1
        if _edge(low, start) and _edge(low, end + 1):
            for term, category in own:
                yield start, term, category


def _lots(lexicon: DataFrame, term: str, category: str):
    terms = lexicon.select(F.col(term).alias("term"), F.col(category).cast("string").alias("category")).where("term <> '' AND category IS NOT NULL").distinct()
    lots = -(-terms.count() // LOT)
    for lot in range(lots):
        own = terms if lots == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(lots)) == lot)
        yield lexicon.sparkSession.sparkContext.broadcast(tuple(sorted(map(tuple, own.collect()))))  # about LOT terms


def mentions(docs: DataFrame, lexicon: DataFrame, key: str, text: str, term: str = "term", category: str = "category") -> DataFrame:
    """(key, start long, term, category): every occurrence of every term; null texts have none."""
    kind = docs.schema[key].dataType
    out = docs.sparkSession.createDataFrame([], T.StructType().add(key, kind).add("start", "long").add("term", "string").add("category", "string"))
    for i, told in enumerate(_lots(lexicon, term, category)):

        def f(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, hits = [], []
                for j, t in enumerate(b.column(1).to_pylist()):
                    if t:
                        own = list(matches(t, told.value))
                        hits += own
                        row += [j] * len(own)
                start, terms, cats = zip(*hits, strict=True) if hits else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(terms, pa.string()), pa.array(cats, pa.string())], [key, "start", "term", "category"])

        found = docs.select(key, F.col(text).cast("string")).mapInArrow(f, out.schema)
        out = found if i == 0 else out.unionAll(found)
    return out


def with_categories(docs: DataFrame, lexicon: DataFrame, text: str, into: str = "categories", term: str = "term", category: str = "category") -> DataFrame:
    """docs with the sorted categories of the terms that each text has; an empty list for null texts. No row is shuffled."""
    keep = [c for c in docs.columns if c != into]
    out = docs.select(*keep, F.expr("CAST(array() AS array<string>)").alias(into))
    for told in _lots(lexicon, term, category):
        names = ["__text", into, *keep]

        def f(batches: Iterator[pa.RecordBatch], told=told, names=names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                had = b.column(1).to_pylist()
                found = [sorted({c for _, _, c in matches(t, told.value)} | set(h)) if t else h for t, h in zip(b.column(0).to_pylist(), had, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *b.columns[2:]], names[1:])

        rows = out.select(F.col(text).cast("string").alias("__text"), into, *keep)
        out = rows.mapInArrow(f, T.StructType(rows.schema.fields[1:])).select(*keep, into)
    return out
