"""Token ids of a tokenizer file, segment by segment, so that paths with a segment in common begin alike."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts encoded at once.
AT_ONCE = 64


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The tokenizer of a file that every worker can open, read once a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: Column | str, path: str) -> Column:
    """The ids of a text by itself, without special tokens; null for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        tok, known, ids = _tokenizer(path), texts.dropna().tolist(), []
        for at in range(0, len(known), AT_ONCE):  # an encoding takes many times its ids
            ids += [e.ids for e in tok.encode_batch(known[at : at + AT_ONCE], add_special_tokens=False)]
        found = iter(ids)
        return texts.map(lambda t: None if t is None else next(found))

    return encode(text)


def segment_token_ids(segments: Column, path: str) -> Column:
    """The ids of an array of texts, each encoded by itself, one behind the other; null segments have none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(rows: pd.Series) -> pd.Series:
        tok = _tokenizer(path)
        return rows.map(lambda row: None if row is None else [i for s in row if s is not None for i in tok.encode(s, add_special_tokens=False).ids])

    return encode(segments)
