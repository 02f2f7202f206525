"""Prefix trees of token paths under one state: what paths have in common is one node a token."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tree_of(paths: list[np.ndarray]) -> pd.DataFrame:
    """(enter, leave, position, token, paths) of the tree's nodes, in the order of a walk that goes down first: enter numbers a node, leave is the last number below it, paths how many go through."""
    enter, leave, token, position, through = [], [], [], [], []
    open_: list[int] = []
    before = np.zeros(0, np.int64)
    for path in sorted(paths, key=lambda p: p.tolist()):
        n = min(len(path), len(before))
        apart = np.flatnonzero(path[:n] != before[:n])
        same = int(apart[0]) if len(apart) else n
        for node in open_[same:]:
            leave[node] = len(enter) - 1
        del open_[same:]
        for node in open_:
            through[node] += 1
        for i in range(same, len(path)):
            open_.append(len(enter))
            enter.append(len(enter)), leave.append(0), token.append(int(path[i])), position.append(i), through.append(1)
        before = path
    for node in open_:
        leave[node] = len(enter) - 1
    return pd.DataFrame({"enter": enter, "leave": leave, "position": position, "token": token, "paths": through}, dtype="int64")


def prefix_tree(paths: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, enter, leave, position, token, paths): the nodes of the prefix tree of each key's arrays of token ids.

    A state's paths are one task's, as they are one forward pass of a scorer: packs keep
    within a budget of tokens. Null arrays are no paths, empty ones have no nodes, repeated
    paths go through the same nodes.
    """
    kind = paths.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("enter", "leave", "position", "token", "paths")]])

    def f(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = tree_of([np.asarray(x, np.int64) for x in pdf["__ids"]])
        tree.insert(0, key, names[0])
        return tree

    return paths.where(F.col(ids).isNotNull()).select(key, F.col(ids).alias("__ids")).groupBy(key).applyInPandas(f, out)


def sees(enter: Column, other_enter: Column, other_leave: Column) -> Column:
    """Whether a token sees another one: it lies in the other's interval, so the other is before it on each of its paths, or it itself."""
    return enter.between(other_enter, other_leave)


def shared(tree: DataFrame, key: str) -> DataFrame:
    """(key, tokens, distinct_tokens, visible): tokens of all paths, those that are computed, and pairs of a computed token and one that it sees."""
    return tree.groupBy(key).agg(F.sum("paths").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"), F.sum(F.col("position") + 1).alias("visible"))
