"""Scoring and answers: a pluggable scorer over exploded candidates, softmax per question, answer objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def centroids(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """One row: all labels' mean vectors [(label, v)], by label. Its size is labels x dimensions."""
    dims = rows.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    each = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("v"))
    return each.agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("centroids"))


def few_labels(rows: DataFrame, label: str, most: int = 10_000) -> DataFrame:
    """rows; over ``most`` labels raise, as what has a row a label is broadcast."""
    if rows.select(label).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels")
    return rows


def score_by_centroids(rows: DataFrame, key: str, vector: str, label: str, scale: float = 10.0) -> DataFrame:
    """(key, gold, z, p, t): softmax over scaled cosine to each label's centroid; no shuffle of rows."""
    all_ = F.broadcast(centroids(few_labels(rows, label), vector, label))  # one row: labels, 10,000 at most, x dimensions
    z = F.transform("centroids", lambda c: F.lit(scale) * vec.cosine(F.col(vector), c["v"]))
    out = rows.crossJoin(all_).select(key, F.col(label).alias("gold"), z.alias("z"))
    return out.withColumn("p", vec.softmax("z")).withColumn("t", vec.one_hot(F.size("z"), "gold"))


def answers(df: DataFrame, qtype: str = "qtype") -> DataFrame:
    """df (p, qtype) with answer, confidence and score by question type; sums off by 1e-4 or more raise."""
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    p = F.when(F.abs(total - 1) < 1e-4, F.transform("p", lambda x: x / total)).otherwise(F.raise_error(F.lit("probabilities don't sum to 1")))
    df = df.withColumn("p", p)
    kind = F.col(qtype)
    out = df.withColumn("answer", vec.argmax("p")).withColumn("confidence", F.when(kind == "score", vec.score_confidence("p")).otherwise(vec.choice_confidence("p")))
    return out.withColumn("score", F.when(kind == "score", vec.expected_level("p")).when(kind == "boolean", F.col("p")[1]))


def decide(states: DataFrame, scorer: Scorer, max_questions: int = 64) -> DataFrame:
    """states (state_id, state, questions[id, type, instruction, candidates[id, text]]) to answers re-nested by state.

    scorer: pandas batches (state, instruction, candidate) to the same rows with ``logit``.
    A state and question are scored once however often they repeat. One bad state fails the
    request: 1 to max_questions questions, each with a candidate.
    """
    n = F.size("questions")
    checked = states.where(F.when((n < 1) | (n > max_questions), F.raise_error(F.lit("1 to 64 questions a state"))).otherwise(F.lit(True)).cast("boolean"))
    q = checked.select("state_id", "state", F.posexplode("questions").alias("q", "question")).select("state_id", "state", "q", "question.*")
    c = q.select("state_id", "state", "q", "id", F.col("type").alias("qtype"), "instruction", F.posexplode("candidates").alias("c", "candidate"))
    text = F.col("candidate.text")
    unique = c.select("state", "instruction", text.alias("candidate")).distinct()
    scored = unique.mapInPandas(scorer, "state string, instruction string, candidate string, logit double")
    joined = c.withColumn("text", text).join(scored.withColumnRenamed("candidate", "text"), ["state", "instruction", "text"])
    z = joined.groupBy("state_id", "q", "id", "qtype").agg(F.array_sort(F.collect_list(F.struct("c", "logit", F.col("candidate.id").alias("cid")))).alias("zs"))
    p = z.withColumn("p", vec.softmax(F.transform("zs", lambda s: s["logit"]))).withColumn("candidate_ids", F.transform("zs", lambda s: s["cid"]))
    a = answers(p)
    return a.groupBy("state_id").agg(F.array_sort(F.collect_list(F.struct("q", F.col("id").alias("question"), "qtype", "candidate_ids", "p", "answer", "confidence", "score"))).alias("answers"))


def scored_or_failed(rows: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """rows scored a batch at a time, and row by row where a batch fails, so one bad row doesn't sink the others: (schema, error).

    schema: columns to keep, the scorer's own among them; those are null where it failed.
    """

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield pd.concat(scorer(iter([b]))).assign(error=None)
            except Exception:  # noqa: BLE001 - whatever a scorer raises is told of the rows that raise it
                for i in range(len(b)):
                    one = b.iloc[i : i + 1]
                    try:
                        yield pd.concat(scorer(iter([one]))).assign(error=None)
                    except Exception as e:  # noqa: BLE001
                        yield one.assign(error=f"{type(e).__name__}: {e}")

    names = [c.split()[0] for c in schema.split(", ")]

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in f(batches):
            yield pd.DataFrame({c: x[c] if c in x else pd.Series([None] * len(x), index=x.index, dtype=object) for c in (*names, "error")})

    return rows.mapInPandas(shaped, f"{schema}, error string")
