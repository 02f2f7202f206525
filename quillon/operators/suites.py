"""Evaluation suites: cases (suite, id, state, qtype, instruction, options, gold) made from rows, scored in batches, summed up by suite and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import vec
from quillon.functions.hashing import draw
from quillon.operators.scoring import Scorer, scored_or_failed


def first_cases(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """The first rows of each suite, by key; Spark cuts each task's rows before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(key))).where(F.col("__rn") <= most).drop("__rn")


def shown_options(gold: Column, labels: Column, key: Column, most: int, seed: int = 99) -> Column:
    """The gold label and most - 1 others drawn by the row's key, in an order drawn by it too. labels: all of them, a bounded array."""
    h = lambda s, c: draw(1_000_000_007, F.lit(s), key, c)
    ranked = F.array_sort(F.transform(labels, lambda c: F.struct(F.when(c == gold, F.lit(-1).cast("long")).otherwise(h(seed, c)).alias("h"), c.alias("c"))))
    order = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda s: F.struct(h(seed + 1, s["c"]).alias("h"), s["c"].alias("c"))))
    return F.transform(order, lambda s: s["c"])


def label_suites(rows: DataFrame, prefix: str, language: str, key: str, text: str, label: str, instruction: str, options: int = 20, most: int = 300, limit: int = 1000) -> DataFrame:
    """A suite per language: choose the label among ``options`` of all labels; over ``limit`` labels raise."""
    found = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(limit + 1).collect()]  # bounded
    if len(found) > limit:
        raise ValueError(f"more than {limit} labels")
    some = first_cases(rows.where(F.col(label).isNotNull() & F.col(language).isNotNull()), language, key, most)
    shown = shown_options(F.col(label), F.array(*map(F.lit, found)), F.col(key), options)
    out = some.select(F.concat_ws("-", F.lit(prefix), language).alias("suite"), F.col(key).cast("string").alias("id"), F.col(text).alias("state"), F.lit("choice").alias("qtype"), F.lit(instruction).alias("instruction"), shown.alias("options"), F.col(label).alias("answer"))
    return out.select("suite", "id", "state", "qtype", "instruction", "options", (F.array_position("options", F.col("answer")) - 1).cast("int").alias("gold"))


def fixed_suite(rows: DataFrame, suite: Column | str, key: str, state: Column, qtype: str, instruction: str, options: list[str], gold: Column, most: int = 300) -> DataFrame:
    """A suite, or one per value of a column, with the same options for every case; rows without a gold answer in range are left out."""
    named = F.lit(suite) if isinstance(suite, str) else suite
    cases = rows.select(named.alias("suite"), F.col(key).alias("__key"), state.alias("state"), F.lit(qtype).alias("qtype"), F.lit(instruction).alias("instruction"), F.array(*map(F.lit, options)).alias("options"), gold.cast("int").alias("gold"))
    cases = cases.where(F.col("gold").between(0, len(options) - 1) & F.col("suite").isNotNull())
    return first_cases(cases, "suite", "__key", most).select("suite", F.col("__key").cast("string").alias("id"), "state", "qtype", "instruction", "options", "gold")


def score(cases: DataFrame, scorer: Scorer) -> DataFrame:
    """(suite, id, qtype, gold, p, error): probabilities of every case's options; a case that the scorer fails on has an error and no p.

    scorer: pandas batches (id, state, instruction, options, ...) to the same rows with ``logits``.
    """
    schema = "suite string, id string, qtype string, gold int, logits array<double>"
    return scored_or_failed(cases, scorer, schema).select("suite", "id", "qtype", "gold", F.when(F.col("logits").isNotNull(), vec.softmax("logits")).alias("p"), "error")


def summarise(scored: DataFrame) -> DataFrame:
    """By suite: cases, failures, accuracy, hard NLL and Brier of the answered ones."""
    ok = F.col("p").isNotNull()
    hit = F.when(ok, (vec.argmax("p") == F.col("gold")).cast("double"))
    nll = F.when(ok, -F.log(F.greatest(F.element_at("p", F.col("gold") + 1), F.lit(vec.EPS))))
    brier = F.when(ok, vec.brier("p", vec.one_hot(F.size("p"), "gold")))
    return scored.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("failed"), F.avg(hit).alias("accuracy"), F.avg(nll).alias("nll"), F.avg(brier).alias("brier"))


def macro(summary: DataFrame, prefix: str) -> DataFrame:
    """One row: suites whose name begins with prefix, and the plain mean of their accuracies."""
    return summary.where(F.startswith("suite", F.lit(prefix))).agg(F.count(F.lit(1)).alias("suites"), F.avg("accuracy").alias("macro_accuracy"))


def dry_run(cases: DataFrame, per_token: float, overhead: int = 16, chars: float = 4.0) -> DataFrame:
    """By suite: cases, tokens estimated from characters, and what they would cost; nothing is sent."""
    n = F.ceil((F.length("state") + F.length("instruction") + F.aggregate("options", F.lit(0), lambda a, o: a + F.length(o))) / chars) + overhead
    return cases.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("tokens"), (F.sum(n) * per_token).alias("cost"))
