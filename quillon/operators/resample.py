"""Bootstraps on sufficient statistics: rows are summed by group first; draws are hashes of (draw, group)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import draw
from quillon.sources.files import staged

#: Pairs of a group and a draw that one task meets, about.
PAIRS = 20_000_000

#: Cumulative shares of how often a group is drawn (Poisson of mean 1), in millionths.
SHARES = [int(1e6 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(7)]


def group_sums(rows: DataFrame, group: str, **sums: Column) -> DataFrame:
    """(g, n, sums): one row per group. A group's rows are drawn together."""
    return rows.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def times(seed: int) -> Column:
    """How often draw b takes group g: Poisson of mean 1 by a hash, so groups need no numbers and no draw needs all groups."""
    u = draw(1_000_000, F.lit(seed), F.col("b"), F.col("g"))
    return sum((F.when(u >= s, 1).otherwise(0) for s in SHARES[1:]), F.when(u >= SHARES[0], 1).otherwise(0)).cast("double")


def _each_draw(sums: DataFrame, draws: int, seed: int) -> DataFrame:
    """Each group with each draw b and how often that takes it, in as many tasks as these pairs ask for: sums are few bytes, so their size says nothing of the work."""
    kept = staged(sums, "sums")
    parts = max(kept.sparkSession.sparkContext.defaultParallelism, -(-kept.count() * draws // PAIRS))
    return kept.repartition(parts).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("times", times(seed))


def bootstrap(sums: DataFrame, statistic: Column, draws: int = 500, seed: int = 0, least: int = 5) -> DataFrame:
    """(lo, hi, p_below): percentiles 2.5 and 97.5 and share at or below 0 of statistic over resampled groups; null under ``least`` groups.

    statistic: a Column of the summed columns. Each group meets each draw in its own task
    and draws are summed before the shuffle, which holds one row a draw and task.
    """
    columns = [c for c in sums.columns if c != "g"]
    each = _each_draw(sums, draws, seed)
    totals = each.groupBy("b").agg(F.count(F.lit(1)).alias("groups"), *[F.sum(F.col(c) * F.col("times")).alias(c) for c in columns])
    stat = totals.where(F.col("groups") >= least).select(statistic.alias("stat"))
    return stat.agg(F.percentile("stat", F.lit(0.025)).alias("lo"), F.percentile("stat", F.lit(0.975)).alias("hi"), F.avg((F.col("stat") <= 0).cast("double")).alias("p_below"))


def gap(a: DataFrame, b: DataFrame, statistic: Column, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(lo, hi, p_below) of the statistic of a less that of b, each resampled by itself. a, b: group sums."""

    def side(sums: DataFrame, at: int, name: str) -> DataFrame:
        columns = [c for c in sums.columns if c != "g"]
        each = _each_draw(sums, draws, at)
        return each.groupBy("b").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in columns]).select("b", statistic.alias(name))

    both = side(a, seed, "x").join(side(b, seed + 1, "y"), "b").select((F.col("x") - F.col("y")).alias("stat"))
    return both.agg(F.percentile("stat", F.lit(0.025)).alias("lo"), F.percentile("stat", F.lit(0.975)).alias("hi"), F.avg((F.col("stat") <= 0).cast("double")).alias("p_below"))
