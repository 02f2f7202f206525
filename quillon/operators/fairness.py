"""Fairness of answers on comments that mention an identity: what counts as toxic depends on a row's family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec

#: Groups under so many rows are told as too small.
LEAST = 200


def row_stats(rows: DataFrame, boolean: Column, p: str = "p", t: str = "t") -> DataFrame:
    """rows with correct, xent, conf, false_toxic and missed_toxic.

    p: probabilities, t: target probabilities of the answers. Where ``boolean`` is true the
    second answer says toxic, from a probability of one half on; elsewhere answers are
    levels: gold levels up to 1 aren't toxic, from 3 on they are, and so are answers from 3
    on. false_toxic is null unless the gold isn't toxic, missed_toxic unless it is.
    """
    gold, said = vec.argmax(t), vec.argmax(p)
    half = lambda a: F.element_at(a, 2) >= 0.5
    toxic, calm, called = (F.when(boolean, x).otherwise(y) for x, y in ((half(t), gold >= 3), (~half(t), gold <= 1), (half(p), said >= 3)))
    flag = lambda c: c.cast("double")
    return rows.select("*", flag(gold == said).alias("correct"), vec.nll(p, t).alias("xent"), F.array_max(p).alias("conf"), F.when(calm, flag(called)).alias("false_toxic"), F.when(toxic, flag(~called)).alias("missed_toxic"))


def summary(stats: DataFrame, *by: str) -> DataFrame:
    """Rows of ``row_stats`` by group: n, accuracy, xent, and both rates with the rows they are of."""
    mean = {"accuracy": "correct", "xent": "xent", "false_toxic_rate": "false_toxic", "missed_toxic_rate": "missed_toxic"}
    return stats.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in mean.items()], F.count("false_toxic").alias("n_not_toxic"), F.count("missed_toxic").alias("n_toxic"))


def gaps(stats: DataFrame, family: str, identity: Column, least: int = LEAST) -> DataFrame:
    """(family, metric, gap, too_small): the mean of each metric on rows with an identity less that on rows without; null where a group is under ``least`` rows."""
    metrics = ("correct", "xent", "false_toxic", "missed_toxic")
    side = lambda c, on: F.avg(F.when(on, F.col(c)))
    g = stats.groupBy(family).agg(F.count_if(identity).alias("__a"), F.count_if(~identity).alias("__b"), *[(side(c, identity) - side(c, ~identity)).alias(c) for c in metrics])
    small = F.least("__a", "__b") < least
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.when(~small, F.col(c)).alias("gap")) for c in metrics]))
    return g.select(family, small.alias("too_small"), rows.alias("r")).select(family, "r.metric", "r.gap", "too_small")


def category_counts(rows: DataFrame, key: Column, categories: str = "categories", order: str | None = None, *by: str) -> DataFrame:
    """(by, category, comments): identity categories over distinct comments; of the rows of a key the first in ``order`` counts."""
    first = rows.groupBy(*by, key.alias("__key")).agg((F.min_by(categories, order) if order else F.first(categories)).alias("__c"))
    return first.select(*by, F.explode("__c").alias("category")).groupBy(*by, "category").agg(F.count(F.lit(1)).alias("comments"))
