"""Metrics of probabilistic answers, one grouped aggregate each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec


def hit(p="p", t="t") -> Column:
    return (vec.argmax(p) == vec.argmax(t)).cast("double")


def summarize(pred: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, nll, brier, entropy by rollup of the columns given."""
    rows = pred.select(*by, hit().alias("hit"), vec.nll("p", "t").alias("nll"), vec.brier("p", "t").alias("brier"), vec.entropy("p").alias("ent"))
    g = rows.rollup(*by) if by else rows.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("ent").alias("entropy"))


def ece(pairs: DataFrame, *by: str, variant: str = "a", bins: int = 15) -> DataFrame:
    """Expected calibration error of (conf, ok). Bins: a [lo, hi) and the last closed; b (lo, hi] without 0; c (lo, hi] with 0 in the first."""
    at = {"a": F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)), "b": F.ceil(F.col("conf") * bins) - 1, "c": F.greatest(F.ceil(F.col("conf") * bins) - 1, F.lit(0))}[variant]
    each = pairs.withColumn("bin", at).where("bin >= 0").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), F.sum("ok").alias("o"))
    total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("all"))
    joined = each.join(total, list(by)) if by else each.crossJoin(F.broadcast(total))  # one row
    return joined.groupBy(*by).agg(F.sum(F.abs(F.col("c") - F.col("o")) / F.col("all")).alias("ece"))


def reliability(pairs: DataFrame, *by: str, sigma: float = 0.05, points: int = 201) -> DataFrame:
    """Smoothed (grid point, density, mean confidence, accuracy), a Gaussian kernel reflected at 0 and 1.

    Confidences are first counted by value, so rows meet the grid once per distinct one.
    """
    seen = pairs.groupBy(*by, "conf").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))
    k = lambda d: F.exp(-0.5 * (d / sigma) * (d / sigma))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / float(points - 1))).alias("g")
    rows = seen.select("*", grid).withColumn("w", k(F.col("g") - F.col("conf")) + k(F.col("g") + F.col("conf")) + k(F.col("g") - (2 - F.col("conf"))))
    return rows.groupBy(*by, "g").agg(F.sum(F.col("w") * F.col("n")).alias("density"), (F.sum(F.col("w") * F.col("conf") * F.col("n")) / F.sum(F.col("w") * F.col("n"))).alias("confidence"), (F.sum(F.col("w") * F.col("ok")) / F.sum(F.col("w") * F.col("n"))).alias("accuracy"))


def smooth_ece(pairs: DataFrame, *by: str, sigma: float = 0.05, points: int = 201) -> DataFrame:
    r = reliability(pairs, *by, sigma=sigma, points=points)
    return r.groupBy(*by).agg((F.sum(F.col("density") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("density")).alias("smooth_ece"))


def pairs_of(pred: DataFrame, *keep: str, boolean: bool = False) -> DataFrame:
    conf, ok = vec.calibration_pair("p", "t", boolean)
    return pred.select(*keep, conf.alias("conf"), ok.alias("ok"))


def base_rates(train: DataFrame, *by: str) -> DataFrame:
    """(by, k, base): elementwise mean target."""
    each = train.select(*by, F.size("t").alias("k"), F.posexplode("t").alias("i", "x")).groupBy(*by, "k", "i").agg(F.avg("x").alias("m"))
    return each.groupBy(*by, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("base"))


def brier_skill(pred: DataFrame, base: DataFrame, *by: str) -> DataFrame:
    """Skill over base rates on covered rows, and the share covered."""
    rows = pred.withColumn("k", F.size("t")).join(base, [*by, "k"], "left")
    m, b = vec.brier("p", "t"), vec.brier("base", "t")
    rows = rows.select(*by, F.when(F.col("base").isNotNull(), m).alias("m"), F.when(F.col("base").isNotNull(), b).alias("b"))
    return rows.groupBy(*by).agg((1 - F.avg("m") / F.greatest(F.avg("b"), F.lit(1e-12))).alias("skill"), (F.count("b") / F.count(F.lit(1))).alias("coverage"))


def temperature_grid(n: int = 121, lo: float = 0.25, hi: float = 4.0) -> list[float]:
    return [math.exp(math.log(lo) + i * (math.log(hi) - math.log(lo)) / (n - 1)) for i in range(n)]


def fit_temperature(pred: DataFrame, *by: str, grid: list[float] | None = None) -> DataFrame:
    """The grid's temperature of least mean NLL of softmax(z / T), the smallest on ties."""
    ts = F.array(*[F.lit(t) for t in (grid or temperature_grid())])
    rows = pred.select(*by, "z", "t", F.explode(ts).alias("temperature"))
    loss = rows.withColumn("nll", vec.nll(vec.softmax("z", F.col("temperature")), "t")).groupBy(*by, "temperature").agg(F.avg("nll").alias("nll"))
    best = loss.groupBy(*by).agg(F.min(F.struct(F.round("nll", 12).alias("nll"), "temperature")).alias("best"))
    return best.select(*by, F.col("best.temperature").alias("temperature"), F.col("best.nll").alias("nll"))


def macro_f1(pred: DataFrame, gold: str, answer: str, *by: str) -> DataFrame:
    """Mean over classes seen as gold or answer of 2tp / (2tp + fp + fn)."""
    g = pred.select(*by, F.col(gold).alias("c"), (F.col(gold) == F.col(answer)).cast("long").alias("tp"), (F.col(gold) != F.col(answer)).cast("long").alias("miss"))
    a = pred.select(*by, F.col(answer).alias("c"), F.lit(0).cast("long").alias("tp"), (F.col(gold) != F.col(answer)).cast("long").alias("miss"))
    c = g.unionAll(a).groupBy(*by, "c").agg(F.sum("tp").alias("tp"), F.sum("miss").alias("miss"))
    return c.groupBy(*by).agg(F.avg(2.0 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("miss"))).alias("macro_f1"))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z of two shares; 0 without spread."""
    pool = (x1 + x2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2))
    return F.when(se > 0, (x1 / n1 - x2 / n2) / se).otherwise(0.0)


def floor_gate(rows: DataFrame, floor_n: int, floor_tv: float, floor_changed: int, critical: float = 1.645) -> DataFrame:
    """rows (n, n_nonfinite, tv_max, n_argmax_diff) with z and verdict: pass, at floor, or no."""
    z = two_proportion_z(F.col("n_argmax_diff").cast("double"), F.col("n").cast("double"), F.lit(float(floor_changed)), F.lit(float(floor_n)))
    bad = (F.col("n_nonfinite") > 0) | (F.col("tv_max") > floor_tv)
    return rows.withColumn("z", z).withColumn("verdict", F.when(bad | (F.col("z") > critical), "no").when(F.col("z") < -critical, "pass").otherwise("at floor"))
