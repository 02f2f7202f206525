"""Mixing sources to target weights by entropy balancing.

Each source is to give a number of words. Of all document rates between 0 and a cap
that meet a source's number, entropy balancing takes those nearest to rate 1 in
relative entropy; these are exponentially tilted, ``r = min(cap, exp(lambda * z))`` with
``z`` the document's size over its source's mean size. The multipliers are the roots of
the gradient of a convex dual, found by Newton steps kept inside a shrinking bracket.

Documents of one source and size have one rate, so the dual is summed over staged counts
by (source, size), never over documents again, and it falls into a part for each source. A
Newton step is one job for all sources: gradient and curvature are grouped sums of partial
sums, and the next multipliers follow from them, in a table of one row a source. So no task
holds a source, and what reaches the driver is a few numbers, however many sources there are.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.operators.dataset import ordered_rank

from .common import done_with, n_words, quoted, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
#: Sources whose table is broadcast, at most; a larger one is joined by hash or sort.
FEW = 100_000


def source_targets(tops: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """tops (source, total) with src (long, the source's number in code-point order, null last) and target: the words that it is to give.

    Targets are in proportion to repeating weights and stop at cap times the source's
    total, the excess going to the others by weight until none is above: then the ones
    that aren't full have one level, target over weight, which the rounds raise. A round
    is two sums over sources.
    """
    named = ordered_rank(tops.where("source is not null"), "source").withColumnRenamed("rank", "src")
    none = tops.where("source is null").crossJoin(F.broadcast(tops.agg(F.count("source").alias("src"))))  # one row each
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    rows = stage(named.unionByName(none).withColumn("weight", weight), "mix-sources")
    all_ = rows.agg(F.sum("total").alias("words"), F.sum("weight").alias("weight")).first()
    words, weighed, filled = share * (all_.words or 0), all_.weight or 0.0, -1
    level = words / weighed if weighed else 0.0
    while True:
        full = F.col("weight") * level > cap * F.col("total")
        got = rows.where(full).agg(F.count(F.lit(1)).alias("n"), F.sum(cap * F.col("total")).alias("words"), F.sum("weight").alias("weight")).first()
        if got.n == filled:
            return rows.withColumn("target", F.when(full, cap * F.col("total")).otherwise(F.col("weight") * level).cast("double"))
        filled, left = got.n, weighed - (got.weight or 0.0)
        level = (words - (got.words or 0)) / left if left > 1e-9 * weighed else math.inf


#: Newton steps at most (each also halves a bracket where the step leaves it), and how near a source's words must come to its target.
STEPS, NEAR = 200, 1e-10


def newton_rates(counts: DataFrame, cap: float = CAP, few: int | None = None) -> DataFrame:
    """counts (src, size, n, target; sizes over 0, one row a source and size) with rate: those that give each source's target.

    A target of 0 or less gives rates 0, one of cap times the source's words or more gives
    cap. counts are read once a step, so a staged table is meant. Up to ``few`` multipliers
    are told to all tasks; more are joined.
    """
    few = FEW if few is None else few
    top = math.log(cap)
    total = F.sum(F.col("size").cast("double") * F.col("n"))
    first = counts.groupBy("src").agg(total.alias("total"), F.sum("n").cast("double").alias("docs"), F.min("size").cast("double").alias("least"), F.first("target").alias("target"))
    mean = F.col("total") / F.col("docs")
    ends = F.when(F.col("target") <= 0, -1).when(F.col("target") >= cap * F.col("total") * (1 - 1e-12), 1).otherwise(0)
    state = first.select("src", mean.alias("mean"), (F.col("target") / mean).alias("want"), F.lit(0.0).alias("lam"), (-2000.0 * mean / F.col("least")).alias("lo"), (top * mean / F.col("least")).alias("hi"), ends.alias("ends"), (ends != 0).alias("done"))
    state = stage(state, "mix-state")
    told = lambda df: F.broadcast(df) if small else df  # noqa: E731 - ``few`` rows at most
    small = state.limit(few + 1).count() <= few
    z = F.col("size") / F.col("mean")
    rate = F.exp(F.least(F.col("lam") * z, F.lit(top)))
    for _ in range(STEPS):
        if not state.where("not done").limit(1).count():
            break
        rows = counts.select("src", "size", "n").join(told(state.where("not done").select("src", "mean", "lam")), "src")
        sums = rows.groupBy("src").agg(F.sum(F.col("n") * z * rate).alias("got"), F.sum(F.when(F.col("lam") * z < top, F.col("n") * z * z * rate)).alias("bend"))
        miss = F.col("got") - F.col("want")
        met = state.join(told(sums), "src", "left").withColumn("miss", miss)
        met = met.withColumn("lo", F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("miss") >= 0, F.col("lam")).otherwise(F.col("hi")))
        over = (F.abs("miss") <= NEAR * F.col("want")) | (F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.lit(1.0), F.abs("lo")))
        step = F.col("lam") - F.col("miss") / F.col("bend")
        step = F.when((F.col("bend") > 0) & (step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = met.select("src", "mean", "want", F.when(F.col("done") | over, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", "ends", (F.col("done") | over).alias("done"))
        before, state = state, stage(new, "mix-state")
        done_with(before)
    out = counts.join(told(state.select("src", "mean", "lam", "ends")), "src")
    return out.select(*counts.columns, F.when(F.col("ends") < 0, 0.0).when(F.col("ends") > 0, float(cap)).otherwise(rate).alias("rate"))


def _copies(cap: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rates and copies of each size of one source: largest first, what rounding leaves over is carried to the next smaller size."""
        pdf = pdf.sort_values("size", ascending=False)
        out, carry = [], 0.0
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            want = rate * n
            k = min(max(int(math.floor(want + carry / size + 0.5)), 0), cap * n)
            carry += (want - k) * size
            out.append(k)
        return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "all": pdf["n"], "copies": out, "rate": pdf["rate"]})

    return f


def mix(docs: DataFrame, size: Column | None = None, key: str = "doc_id", source: str = "source", share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, buckets: int = 1024) -> DataFrame:
    """docs with size, source_size, target, rate and copies (int, 0 to cap) beside their own columns.

    size: words of ``text`` unless given. Null sources are one source, null texts and
    texts without words have size 0 and no copies, an empty table gives an empty table.
    Repeated rows are rows of their own. Columns of docs named like the new ones are
    replaced; any others, whatever their names, are carried in one struct and clash with
    nothing. Within a source and size, copies go to documents by (hash of key, key): reruns
    agree.
    """
    new = ["size", "source_size", "target", "rate", "copies"]
    own = [c for c in docs.columns if c.lower() not in new]
    size = n_words(F.col("text")) if size is None else size
    salt = F.xxhash64(F.col(key), F.lit("mix"))
    d = docs.select(F.struct(*quoted(own)).alias("doc"), F.col(source).alias("source"), F.col(key).alias("key"), salt.alias("salt"), size.cast("long").alias("size"))
    d = d.withColumn("bucket", F.pmod("salt", F.lit(buckets)).cast("int"))
    slim = stage(d.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    tops = stage(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), "mix-totals")
    sources = source_targets(tops, share, weights, cap).select("src", F.col("source").alias("name"), F.col("total").alias("source_size"), "target")
    sources = stage(sources, "mix-targets")
    small = sources.limit(FEW + 1).count() <= FEW
    told = lambda df: F.broadcast(df) if small else df  # noqa: E731 - FEW rows at most
    coded = slim.join(told(sources.select("src", "name")), F.col("source").eqNullSafe(F.col("name"))).select("src", "size", "bucket", "n").where("size > 0")
    counts = stage(coded.groupBy("src", "size").agg(F.sum("n").alias("n")).join(told(sources.select("src", "target")), "src"), "mix-counts")
    classes = newton_rates(counts, cap).groupBy("src").applyInPandas(_copies(cap), "src long, size long, all long, copies long, rate double")
    classes = stage(classes, "mix-classes")
    # every copy beyond the whole ones of a class goes to one document; buckets get theirs by running counts
    sub = coded.groupBy("src", "size", "bucket").agg(F.sum("n").alias("n")).join(classes, ["src", "size"])
    sub = sub.withColumn("upto", F.sum("n").over(W.partitionBy("src", "size").orderBy("bucket"))).withColumn("more", F.expr("copies % all"))
    extra = F.expr("((upto * more) div all) - (((upto - n) * more) div all)")
    sub = sub.select("src", "size", "bucket", "rate", F.expr("copies div all").alias("base"), extra.alias("extra"))
    coded_docs = d.join(told(sources), F.col("source").eqNullSafe(F.col("name"))).select("doc", "key", "salt", "size", "bucket", "src", "source_size", "target")
    at = F.row_number().over(W.partitionBy("src", "size", "bucket").orderBy("salt", "key"))
    out = coded_docs.withColumn("at", at).join(sub.hint("merge"), ["src", "size", "bucket"], "left")
    copies = F.coalesce(F.col("base") + F.when(F.col("at") <= F.col("extra"), 1).otherwise(0), F.lit(0)).cast("int")
    done_with(tops, counts)
    return out.select("doc.*", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"))
