"""Reports on runs: how two runs differ, bars that they must hold, counts of gates and answers, examples at the ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import vec
from quillon.operators import metrics as M

#: Largest total variation and least agreement by level.
BARS = {"f16": (1e-3, 1.0), "Q8_0": (5e-3, 1.0), "8bit": (5e-3, 1.0), "Q4_K_M": (2e-2, 0.995), "4bit": (2e-2, 0.995)}
TOLERANCE = 0.005


def type_histogram(records: DataFrame) -> DataFrame:
    """(family, shape, n): records by ``type:K=k``."""
    shape = F.concat(F.col("question.type"), F.lit(":K="), F.size("target.probs").cast("string"))
    return records.groupBy("family", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def hard_metrics(pred: DataFrame, *by: str) -> DataFrame:
    """n, NLL of the gold answer and Brier score against it alone."""
    hard = -F.log(F.greatest(F.element_at("p", F.col("gold") + 1), F.lit(vec.EPS)))
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hard).alias("hard_nll"), F.avg(vec.brier("p", vec.one_hot(F.size("p"), "gold"))).alias("hard_brier"))


def calibration_deltas(both: DataFrame, temperatures: list[float], family: str = "family") -> DataFrame:
    """(temperature, family or 'pooled', smece, smece_ref, smece_delta, nll_delta) of p against q, both tempered."""
    each = both.select(family, "p", "q", "t", F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    each = each.select("temperature", F.explode(F.array(F.col(family), F.lit("pooled"))).alias("family"), "t", vec.temper("p", F.col("temperature")).alias("p"), vec.temper("q", F.col("temperature")).alias("q"))
    keys = ["temperature", "family"]
    sides = [M.smooth_ece(M.pairs_of(each.select(*keys, F.col(x).alias("p"), "t"), *keys), *keys).withColumnRenamed("smooth_ece", n) for x, n in (("p", "smece"), ("q", "smece_ref"))]
    nll = each.groupBy(*keys).agg(F.avg(vec.nll("p", "t") - vec.nll("q", "t")).alias("nll_delta"))
    return sides[0].join(sides[1], keys).join(nll, keys).select(*keys, "smece", "smece_ref", (F.col("smece") - F.col("smece_ref")).alias("smece_delta"), "nll_delta")


def fit_report(fit: DataFrame, held: DataFrame) -> DataFrame:
    """One row: the temperature fitted on one part, and smooth ECE of the other before and after it. The temperature is fixed before the other part is read."""
    t = F.broadcast(M.fit_temperature(fit).select("temperature"))  # one row
    before = M.smooth_ece(M.pairs_of(held)).select(F.col("smooth_ece").alias("before"))
    after = M.smooth_ece(M.pairs_of(held.crossJoin(t).select("t", vec.temper("p", F.col("temperature")).alias("p")))).select(F.col("smooth_ece").alias("after"))
    return t.crossJoin(F.broadcast(before)).crossJoin(F.broadcast(after))  # one row each


def compare(both: DataFrame, *by: str) -> DataFrame:
    """n, non-finite rows, largest, mean and 99th percentile total variation of p from q, and agreement of answers; non-finite rows are counted, then left out."""
    finite = F.forall("p", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    tv, same = F.when(finite, vec.total_variation("p", "q")), F.when(finite, (vec.argmax("p") == vec.argmax("q")).cast("double"))
    rows = both.select(*by, finite.alias("finite"), tv.alias("tv"), same.alias("same"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("finite")).alias("n_nonfinite"), F.max("tv").alias("tv_max"), F.avg("tv").alias("tv_mean"), F.percentile_approx("tv", 0.99, 100_000).alias("tv_p99"), F.avg("same").alias("argmax_agree"))


def fixed_bars(stats: DataFrame, level: Column, bars: dict[str, tuple[float, float]] = BARS, tolerance: float = TOLERANCE) -> DataFrame:
    """stats (tv_max, argmax_agree, smece_delta, nll_delta, n_nonfinite) with the verdict of each bar and of all; a level without bars has none.

    A level has the bars of the first name that it begins with.
    """
    tv = F.coalesce(*[F.when(F.startswith(level, F.lit(k)), F.lit(v[0])) for k, v in bars.items()])
    least = F.coalesce(*[F.when(F.startswith(level, F.lit(k)), F.lit(v[1])) for k, v in bars.items()])
    out = stats.withColumn("tv_ok", F.col("tv_max") <= tv).withColumn("argmax_ok", F.col("argmax_agree") >= least)
    both = (F.abs("smece_delta") <= tolerance) & (F.abs("nll_delta") <= tolerance) & (F.col("n_nonfinite") == 0)
    return out.withColumn("all_ok", F.when(tv.isNotNull(), F.col("tv_ok") & F.col("argmax_ok") & both))


def regroup(pred: DataFrame, *by: str) -> DataFrame:
    """(by, worst): largest total variation of stored probabilities from the softmax of stored logits, non-finite logits apart."""
    finite = F.forall("z", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return pred.where(finite).groupBy(*by).agg(F.max(vec.total_variation("p", vec.softmax("z"))).alias("worst"))


def token_parity(segments: DataFrame, key: list[str], a: Column, b: Column, shown: int = 5) -> DataFrame:
    """One row: segments, those whose tokens differ, and the first keys of such."""
    marked = segments.select(F.struct(*key).alias("key"), (a != b).alias("differs"))
    first = marked.where("differs").orderBy("key").limit(shown).agg(F.sort_array(F.collect_list("key")).alias("examples"))
    n = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("mismatched"))
    return n.crossJoin(F.broadcast(first))  # one row


def chance(pred: DataFrame, *by: str) -> DataFrame:
    """(by, k, n, chance): answers by number of candidates, and the accuracy of a guess."""
    return pred.groupBy(*by, F.size("p").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(1.0 / F.size("p")).alias("chance"))


def gate_counts(gates: DataFrame, names: list[str]) -> DataFrame:
    """(gate, passed, failed, unevaluated): a null gate wasn't evaluated, which isn't failing."""
    u = gates.unpivot([], names, "gate", "ok")
    return u.groupBy("gate").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("unevaluated"))


def furthest(both: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(key, tv): the n rows whose answers lie furthest apart, ties by key."""
    return both.select(key, vec.total_variation("p", "q").alias("tv")).orderBy(F.desc("tv"), key).limit(n)


def first_different(both: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n keys whose answers differ."""
    return both.where(vec.argmax("p") != vec.argmax("q")).select(key).orderBy(key).limit(n)


def pool(df: DataFrame, by: str, prefer: Column, order: list[Column], cap: int = 40) -> DataFrame:
    """Up to cap rows of each key, preferred ones first, then in order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(F.when(prefer, 0).otherwise(1), *order))).where(F.col("__rn") <= cap).drop("__rn")


def alternate(df: DataFrame, kind: str, first, second, order: list[Column], most: int) -> DataFrame:
    """Rows of two classes by turns, in order within each; stops where the class whose turn it is has none left, or after ``most`` rows.

    A class's rows beyond half of that are cut before they are numbered.
    """
    numbered = df.where(F.col(kind).isin(first, second)).withColumn("turn", F.row_number().over(W.partitionBy(kind).orderBy(*order)) - 1).where(F.col("turn") * 2 < most + 1)
    n = F.broadcast(numbered.agg(F.count_if(F.col(kind) == first).alias("a"), F.count_if(F.col(kind) == second).alias("b")))  # one row
    place = F.col("turn") * 2 + F.when(F.col(kind) == first, 0).otherwise(1)
    full = F.least(F.when(F.col("a") > F.col("b"), F.col("b") * 2 + 1).otherwise(F.col("a") * 2), F.lit(most))
    return numbered.crossJoin(n).withColumn("place", place).where(F.col("place") < full).drop("turn", "a", "b")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of each side alone and of both, and whether the sides have the same."""
    left, right = a.select(key).distinct().withColumn("a", F.lit(True)), b.select(key).distinct().withColumn("b", F.lit(True))
    n = left.join(right, key, "full").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return n.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def same_order(a: DataFrame, b: DataFrame, place: str, key: str) -> DataFrame:
    """One row: places at which two reads hold different keys, or only one holds any."""
    both = a.select(place, F.col(key).alias("x")).join(b.select(place, F.col(key).alias("y")), place, "full")
    return both.agg(F.count(F.lit(1)).alias("places"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("different"))


def localise(pairs: DataFrame, mine: str, reference: str, norm_weights: Column, head: Column, question: str, eps: float = 1e-6) -> DataFrame:
    """One row: where an artifact's hidden vectors depart from the reference's, and the logits read from both.

    The logit of a vector is its root-mean-square norm, weighted, times the head. Rows where
    either vector is null take no part.
    """

    def logit(h: str) -> Column:
        scale = F.sqrt(vec.dot(h, h) / F.size(h) + eps)
        return vec.dot(vec.let(scale, lambda s: F.transform(F.zip_with(h, norm_weights, lambda x, w: x.cast("double") * w), lambda x: x / s)), head)

    both = pairs.where(F.col(mine).isNotNull() & F.col(reference).isNotNull())
    rows = both.select(question, vec.relative_l2(mine, reference).alias("rel"), F.abs(logit(mine) - logit(reference)).alias("off"))
    return rows.agg(F.count_distinct(question).alias("n_questions"), F.count(F.lit(1)).alias("n_paths"), F.max("rel").alias("hidden_rel_l2_max"), F.avg("rel").alias("hidden_rel_l2_mean"), F.max("off").alias("logit_abs_max"), F.avg("off").alias("logit_abs_mean"))
