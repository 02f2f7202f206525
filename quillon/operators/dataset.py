"""Records, validation, splits, sampling and augmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quillon.functions import vec
from quillon.functions.hashing import coin, draw

SPLITS = ("train", "dev", "calibration", "test", "heldout")
LICENSES = ("A", "B", "C", "D")
KINDS = ("choice", "boolean", "score")
SEMANTICS = ("one_hot", "soft", "distribution")

CANDIDATE = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("description", T.StringType())])
QUESTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("instruction", T.StringType()), T.StructField("candidates", T.ArrayType(CANDIDATE)), T.StructField("levels", T.ArrayType(T.StringType())), T.StructField("criteria", T.MapType(T.StringType(), T.StringType()))])
TARGET = T.StructType([T.StructField("semantic_kind", T.StringType()), T.StructField("provenance", T.StringType()), T.StructField("probs", T.ArrayType(T.DoubleType())), T.StructField("hard", T.IntegerType())])
RECORD = T.StructType([*[T.StructField(c, T.StringType()) for c in ("id", "source", "source_group", "family", "split", "license_class", "state")], T.StructField("question", QUESTION), T.StructField("target", TARGET), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])


def candidate_text(c: Column) -> Column:
    return F.when(F.coalesce(c["description"], F.lit("")) != "", F.concat_ws(": ", c["label"], c["description"])).otherwise(c["label"])


def candidate_ids(q: Column) -> Column:
    return F.when(q["type"] == "boolean", F.array(F.lit("false"), F.lit("true"))).when(q["type"] == "score", F.transform(F.sequence(F.lit(0), F.size(q["levels"]) - 1), lambda i: i.cast("string"))).otherwise(F.transform(q["candidates"], lambda c: c["id"]))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def violations(records: DataFrame) -> DataFrame:
    """(id, reasons): what is wrong with each record, none for sound ones."""
    q, t, p = F.col("question"), F.col("target"), F.col("target.probs")
    n, k = F.size(q["candidates"]), F.when(q["type"] == "boolean", 2).when(q["type"] == "score", F.size(q["levels"])).otherwise(F.size(q["candidates"]))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rules = {
        "question type": ~q["type"].isin(*KINDS) | q["type"].isNull(),
        "instruction blank": blank(q["instruction"]),
        "candidates 2 to 255": (q["type"] == "choice") & ((n < 2) | (n > 255)),
        "candidate ids repeat": (q["type"] == "choice") & (F.size(F.array_distinct(F.transform(q["candidates"], lambda c: c["id"]))) != n),
        "candidate label blank": (q["type"] == "choice") & F.exists(q["candidates"], lambda c: blank(c["label"])),
        "levels 2 to 10": (q["type"] == "score") & ((F.size(q["levels"]) < 2) | (F.size(q["levels"]) > 10)),
        "level blank": (q["type"] == "score") & F.exists(q["levels"], blank),
        "criteria keys": (q["type"] == "boolean") & q["criteria"].isNotNull() & (F.size(F.array_except(F.map_keys(q["criteria"]), F.array(F.lit("false"), F.lit("true")))) > 0),
        "probs length": F.size(p) != k,
        "probs range": F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)),
        "probs sum": F.abs(total - 1) > 1e-6,
        "hard range": t["hard"].isNotNull() & ((t["hard"] < 0) | (t["hard"] >= k)),
        "split": ~F.col("split").isin(*SPLITS) | F.col("split").isNull(),
        "license class": ~F.col("license_class").isin(*LICENSES) | F.col("license_class").isNull(),
        "source_group empty": blank(F.col("source_group")),
        "state empty": blank(F.col("state")),
    }
    return records.select("id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])).alias("reasons")).where(F.size("reasons") > 0)


def require_sound(records: DataFrame) -> DataFrame:
    """The records; the first unsound one raises with its reasons when read."""
    bad = violations(records).select("id", "reasons")
    joined = records.join(bad, "id", "left")
    return joined.where(F.when(F.col("reasons").isNotNull(), F.raise_error(F.concat_ws("; ", "id", "reasons"))).otherwise(F.lit(True)).cast("boolean")).drop("reasons")


def first_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """First n rows of each group; Spark cuts each task's groups before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def balanced_sample(df: DataFrame, n: int, by: str, key: str, seed: int = 0) -> DataFrame:
    return first_n(df, n, [by], [draw(1_000_000_007, F.lit(seed), F.col(key)), F.col(key)])


#: Questions that one task packs, about.
SHARD = 50_000


def ordered_rank(keys: DataFrame, key: str, sample: int = 4096, cuts: int = 256) -> DataFrame:
    """keys (distinct) with rank (long, from 0) in order, exact, with no task that holds them all.

    Keys are dealt to ranges between ``cuts`` values of a sample by hash, ranked within
    each, and moved by the number of keys in the ranges before.
    """
    some = sorted(r[0] for r in keys.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).collect())  # bounded
    marks = [some[i] for i in range(len(some) // cuts, len(some), max(1, len(some) // cuts))] if len(some) > cuts else []
    kind = keys.schema[key].dataType
    bounds = F.array(*[F.lit(m).cast(kind) for m in marks]).cast(T.ArrayType(kind))
    dealt = keys.withColumn("__range", F.size(F.filter(bounds, lambda b: b <= F.col(key))))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    first = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1)
    return ranked.join(F.broadcast(first), "__range").select(*keys.columns, (F.col("__first") + F.col("__r")).alias("rank"))  # cuts rows


def every_nth_group(df: DataFrame, group: str, n: int = 14) -> DataFrame:
    """Rows of each n-th group in order; groups, not rows, are numbered."""
    g = ordered_rank(df.select(group).distinct(), group).where(F.pmod("rank", F.lit(n)) == 0).select(group)
    return df.join(g, group, "left_semi")


def family_weights(df: DataFrame, by: str, alpha: float) -> DataFrame:
    """Share of each family drawn with P ~ n^alpha, and each row's."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.pow("n", F.lit(alpha)))
    total = F.broadcast(c.agg(F.sum("w").alias("all_")))  # one row
    return c.crossJoin(total).select(by, "n", (F.col("w") / F.col("all_")).alias("p_family"), (F.col("w") / F.col("all_") / F.col("n")).alias("p_row"))


#: Families whose cumulative shares are told to all tasks, at most (a name and 16 bytes each).
MOST_FAMILIES = 1_000_000


def family_draws(df: DataFrame, key: str, by: str, alpha: float, steps: int, slots: int, seed: int = 0) -> DataFrame:
    """(step, slot, family, key): a row of df for each slot of each step, its family drawn with P ~ n^alpha, then a row of it alike.

    Draws are hashes of (seed, step, slot), so a step is drawn alike whenever and wherever it
    is drawn. A family is the first one in order whose cumulative share is over the draw,
    found by binary search in shares that all tasks have; its row is met by its exact rank,
    so the join's keys are spread however large a family is. Rows with a null family or key
    are never drawn; keys must be distinct. An empty table gives no draws.
    """
    spark = df.sparkSession
    known = df.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(F.col(by).alias("__family"), F.col(key).alias("__key"))
    counts = sorted(map(tuple, known.groupBy("__family").agg(F.count(F.lit(1)).alias("n")).limit(MOST_FAMILIES + 1).collect()))
    if len(counts) > MOST_FAMILIES:
        raise ValueError(f"over {MOST_FAMILIES} families")
    kind = df.schema[by].dataType
    if not counts:
        return spark.createDataFrame([], T.StructType([T.StructField("step", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("family", kind), T.StructField(key, df.schema[key].dataType)]))
    n = np.array([c for _, c in counts], np.int64)
    share = np.cumsum(n.astype(float) ** alpha)
    told = spark.sparkContext.broadcast((share / share[-1], n))

    @F.pandas_udf("struct<at: int, row: long>")
    def placed(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        cumulative, sizes = told.value
        at = np.minimum(np.searchsorted(cumulative, u.to_numpy(), side="right"), len(sizes) - 1)
        return pd.DataFrame({"at": at, "row": np.minimum((v.to_numpy() * sizes[at]).astype(np.int64), sizes[at] - 1)})

    def unit(what: str) -> Column:  # 56 bits of two draws
        hi, lo = (draw(1 << 28, F.lit(seed), F.lit(f"{what}{i}"), F.col("step"), F.col("slot")) for i in (1, 2))
        return (hi * (1 << 28) + lo).cast("double") / float(1 << 56)

    every = spark.range(steps * slots).select(F.expr(f"id div {slots}").alias("step"), (F.col("id") % slots).alias("slot"))
    drawn = every.select("step", "slot", placed(unit("family"), unit("row")).alias("p"))
    names = F.broadcast(spark.createDataFrame([(i, f) for i, (f, _) in enumerate(counts)], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("family", kind)])))  # MOST_FAMILIES rows at most
    wanted = drawn.select("step", "slot", F.col("p.at").alias("at"), F.col("p.row").alias("rank")).join(names, "at").drop("at")
    ranked = group_rank(known.select(F.col("__family").alias("family"), F.col("__key").alias(key)), "family", key)
    return wanted.join(ranked, ["family", "rank"]).select("step", "slot", "family", key)


def group_rank(df: DataFrame, group: str, key: str, buckets: int = 256) -> DataFrame:
    """(group, key, rank long from 0): an exact place within its group for each row, by a drawn bucket of the key, then the key; no task ranks a whole group."""
    dealt = df.select(group, key, draw(buckets, F.lit("rank"), F.col(key)).alias("__b"))
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    first = dealt.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n")).select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy(group, "__b").orderBy(key)) - 1)
    return ranked.join(first, [group, "__b"]).select(group, key, (F.col("__first") + F.col("__r")).alias("rank"))


def prior_augment(df: DataFrame, key: str, group: str, text: str, target: str, share: float, salt: str = "pick", buckets: int = 256) -> DataFrame:
    """(key, group, corruption, donor, text, mean_target): for a share of rows, a row with a corrupted text and its group's mean target.

    Half of them, by a hash, get another row's text of the same group, the others the first
    fifth of their own words (four at least, all if there are eight or fewer) in drawn
    order. Groups of one row are left alone. Donors are found by an exact rank that no task
    counts a whole group for.
    """
    spread = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = spread.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(target).cast("double")).alias("__s"))
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(W.partitionBy(group)).alias("n"), (F.sum("__s").over(W.partitionBy(group)) / F.sum("__n").over(W.partitionBy(group))).alias("mean_target"))
    ranked = spread.withColumn("__r", F.row_number().over(W.partitionBy(group, "__b").orderBy(key)) - 1).join(sizes, [group, "__b"]).withColumn("r", F.col("__first") + F.col("__r"))
    taken = ranked.where(F.col("n") >= 2).where(coin(F.col(key).cast("string"), share, salt))
    taken = taken.withColumn("corruption", F.when(draw(2, F.lit("corrupt"), F.col(key)) == 0, "donor").otherwise("shuffled"))
    step = 1 + draw(F.col("n") - 1, F.lit("donor"), F.col(key))
    want = taken.select(key, group, "corruption", F.when(F.col("corruption") == "donor", F.pmod(F.col("r") + step, F.col("n"))).alias("r"), F.col(text).alias("own"), "mean_target")
    donor = ranked.select(group, "r", F.col(key).alias("donor"), F.col(text).alias("donor_text"))
    words = F.filter(F.split("own", "[ \t\n]+"), lambda w: w != "")
    few = F.when(F.size(words) > 8, F.slice(words, F.lit(1), F.greatest(F.lit(4), (F.size(words) / 5).cast("int")))).otherwise(words)
    drawn = F.transform(F.array_sort(F.transform(few, lambda w, i: F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), i.cast("string"))).alias("h"), w.alias("w")))), lambda x: x["w"])
    return want.join(donor, [group, "r"], "left").select(key, group, "corruption", "donor", F.coalesce("donor_text", F.array_join(drawn, " ")).alias("text"), "mean_target")


def greedy_pack(df: DataFrame, shard: str, key: str, k: str, width: str, budget: int) -> DataFrame:
    """(shard, key, pack): questions by width into packs with (paths + k) x widest <= budget; one over it raises."""
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([width, key])
        pack, paths, out = 0, 0, []
        for n, w in zip(pdf[k], pdf[width], strict=True):
            if n * w > budget:
                raise ValueError("a question is over the budget")
            if paths and (paths + n) * w > budget:
                pack, paths = pack + 1, 0
            paths += n
            out.append(pack)
        return pdf.assign(pack=out)[[shard, key, "pack"]]

    types = {c: df.schema[c].dataType.simpleString() for c in (shard, key)}
    return df.select(shard, key, k, width).groupBy(shard).applyInPandas(f, f"{shard} {types[shard]}, {key} {types[key]}, pack long")


def refund_decision(days: Column, condition: Column, tier: Column, opened: Column, window: Column, defective: Column, grace: Column, fee: Column) -> Column:
    """A case under a policy: defective goods have a window of their own and then a review; beyond the return window a gold customer's grace gets a review, others a refusal; opened goods cost the fee, if there is one."""
    late = F.when((tier == "gold") & (days <= window + grace), "review").otherwise("reject")
    return F.when(condition == "defective", F.when(days <= defective, "approve").otherwise("review")).when(days > window, late).when(opened & (fee > 0), "partial").otherwise("approve")


def urn_probs(counts: Column) -> Column:
    """Exact shares; the last is 1 less the others."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    head = F.transform(F.slice(counts, F.lit(1), F.size(counts) - 1), lambda c: c / total)
    return F.concat(head, F.array(F.lit(1.0) - F.aggregate(head, F.lit(0.0), lambda a, x: a + x)))


def warmup_percentiles(df: DataFrame, by: str, order: list[str], value: str, skip: int = 20) -> DataFrame:
    """n and percentiles of each key's values without its first ``skip`` rows in order, which all tasks cut before the shuffle finds them.

    order: columns that tell a key's rows apart.
    """
    at = F.struct(*order)
    last = first_n(df.select(by, at.alias("__at")), skip, [by], [F.col("__at")]).groupBy(by).agg(F.max("__at").alias("__last"))
    kept = df.join(last, by).where(at > F.col("__last"))
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


def manifest(df: DataFrame, *by: str) -> DataFrame:
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def soft_targets(df: DataFrame, value: Column, k: int) -> DataFrame:
    return df.withColumn("target", vec.ordinal_soft_target(value, k))
