"""Claims joined with documents: an inverted index of the numbers that documents say, met by equality with claims' printed forms.

A form stands in a document where no digit or point is before it and no digit behind it:
0.818 isn't in 0.8185, 2 is in 2.5. So from each place where a number can begin, every
beginning of what follows that doesn't end before a digit is a token of the index. A claim
is found by its form alone, whatever the number of documents, and neither side is crossed
with the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.files import staged

#: Documents of a form that meet its claims in one lot, and rows that one task makes, about.
LOT, PAIRS = 512, 20_000_000
#: What a printed number may look like: a sign, digits with points and commas, an exponent, a percent sign.
FORM = r"^[+\-]?[0-9](?:[0-9.,]*[0-9])?(?:[eE][+\-]?[0-9]+)?%?$"
_INSIDE = r"[0-9.,eE%+\-]"


@F.pandas_udf(T.StringType())
def printed(value: pd.Series, scale: pd.Series, spec: pd.Series) -> pd.Series:
    """value * scale in a Python format such as ``.4f``; null where the value or format is null or the format doesn't fit."""

    def one(v, s, f):
        try:
            return None if pd.isna(v) or f is None else format(float(v) * (1.0 if pd.isna(s) else s), f)
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(value, scale, spec, strict=True)], dtype=object)


def number_tokens(text: Column, longest: int) -> Column:
    """The distinct tokens of a text with up to ``longest`` characters: every form of that length at most that stands in it."""
    ahead = rf"(?<![0-9.])(?=([+\-]?[0-9]{_INSIDE}{{0,{max(0, longest)}}}))[+\-0-9]"
    runs = F.regexp_extract_all(text, F.lit(ahead), F.lit(1))

    def beginnings(run: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.least(F.length(run), F.lit(longest))), lambda i: ~F.substring(run, i + 1, F.lit(1)).between("0", "9"))
        return F.transform(ends, lambda i: F.left(run, i))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(runs), beginnings)))


def number_index(docs: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(form, key): the inverted index of docs for forms of up to ``longest`` characters. Null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(F.explode(number_tokens(F.col(text), longest)).alias("form"), key)


def said_by(claims: DataFrame, docs: DataFrame, claim: str = "claim_id", form: str = "form", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(claim, form, key): every claim with every document that says its form, once each.

    Claims with a null form or one that isn't a printed number (FORM) are said by none.
    Repeated claims count once; so do repeated documents. One aggregate finds the longest
    form, so no form is too long for the index. A form that many claims share and many
    documents say has the product of both as its rows: its documents are dealt in lots of
    about LOT, and so many partitions that each makes about PAIRS rows.
    """
    spark = claims.sparkSession
    asked = staged(claims.select(F.col(claim).alias("__claim"), F.col(form).alias("form")).where(F.rlike("form", F.lit(FORM))).distinct(), "asked")
    longest = asked.agg(F.max(F.length("form"))).first()[0] or 0
    forms = asked.groupBy("form").agg(F.count(F.lit(1)).alias("__claims"))
    said = staged(number_index(docs, key, text, longest).join(forms, "form", "left_semi").distinct(), "said")
    met = said.groupBy("form").agg(F.count(F.lit(1)).alias("__docs")).join(forms, "form").withColumn("__lots", F.ceil(F.col("__docs") / LOT))
    pairs = met.agg(F.sum(F.col("__docs").cast("double") * F.col("__claims"))).first()[0] or 0
    parts = int(min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)))
    lots = met.select("form", "__lots")
    left = asked.join(lots, "form").select("__claim", "form", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__lots") - 1)).alias("__lot"))
    right = said.join(lots, "form").select("form", key, F.pmod(F.xxhash64(key), "__lots").alias("__lot"))
    found = left.repartition(parts, "form", "__lot").join(right.repartition(parts, "form", "__lot"), ["form", "__lot"])
    return found.select(F.col("__claim").alias(claim), F.col("form").alias(form), key)


def check_claims(claims: DataFrame, docs: DataFrame, claim: str = "claim_id", form: str = "form", doc: str = "doc", key: str = "doc_id", text: str = "text") -> DataFrame:
    """claims with ``problem``: null where the claim's document says its form, else why not.

    A claim names one document in its column ``doc``. A form that isn't a printed number is a
    problem of its own, as are a missing document and one that doesn't say the form.
    """
    asked = claims.select("*", F.coalesce(F.rlike(form, F.lit(FORM)), F.lit(False)).alias("__form"))
    longest = asked.where("__form").agg(F.max(F.length(form))).first()[0] or 0
    there = docs.select(F.col(key).alias("__key")).distinct().withColumn("__there", F.lit(True))
    said = number_index(docs, key, text, longest).distinct().select(F.col("form").alias("__said"), F.col(key).alias("__key"), F.lit(True).alias("__found"))
    joined = asked.join(there, asked[doc] == there["__key"], "left").drop("__key")
    joined = joined.join(said, (joined[doc] == said["__key"]) & (joined[form] == said["__said"]), "left")
    problem = F.when(~F.col("__form"), "no printed number").when(F.col("__there").isNull(), "document missing").when(F.col("__found").isNull(), "document does not say it")
    return joined.select(*claims.columns, problem.alias("problem"))
