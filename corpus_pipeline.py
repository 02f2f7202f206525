"""The corpus pipeline: five operators in turn, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import done_with, quoted, stage
from quillon.llm.jaccard_join import jaccard_components
from quillon.llm.langid import fit, identify
from quillon.llm.mixing import mix
from quillon.llm.packing import pack_documents
from quillon.llm.queries import tokenizer_path
from quillon.llm.secrets import default_forest, redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those without letters (null and empty texts too) or with text unlike every learned language.

    Repeated rows stay or go together; where no row has a language, all go.
    """
    # texts stand beside the struct, not in it too: they are what is passed to Python
    rest = [c for c in docs.columns if c != "text"]
    kept = docs.select(F.struct(*quoted(rest)).alias("doc"), "text")
    found = identify(kept, fit(docs)).where(~F.col("rejected"))
    return found.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id.

    A null id stands behind all others; of repeated rows one stays. Documents without words
    are like no other and stay.
    """
    late = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + F.lit(1 << 62)
    keyed = docs.select(F.struct(*quoted(docs.columns)).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), late).alias("key"), F.xxhash64("text").alias("what"), "text")
    groups = jaccard_components(keyed, key="key", words=5, num=80, den=100)
    first = groups.where("key = component_id").select("key").distinct()
    return keyed.drop("text").join(first, "key", "left_semi").dropDuplicates(["key", "what"]).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars set anew (null where the text is null); repeated rows alike."""
    out = redact(docs, default_forest(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words (null and empty texts) aren't taken, null sources are one.

    Repeated rows are documents of their own.
    """
    mixed = mix(docs.select(F.struct(*quoted(docs.columns)).alias("doc"), "doc_id", "source", "text")).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is its end alone, repeated rows lie apart."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No SQL here: the models, the graph components and the packing can't be told in it. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        done_with(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
