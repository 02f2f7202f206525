"""Source adapters: from columns to records. Each is a projection; the registry holds their settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.functions.hashing import assign_split
from quillon.functions.text import humanize
from quillon.operators.dataset import QUESTION

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    license_class: str
    build: Build
    admitted: bool = True


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def admitted(sources: list[Source], licenses: tuple[str, ...] = ("A", "B")) -> tuple[list[Source], list[str]]:
    """Sources to build, and the names of those left out, decided before any is read."""
    use = [s for s in sources if s.admitted and s.license_class in licenses]
    return use, [s.name for s in sources if s not in use]


def label_vocabulary(df: DataFrame, label: str, most: int = 1000) -> DataFrame:
    """(label, index from 0) in order; over ``most`` labels raise."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(most + 1).collect()]  # bounded
    if len(found) > most:
        raise ValueError(f"more than {most} labels")
    return df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(sorted(found))], f"{label} {df.schema[label].dataType.simpleString()}, label_index int")


def _question(kind: str, instruction: Column | str, candidates: Column | None = None, levels: Column | None = None, criteria: Column | None = None) -> Column:
    instruction = F.lit(instruction) if isinstance(instruction, str) else instruction
    none = lambda c: F.lit(None).cast(QUESTION[c].dataType)
    return F.struct(F.lit("q").alias("id"), F.lit(kind).alias("type"), instruction.alias("instruction"), (none("candidates") if candidates is None else candidates).alias("candidates"), (none("levels") if levels is None else levels).alias("levels"), (none("criteria") if criteria is None else criteria).alias("criteria"))


def _record(df: DataFrame, source: str, family: str, license_class: str, key: Column, group: Column, state: Column, question: Column, kind: str, probs: Column, hard: Column) -> DataFrame:
    target = F.struct(F.lit(kind).alias("semantic_kind"), F.lit("human").alias("provenance"), probs.alias("probs"), hard.cast("int").alias("hard"))
    return df.select(F.concat_ws(":", F.lit(source), key.cast("string")).alias("id"), F.lit(source).alias("source"), group.alias("source_group"), F.lit(family).alias("family"), assign_split(group).alias("split"), F.lit(license_class).alias("license_class"), state.alias("state"), question.alias("question"), target.alias("target"), F.lit(None).cast("map<string,string>").alias("meta"))


def intent(df: DataFrame, source: str, key: str, text: str, label: str, instruction: str, license_class: str = "A", drop: tuple[str, ...] = ()) -> DataFrame:
    """Choice over all labels; group and split by text."""
    rows = require(df, key, text, label).where(F.col(label).isNotNull() & ~F.col(label).isin(*drop) if drop else F.col(label).isNotNull())
    vocabulary = label_vocabulary(rows, label)
    names = F.broadcast(vocabulary.agg(F.array_sort(F.collect_list(F.struct("label_index", F.col(label).alias("label")))).alias("names")))  # one row
    rows = rows.join(F.broadcast(vocabulary), label).crossJoin(names)  # at most 1000 labels
    candidates = F.transform("names", lambda s: F.struct(s["label"].alias("id"), humanize(s["label"]).alias("label"), F.lit("").alias("description")))
    return _record(rows, source, source, license_class, F.col(key), F.sha1(text), F.col(text), _question("choice", instruction, candidates), "one_hot", vec.one_hot(F.size("names"), "label_index"), F.col("label_index"))


def boolean(df: DataFrame, source: str, key: str, text: str, label: Column, group: Column, instruction: str, criteria: dict[str, str] | None = None, license_class: str = "A") -> DataFrame:
    c = F.create_map(*[F.lit(x) for kv in criteria.items() for x in kv]) if criteria else None
    p = label.cast("double")
    return _record(df.where(label.isNotNull()), source, source, license_class, F.col(key), group, F.col(text), _question("boolean", instruction, criteria=c), "soft", F.array(1 - p, p), (p >= 0.5).cast("int"))


def attributes(df: DataFrame, source: str, key: str, text: str, columns: list[str], license_class: str = "A") -> DataFrame:
    """One boolean record per attribute, soft target, hard at 0.5; all of a row share its group, so its split."""
    u = require(df, key, text, *columns).select(key, text, *columns).unpivot([key, text], columns, "attribute", "p").where("p is not null")
    p = F.col("p").cast("double")
    return _record(u, source, source, license_class, F.concat_ws(":", F.col(key), "attribute"), F.sha1(text), F.col(text), _question("boolean", F.concat(F.lit("Is the text "), humanize(F.col("attribute")), F.lit("?"))), "soft", F.array(1 - p, p), (p >= 0.5).cast("int"))


def ordinal(df: DataFrame, source: str, key: str, text: str, value: Column, levels: list[str], instruction: str, license_class: str = "A") -> DataFrame:
    names = F.array(*map(F.lit, levels))
    probs = vec.ordinal_soft_target(value, len(levels))
    return _record(df.where(value.isNotNull()), source, source, license_class, F.col(key), F.sha1(text), F.col(text), _question("score", instruction, levels=names), "soft", probs, vec.argmax(probs))


def per_row_choice(df: DataFrame, source: str, key: str, text: str, endings: str, label: str, instruction: str, license_class: str = "A") -> DataFrame:
    """Choice among a row's own endings."""
    c = F.transform(endings, lambda e, i: F.struct(i.cast("string").alias("id"), e.alias("label"), F.lit("").alias("description")))
    return _record(df.where(F.col(label).isNotNull()), source, source, license_class, F.col(key), F.sha1(text), F.col(text), _question("choice", instruction, c), "one_hot", vec.one_hot(F.size(endings), label), F.col(label))


def present_and_sampled(labels: Column, k: int, step: int = 7) -> Column:
    """The labels present and every step-th one: which boolean questions a row gets."""
    return F.array_sort(F.array_union(labels, F.sequence(F.lit(0), F.lit(k - 1), F.lit(step))))


def request_body(records: DataFrame) -> DataFrame:
    """(id, state, instruction, options map label to description); repeated labels raise."""
    c = F.col("question.candidates")
    labels = F.transform(c, lambda x: x["label"])
    one = F.when(F.size(F.array_distinct(labels)) != F.size(labels), F.raise_error(F.lit("repeated labels"))).otherwise(F.lit(True)).cast("boolean")
    return records.where(one).select("id", "state", F.col("question.instruction").alias("instruction"), F.map_from_arrays(labels, F.transform(c, lambda x: x["description"])).alias("options"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the test tables: language as intent, labels as attributes."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return intent(docs, "language", "doc_id", "text", "lang", "Which language is this?").unionByName(attributes(docs.join(labels, "doc_id"), "quality", "doc_id", "text", ["quality", "toxic"]))
