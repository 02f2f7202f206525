"""JSON lines with exact line numbers, and what is wrong with the lines that aren't records.

Files are read in splits of any size. A row's place within its split is its place in the
task's order of rows less that of the split's first row; the lines of a file's earlier
splits are counted once, a row a split. So no task reads a whole file to number it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line long from 1, value, and the folders' partition columns) of text files; empty lines count."""
    raw = spark.read.text(paths)
    folders = [c for c in raw.columns if c != "value"]
    at = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    splits = at.groupBy("file", "__start").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))  # a row a split
    before = W.partitionBy("file").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return at.join(splits, ["file", "__start"]).select("file", (F.col("__at") + F.col("__shift")).alias("line"), "value", *folders)


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """(file, line, record, problem) of JSON lines: record is null where problem says why; lines of white space alone are left out, but counted."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "__bad"
    lines = numbered_lines(spark, paths).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", T.StructType([*fields.fields, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    kind = F.substring(F.trim("value"), 1, 1)
    problem = F.when(F.try_parse_json("value").isNull(), "no JSON").when(kind != "{", "no object").when(F.col(f"r.{bad}").isNotNull(), "a field has another type")
    record = F.struct(*[F.col("r").getField(f.name).alias(f.name) for f in fields.fields])
    return parsed.withColumn("problem", problem).select(*[c for c in lines.columns if c != "value"], F.when(F.col("problem").isNull(), record).alias("record"), "problem")
