"""Structured Streaming: answers on a stream of requests, latency windows, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.scoring import Scorer, decide
from quillon.sources.files import append_new


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_at_once: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder)


def latency_windows(events: DataFrame, ts: str = "ts", value: str = "value", by: str = "event_type", width: str = "1 day", late: str = "1 day", key: str | None = None) -> DataFrame:
    """Count, mean and approximate p50 and p90 per tumbling window.

    In append mode a stream gives a window once, when the watermark (the latest time so far
    less ``late``) passes its end, and drops its state; rows behind the watermark are late and
    dropped. Of rows with one ``key`` (where given) that come within the watermark the first
    counts. Rows with a null time belong to no window.
    """
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    if key:
        stamped = stamped.dropDuplicatesWithinWatermark([key]) if events.isStreaming else stamped.dropDuplicates([key])
    g = stamped.groupBy(F.window(ts, width).alias("w"), by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, F.lit(0.5), F.lit(10_000)).alias("p50"), F.percentile_approx(value, F.lit(0.9), F.lit(10_000)).alias("p90")).select(F.col("w.start").alias("start"), by, "n", "mean", "p50", "p90")


def run_windows(stream: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends the windows of what a stream holds now to Parquet at path, each once it is over; returns the query, ended.

    Started again with the same checkpoint it goes on with its state where it stopped.
    """
    q = latency_windows(stream, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the batches that Spark still has figures of."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch."""
    last = query.recentProgress[-1:]
    return sum(op["numRowsTotal"] for p in last for op in p["stateOperators"])


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Appends each batch's rows that aren't written yet, so a batch that is run again adds nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df.dropDuplicates([key]), path, key)).trigger(availableNow=True).start()


def decide_stream(stream: DataFrame, scorer: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Answers requests as they come: each batch is decided as a table and its answers appended once by state_id."""

    def one(df: DataFrame, _: int) -> None:
        append_new(decide(df.dropDuplicates(["state_id"]), scorer), path, "state_id")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()


def windows_once(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, **how) -> DataFrame:
    """The windows that are over, of all files that a folder of events holds now, run as a stream to its end."""
    run_windows(read_stream(spark, folder, events.schema, files_at_once=1_000_000), f"{checkpoint}/sink", f"{checkpoint}/state", **how)
    return spark.read.parquet(f"{checkpoint}/sink")
