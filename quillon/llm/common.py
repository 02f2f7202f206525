"""What the corpus operators share: staged tables, exact ranks, components.

Nothing here collects rows per document to the driver, and every table that is
cut from its lineage is a Parquet table in the folder that the session names in
``spark.checkpoint.dir``, so a lost executor costs a re-read, not the result.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quillon.sources.files import shared_folder, unstage

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts the same runs.
WORD = r"[^\x20\x09-\x0D]+"

#: Heavy keys of a join, at most: those with over a 512th of the rows, and over LEAST_HEAVY. It bounds a broadcast.
MOST_HEAVY, LEAST_HEAVY = 512, 64
#: Edge ends (16 bytes each) that one task may hold: with more, the centres of stars are met by broadcasts.
FEW_EDGES = 200_000


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f as a task that gives its memory back when it ends: Python workers are reused, and allocators keep what was freed."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of df has, whatever case Spark minds."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def done_with(*parts: Broadcast | DataFrame | None) -> None:
    """Frees broadcasts and deletes staged tables that no later plan reads."""
    for x in parts:
        if isinstance(x, Broadcast):
            x.destroy()
        elif x is not None:
            unstage(x)


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as Spark takes them literally, dots and back quotes included."""
    return ["`" + c.replace("`", "``") + "`" for c in names]


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside pass Arrow batches of a few MB at most to Python workers, however long their rows are."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a scan of files, their bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shards_for(df: DataFrame, mb_each: float, least: int = 8) -> int:
    """How many shards of about mb_each MB of input the plan's estimate asks for; where it has none, the session's number."""
    spark = df.sparkSession
    size = plan_bytes(df)
    known = size if size < 1e17 else 0  # what Spark can't estimate counts as 8 EB or a multiple
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), int(known / (mb_each * 1e6)))


def even_homes(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` partitions that Spark's hash deals to it: rows with these numbers fill partitions evenly, where hashes of other numbers leave some empty and others several times full."""
    home = F.pmod(F.hash("id"), F.lit(parts)).alias("part")
    out = list(range(parts))
    for r in spark.range(16 * parts).groupBy(home).agg(F.min("id").alias("id")).collect():  # parts rows
        out[r.part] = r.id
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: Column, buckets: int = 1024, out: str = "rank") -> DataFrame:
    """Adds rank (long, from 0) within keys, exact, with no task that holds a whole key.

    The rows of a key are dealt to ``buckets`` by ``salt``; each bucket is ranked by
    itself and moved by the number of rows in the key's earlier buckets. The keys must
    not be null. Rows that tie in ``order`` are ranked in any order.
    """
    b, n, first = "__bucket", "__n", "__first"
    d = df.withColumn(b, F.pmod(salt, F.lit(buckets)).cast("int"))
    before = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n)).select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    ranked = d.withColumn("__row", F.row_number().over(W.partitionBy(*keys, b).orderBy(*order)))
    return ranked.join(offsets.hint("merge"), [*keys, b]).withColumn(out, F.col(first) + F.col("__row") - 1).drop(b, first, "__row")


def heavy_of(counts: DataFrame, n: str = "n", most: int = MOST_HEAVY, least: int | None = None) -> DataFrame | None:
    """Of rows (keys, n), one a key, the keys with over one ``most``-th of all and over ``least``: fewer than ``most`` rows, as a local table; None where there are none."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    keys = counts.where(F.col(n) > max(total // most, LEAST_HEAVY if least is None else least)).drop(n)
    found = keys.collect()  # fewer than ``most``
    return counts.sparkSession.createDataFrame(found, keys.schema) if found else None


def joined_by(rows: DataFrame, table: DataFrame, keys: str | list[str], heavy: DataFrame | None, how: str = "left") -> DataFrame:
    """rows with the columns of table (one row a key) beside them; ``left`` or ``inner``.

    heavy: the keys that many rows have (``heavy_of``). These are met by a broadcast of their
    rows of table, so no shuffle brings a key's rows together; others are shuffled. rows is
    read twice where there are heavy keys, so a staged table is meant.
    """
    if heavy is None:
        return rows.join(table, keys, how)
    told = F.broadcast(heavy)  # fewer than MOST_HEAVY rows
    near = rows.join(told, keys, "left_semi").join(F.broadcast(table.join(told, keys, "left_semi")), keys, how)
    far = rows.join(told, keys, "left_anti").join(table, keys, how)
    return near.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: two columns a, b of one orderable type, nulls and loops ignored. Returns
    (node, component) for each node with an edge; the component is its smallest node.
    The edges are rewritten until every node points at the smallest one; each round is a
    staged table. A star's centre is reduced with partial aggregates, and meets its edges by
    a broadcast where they are many, so a hub with a third of all edges doesn't meet in one task.
    """
    spark = edges.sparkSession
    kind = edges.schema[0].dataType
    e = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = stage(e, "edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            break
        seen = (mark.n, mark.x)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # in a task of few edges the centres of stars do no harm
        held, heavy = [], None
        if 2 * mark.n > FEW_EDGES:
            low = stage(low, "low")
            held.append(low)
            heavy = heavy_of(low.select("u", "n"))
        large = joined_by(both, low.drop("n"), "u", heavy, "inner").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        heavy = None
        if 2 * mark.n > FEW_EDGES:
            large = stage(large, "large")
            held.append(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        if 2 * mark.n > FEW_EDGES:
            least = stage(least, "least")
            held.append(least)
            heavy = heavy_of(least.select("hi", "n"))
        small = joined_by(large, least.drop("n"), "hi", heavy, "inner").select("hi", F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("m").alias("y")), F.struct(F.col("lo").alias("x"), F.col("m").alias("y")))).alias("p")).select(F.col("p.x").alias("hi"), F.col("p.y").alias("lo")).where("hi <> lo").distinct()
        new = stage(small, "edges")
        done_with(e, *held)
        e = new
    if not seen:
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def bit_map(keys: DataFrame, column: str, most: int) -> np.ndarray:
    """A bit map of the hashes of longs, two bits each: a power of two of bits, about 16 for each long, ``most`` at most. It bounds what reaches the driver and is broadcast."""
    n = keys.count()
    size = min(most, 1 << max(10, (16 * n - 1).bit_length()))
    h = F.xxhash64(column)
    at = F.col("at")
    twice = keys.select(F.explode(F.array(F.pmod(h, F.lit(size)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(size)))).alias("at"))
    rows = twice.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toArrow()  # size / 64 rows
    words = np.zeros(size // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return words


def in_bit_map(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (xxhash64 of the longs, unsigned) may be of longs in the map: all that are, few that aren't."""
    has = np.ones(len(hashes), bool)
    for at in (hashes % np.uint64(64 * len(words)), (hashes >> np.uint64(32)) % np.uint64(64 * len(words))):
        has &= words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
    return has


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
