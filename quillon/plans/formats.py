"""Queries of file formats and serialised forms: numbered lines, nested strings, tokens."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.functions import text as TX
from quillon.functions import tokens as TK
from quillon.operators import prefixes as PX
from quillon.operators import reports as R
from quillon.sources import files as FL
from quillon.sources.files import shared_folder
from quillon.sources.lines import read_json_lines

from .base import read
from .datasets import SPLIT

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH l AS (SELECT doc_id % 3 AS part, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS line, doc_id, quality, CASE WHEN doc_id % 17 = 0 THEN 'no JSON' WHEN doc_id % 19 = 0 THEN 'a field has another type' WHEN doc_id % 23 = 0 THEN 'no object' END AS problem FROM labels)
SELECT part, line, CASE WHEN problem IS NULL THEN doc_id END AS doc_id, CASE WHEN problem IS NULL THEN quality END AS quality, problem FROM l""")
def json_lines_numbered(spark, d):
    """Labels written as lines to one file each of three folders, some of them broken, and read again with their numbers."""
    at = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    whole = F.to_json(F.struct("doc_id", "quality", "toxic"))
    value = F.when(F.col("doc_id") % 17 == 0, F.left(whole, F.length(whole) - 1)).when(F.col("doc_id") % 19 == 0, F.replace(whole, F.lit('"quality":'), F.lit('"quality":"x", "was":'))).when(F.col("doc_id") % 23 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    rows = read(spark, d, "labels").select((F.col("doc_id") % 3).alias("part"), "doc_id", value.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(at)
    back = read_json_lines(spark, at, "doc_id long, quality long, toxic long")
    return back.select(F.col("part").cast("long").alias("part"), "line", "record.doc_id", "record.quality", "problem")


_NEST = "to_json(struct_pack(z := [struct_pack(s := text, more := [role, '']), struct_pack(s := role, more := [left(text, 9)])], a := struct_pack(turn := turn, said := role)))"


@query(f"SELECT conv_id, turn, CASE WHEN fullkey = '$' THEN '$' ELSE substr(fullkey, 3) END AS path, md5(json_extract_string(atom, '$')) AS value FROM (SELECT conv_id, turn, unnest(json_tree_rows) AS r FROM (SELECT conv_id, turn, (SELECT list(struct_pack(fullkey := j.fullkey, atom := j.atom, type := j.type)) FROM json_tree({_NEST}) j) AS json_tree_rows FROM conversations)) q, LATERAL (SELECT r.fullkey AS fullkey, r.atom AS atom, r.type AS type) WHERE type = 'VARCHAR' AND json_extract_string(atom, '$') <> ''")
def json_strings(spark, d):
    """Every string of nested JSON with its path."""
    c = read(spark, d, "conversations")
    item = lambda s, more: F.struct(s.alias("s"), more.alias("more"))
    nest = F.to_json(F.struct(F.array(item(F.col("text"), F.array("role", F.lit(""))), item(F.col("role"), F.array(F.left("text", F.lit(9))))).alias("z"), F.struct("turn", F.col("role").alias("said")).alias("a")))
    return c.select("conv_id", "turn", F.explode(TX.iter_strings(nest)).alias("s")).select("conv_id", "turn", "s.path", F.md5("s.value").alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS value FROM events")
def json_dig_by_column(spark, d):
    """What stands at a path that each row names: a list's place, a key, or a key that isn't there."""
    e = read(spark, d, "events")
    nest = F.concat(F.lit('{"a": [0, '), F.col("props"), F.lit('], "b.c": '), F.col("props"), F.lit("}"))
    path = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a"), F.lit("1"), F.lit("k"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("b.c"), F.lit("k"))).otherwise(F.array(F.lit("a"), F.lit("x")))
    return e.select("event_id", TX.dig(nest, path).alias("value"))


@query("""WITH p AS (SELECT conv_id, left(text, 60) || '|' || c || '.' AS p FROM conversations CROSS JOIN (VALUES ('user'), ('use'), ('assistant')) v(c)), t AS (SELECT conv_id, i, left(p, i::INT) AS x FROM (SELECT conv_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)), n AS (SELECT conv_id, i, x FROM t GROUP BY ALL)
SELECT conv_id, (SELECT count(*) FROM t WHERE t.conv_id = n.conv_id) AS tokens, count(*) AS distinct_tokens, sum(i)::BIGINT AS visible FROM n GROUP BY 1""")
def shared_prefixes(spark, d):
    """Tokens (a character each) of every turn's candidates behind its state, and those that a prefix tree computes once."""
    c = F.explode(F.array(*map(F.lit, ("user", "use", "assistant"))))
    paths = read(spark, d, "conversations").select("conv_id", "text", c.alias("c")).select("conv_id", TX.character_ids(F.concat(F.left("text", F.lit(60)), F.lit("|"), "c", F.lit("."))).alias("ids"))
    return PX.shared(PX.prefix_tree(paths, "conv_id", "ids"), "conv_id")


def tokenizer_files() -> tuple[str, str]:
    """Two tokenizer files: those of the folder in QUILLON_TOKENIZERS, else the public ones of this machine."""
    at = os.environ.get("QUILLON_TOKENIZERS")
    if not at:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    return f"{at}/word_bpe_49k.json", f"{at}/byte_bpe_50k.json"


@query()
def token_parity(spark, d):
    """Messages that two tokenizers cut otherwise, and the first five of them."""
    c = read(spark, d, "conversations")
    one, other = (TK.token_ids("text", p) for p in tokenizer_files())
    return R.token_parity(c, ["conv_id", "turn"], one, other).withColumn("examples", F.transform("examples", lambda e: F.concat_ws(":", e["conv_id"], e["turn"])))


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT split, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT *, {SPLIT} AS split FROM documents) WHERE split <> 'test' GROUP BY 1, 2")
def splits_round_trip(spark, d):
    """Documents written to a folder a split and read again, split by split; the sealed one is refused."""
    at = _folder(spark, "splits")
    docs = read(spark, d, "documents").withColumn("split", H.assign_split(F.col("doc_id").cast("string")))
    FL.write_splits(docs, at)
    out = None
    for name in ("train", "dev", "calibration"):
        one = FL.read_split(spark, at, name)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, md5('again') FROM documents WHERE doc_id % 3 = 2")
def append_round_trip(spark, d):
    """Documents appended in two goes that overlap: rows that are there already aren't written again."""
    at = _folder(spark, "append")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    FL.append_new(docs.where("id % 3 < 2"), at)
    FL.append_new(docs.withColumn("text", F.lit("again")), at)
    return spark.read.parquet(at).select(F.col("id").alias("doc_id"), F.md5("text").alias("text"))


@query("SELECT 'count' AS kind, coalesce(lang, '*') || '/' || coalesce(source, '*') AS name, count(*)::VARCHAR AS value FROM documents GROUP BY ROLLUP (lang, source) UNION ALL SELECT 'license', source, count(*)::VARCHAR FROM documents GROUP BY 2")
def manifest_round_trip(spark, d):
    """A manifest of the documents by language and source, and of their sources as licenses, written and read again."""
    return FL.write_manifest(read(spark, d, "documents"), ["lang", "source"], _folder(spark, "manifest"), licenses="source").select("kind", "name", "value")


@query("SELECT lang, max(n_chars)::DOUBLE AS n_chars FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def csv_best_per_key(spark, d):
    """The longest document of each language from a CSV file with a header, the first three."""
    at = _folder(spark, "csv")
    read(spark, d, "documents").select("lang", "n_chars").write.option("header", True).csv(at)
    return FL.best_per_key(spark, at, "lang", "n_chars", 3)


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 7 <> 3")
def item_rows_round_trip(spark, d):
    """Rows of JSON lines by item, some of them without their metric: these are left out."""
    at = _folder(spark, "items")
    rows = read(spark, d, "labels").withColumn("correct", F.when(F.col("doc_id") % 7 != 3, F.col("quality")))
    FL.write_json_lines(rows, at)
    return FL.item_rows(spark, at, "doc_id long, quality long, toxic long, correct long").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS text FROM documents WHERE doc_id % 2 = 0")
def only_ids_round_trip(spark, d):
    """Every second document by its id, from Parquet; an id without a row would raise."""
    at = _folder(spark, "ids")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    docs.write.parquet(at)
    found = FL.only_ids(spark.read.parquet(at), docs.where("id % 2 = 0"))
    return found.select(F.col("id").alias("doc_id"), F.md5("text").alias("text"))


#: Bytes of a part of a file, about.
PART = 16 << 20


@query("SELECT count(*) AS files, count(*) AS alike FROM range(0, 3)")
def verbatim_copies(spark, d):
    """Three files of documents, each kept in parts, copied byte for byte; the digests of the copies are those of the files."""
    at, docs = _folder(spark, "copies"), read(spark, d, "documents").select("doc_id", "text")
    parts = max(1, -(-FL.scanned_bytes(read(spark, d, "documents")) // (3 * PART)))
    dealt = docs.withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(3))).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)))
    dealt.repartition(3 * parts, "file", "part").write.partitionBy("file", "part").parquet(f"{at}/from")
    copies = FL.copy_folder_verbatim(spark, f"{at}/from", f"{at}/to")
    files = copies.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("file")).agg(F.bool_and("alike").alias("alike"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if("alike").alias("alike"))


@query("SELECT conv_id, turn, len(text) AS tokens FROM conversations")
def tokenised_once(spark, d):
    """Token arrays kept under a version: the second call reads what the first one wrote."""
    at = _folder(spark, "tokens")
    c = read(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    FL.tokenised(c, at, "v1", TX.character_ids(F.col("text")))
    again = FL.tokenised(c.limit(0), at, "v1", TX.character_ids(F.col("text")))
    return again.select(F.split_part("id", F.lit(":"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("turn"), F.size("tokens").alias("tokens"))
