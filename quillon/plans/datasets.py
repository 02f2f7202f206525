"""Queries on datasets: splits, targets, sampling, augmentation, sets, rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import hashing as H
from quillon.functions import vec
from quillon.operators import dataset as D

from .base import md5_draw, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


U = "(('0x' || substr(sha256('42:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
SPLIT = f"CASE WHEN {U} < 0.85 THEN 'train' WHEN {U} < 0.90 THEN 'dev' WHEN {U} < 0.95 THEN 'calibration' ELSE 'test' END"


@query(f"SELECT doc_id, round({U}, 6) AS u, {SPLIT} AS split FROM documents")
def split_assign(spark, d):
    g = F.col("doc_id").cast("string")
    return read(spark, d, "documents").select("doc_id", F.round(H.group_hash(g), 6).alias("u"), H.assign_split(g).alias("split"))


@query(f"SELECT lang, split, count(*) AS n FROM (SELECT lang, {SPLIT} AS split FROM documents) GROUP BY ROLLUP (lang, split)")
def split_manifest_rollup(spark, d):
    return D.manifest(read(spark, d, "documents").select("lang", H.assign_split(F.col("doc_id").cast("string")).alias("split")), "lang", "split")


H100 = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', substr(sha256(doc_id::VARCHAR), i, 1)) - 1)::BIGINT)), lambda a, b: (a * 16 + b) % 100)"


@query(f"SELECT doc_id, {H100} AS h, {H100} < 15 AS dev FROM documents")
def h100_split(spark, d):
    h = H.h100(F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", h.cast("long").alias("h"), (h < 15).alias("dev"))


BANK = ["Which language is this?", "Name the language.", "What language is the text in?"]
BANK_SQL = "['" + "','".join(BANK) + "']"


@query(f"SELECT doc_id, {BANK_SQL}[CASE WHEN {SPLIT} = 'train' THEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 3 ELSE 0 END + 1] AS instruction FROM documents")
def pick_instruction(spark, d):
    k = F.col("doc_id").cast("string")
    return read(spark, d, "documents").select("doc_id", H.pick_instruction(F.array(*map(F.lit, BANK)), k, H.assign_split(k)).alias("instruction"))


COIN = "(('0x' || substr(sha256('pick|0.25|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25)"


@query(f"SELECT lang, count(*) AS n, count(CASE WHEN {COIN} THEN 1 END) AS picked FROM documents GROUP BY 1")
def coin_flip(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(H.coin(F.col("doc_id").cast("string"), 0.25), 1)).alias("picked"))


def _records(spark, d):
    """Records of documents, some of them made unsound by rule."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    i = F.col("doc_id")
    soft = F.when(i % 7 == 0, F.array(F.lit(0.6), F.lit(0.5))).when(i % 11 == 0, F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).otherwise(F.array(1.0 - F.col("toxic"), F.col("toxic").cast("double")))
    question = F.struct(F.lit("q").alias("id"), F.when(i % 13 == 0, "guess").otherwise("boolean").alias("type"), F.when(i % 5 == 0, "  ").otherwise("Is it toxic?").alias("instruction"), F.lit(None).cast(D.QUESTION["candidates"].dataType).alias("candidates"), F.lit(None).cast("array<string>").alias("levels"), F.when(i % 17 == 0, F.create_map(F.lit("maybe"), F.lit("x"))).alias("criteria"))
    target = F.struct(F.lit("soft").alias("semantic_kind"), F.lit("human").alias("provenance"), soft.alias("probs"), F.when(i % 19 == 0, 5).otherwise(F.col("toxic")).cast("int").alias("hard"))
    return docs.join(labels, "doc_id").select(i.cast("string").alias("id"), "source", F.when(i % 23 == 0, "").otherwise(F.col("source")).alias("source_group"), F.col("lang").alias("family"), F.lit("train").alias("split"), F.when(i % 29 == 0, "Z").otherwise("A").alias("license_class"), F.col("text").alias("state"), question.alias("question"), target.alias("target"), F.lit(None).cast("map<string,string>").alias("meta"))


_RULES = [("doc_id % 13 = 0", "question type"), ("doc_id % 5 = 0", "instruction blank"), ("doc_id % 17 = 0 AND doc_id % 13 <> 0", "criteria keys"), ("doc_id % 7 <> 0 AND doc_id % 11 = 0 AND doc_id % 13 <> 0", "probs length"), ("doc_id % 7 = 0", "probs sum"), ("doc_id % 19 = 0 AND doc_id % 13 <> 0", "hard range"), ("doc_id % 29 = 0", "license class"), ("doc_id % 23 = 0", "source_group empty")]


@query("SELECT reason, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS reason FROM documents JOIN labels USING (doc_id) WHERE {c}" for c, r in _RULES) + ") GROUP BY 1")
def record_violations(spark, d):
    bad = D.violations(_records(spark, d).where(F.col("question.type") != "guess").unionByName(_records(spark, d).where(F.col("question.type") == "guess")))
    known = [r for _, r in _RULES]
    guess = bad.select("id", F.explode("reasons").alias("reason")).where(F.col("reason").isin(*known))
    odd = guess.where((F.col("id").cast("long") % 13 != 0) | ~F.col("reason").isin("criteria keys", "probs length", "hard range"))
    return odd.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


X = "(least(greatest((doc_id % 101) / 100.0::DOUBLE, 0), 1) * 4)"


@query(f"SELECT doc_id, list_transform(range(0, 5), lambda i: round(greatest(0.0::DOUBLE, 1 - abs({X} - i)), 6)) AS target FROM labels")
def soft_ordinal_target(spark, d):
    return read(spark, d, "labels").select("doc_id", F.transform(vec.ordinal_soft_target((F.col("doc_id") % 101) / 100.0, 5), lambda x: F.round(x, 6)).alias("target"))


@query("SELECT doc_id, [1.0::DOUBLE - quality, quality::DOUBLE] AS target, list_transform(range(0, 4), lambda j: CASE WHEN j = doc_id % 4 THEN 0.7::DOUBLE ELSE round(0.1::DOUBLE, 6) END) AS teacher FROM labels")
def one_hot_targets(spark, d):
    teacher = F.transform(vec.teacher_target(4, F.col("doc_id") % 4, F.lit(0.7)), lambda x: F.round(x, 6))
    return read(spark, d, "labels").select("doc_id", vec.one_hot(2, "quality").alias("target"), teacher.alias("teacher"))


@query("SELECT doc_id, 'quality' AS attribute, quality::DOUBLE AS p, quality >= 0.5 AS hard FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE, toxic >= 0.5 FROM labels")
def unpivot_attributes(spark, d):
    u = read(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "attribute", "v")
    return u.select("doc_id", "attribute", F.col("v").cast("double").alias("p"), (F.col("v") >= 0.5).alias("hard"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20")
def cap_per_family(spark, d):
    return D.first_n(read(spark, d, "documents").select("doc_id", "lang"), 20, ["lang"], [F.col("doc_id")])


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {md5_draw('1000000007', '0', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 15")
def balanced_sample(spark, d):
    return D.balanced_sample(read(spark, d, "documents").select("doc_id", "lang"), 15, "lang", "doc_id")


@query(f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {md5_draw('1000000007', '4', 'doc_id')}, doc_id) AS rn FROM labels) WHERE rn <= CASE WHEN toxic = 1 THEN 10 ELSE 30 END")
def stratified_mix(spark, d):
    n = read(spark, d, "labels").withColumn("rn", F.row_number().over(W.partitionBy("toxic").orderBy(H.draw(1_000_000_007, F.lit(4), F.col("doc_id")), "doc_id")))
    # the larger limit by itself cuts each task's rows before the shuffle
    return n.where(F.col("rn") <= 30).where(F.col("rn") <= F.when(F.col("toxic") == 1, 10).otherwise(30)).select("doc_id", "toxic")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)) WHERE i % 14 = 0)")
def every_nth_group(spark, d):
    return D.every_nth_group(read(spark, d, "events").select("event_id", "user_id"), "user_id")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 20 GROUP BY 1")
def warmup_latency_percentiles(spark, d):
    out = D.warmup_percentiles(read(spark, d, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("SELECT lang, n, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER (), 6) AS p_family, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER () / n, 9) AS p_row FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def family_alpha_weights(spark, d):
    return D.family_weights(read(spark, d, "documents"), "lang", 0.5).select("lang", "n", F.round("p_family", 6).alias("p_family"), F.round("p_row", 9).alias("p_row"))


PACK_BUDGET = 16384


def _questions(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") / 4 + 1).cast("int").alias("width"), (F.col("doc_id") % 4 + 2).cast("int").alias("k"))


@query()
def pack_questions(spark, d):
    docs = _questions(spark, d).where(F.col("k") * F.col("width") <= PACK_BUDGET)
    shards = max(8, docs.count() // D.SHARD)  # so that a shard's questions fit one task
    shard = F.concat_ws("-", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("string"))
    return D.greedy_pack(docs.withColumn("shard", shard), "shard", "doc_id", "k", "width", PACK_BUDGET)


@query(f"SELECT lang, count(*) AS n FROM documents WHERE (doc_id % 4 + 2) * floor(n_chars / 4 + 1) > {PACK_BUDGET} GROUP BY 1")
def pack_questions_over_budget(spark, d):
    """The questions that pack_questions leaves out, counted."""
    return _questions(spark, d).where(F.col("k") * F.col("width") > PACK_BUDGET).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


MIX = "(SELECT l.doc_id, lang, toxic, text FROM documents d JOIN labels l USING (doc_id))"


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, avg(toxic) OVER (PARTITION BY lang) AS m FROM {MIX}), w AS (SELECT doc_id, lang, m, text, {md5_draw('2', "'corrupt'", 'doc_id')} AS c FROM r WHERE n >= 2 AND {COIN}), ws AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS all_ FROM w),
fs AS (SELECT *, CASE WHEN len(all_) > 8 THEN all_[1:greatest(4, len(all_) // 5)] ELSE all_ END AS few FROM ws), s AS (SELECT doc_id, lang, m, c, array_to_string(list_transform(list_sort(list_transform(range(1, len(few) + 1), lambda i: {{'h': md5(doc_id || '|' || (i - 1)), 'w': few[i]}})), lambda x: x.w), ' ') AS shuffled FROM fs)
SELECT doc_id, lang, CASE WHEN c = 0 THEN 'donor' ELSE 'shuffled' END AS corruption, CASE WHEN c = 1 THEN md5(shuffled) END AS shuffled_md5, true AS sound, round(m, 6) AS mean_target FROM s""")
def prior_augmentation(spark, d):
    """For a quarter of the rows a donor's text or their own words cut and shuffled; sound: a donor is another row of the group, and the text is its own."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "lang", "toxic", "text")
    out = D.prior_augment(rows, "doc_id", "lang", "text", "toxic", 0.25)
    told = rows.select(F.col("doc_id").alias("donor"), F.col("lang").alias("donor_lang"), F.col("text").alias("donor_text"))
    sound = F.when(F.col("corruption") == "donor", (F.col("donor") != F.col("doc_id")) & (F.col("donor_lang") == F.col("lang")) & F.col("donor_text").eqNullSafe(F.col("text"))).otherwise(F.col("donor").isNull())
    out = out.join(told, "donor", "left").withColumn("sound", F.coalesce(sound, F.lit(False)))
    return out.select("doc_id", "lang", "corruption", F.when(F.col("corruption") == "shuffled", F.md5("text")).alias("shuffled_md5"), "sound", F.round("mean_target", 6).alias("mean_target"))


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) - count(DISTINCT doc_id) AS repeated FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def union_dedupe_ids(spark, d):
    u = read(spark, d, "documents").select("doc_id").unionByName(read(spark, d, "labels").select("doc_id"))
    c = u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))


@query("SELECT 'intersect' AS op, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'semi', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'anti', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def set_ops_ids(spark, d):
    a, b = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id", "toxic")
    toxic = b.where("toxic = 1").select("doc_id")
    parts = {"intersect": a.intersect(b.select("doc_id")), "except": a.subtract(b.select("doc_id")), "semi": a.join(toxic, "doc_id", "left_semi"), "anti": a.join(toxic, "doc_id", "left_anti")}
    out = None
    for op, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


REFUND = "CASE WHEN cond = 'defective' THEN CASE WHEN days <= defective THEN 'approve' ELSE 'review' END WHEN days > win THEN CASE WHEN tier = 'gold' AND days <= win + grace THEN 'review' ELSE 'reject' END WHEN opened AND fee > 0 THEN 'partial' ELSE 'approve' END"


@query(f"SELECT decision, count(*) AS n FROM (SELECT {REFUND} AS decision FROM (SELECT date_diff('day', o_orderdate, l_shipdate) AS days, CASE WHEN l_returnflag = 'R' THEN 'defective' ELSE 'opened' END AS cond, l_linestatus = 'O' AS opened, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'gold' ELSE 'standard' END AS tier, [14, 30, 45, 60][o_orderkey % 4 + 1] AS win, 90 AS defective, 14 AS grace, o_orderkey % 3 * 5 AS fee FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) GROUP BY 1")
def refund_rules(spark, d):
    c = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    tier = F.when(F.substring("o_orderpriority", 1, 1) == "1", "gold").otherwise("standard")
    window = F.element_at(F.array(*map(F.lit, (14, 30, 45, 60))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rule = D.refund_decision(F.datediff("l_shipdate", "o_orderdate"), F.when(F.col("l_returnflag") == "R", "defective").otherwise("opened"), tier, F.col("l_linestatus") == "O", window, F.lit(90), F.lit(14), F.col("o_orderkey") % 3 * 5)
    return c.select(rule.alias("decision")).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), o AS (SELECT p_brand, list(n ORDER BY p_type) AS c FROM c GROUP BY 1) SELECT p_brand, list_transform(range(1, len(c) + 1), lambda i: round(CASE WHEN i < len(c) THEN c[i] / list_sum(c) ELSE 1 - coalesce(list_sum(list_transform(c[1:len(c) - 1], lambda x: x / list_sum(c))), 0) END, 6)) AS probs FROM o")
def urn_exact(spark, d):
    c = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    o = c.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "n"))), lambda s: s["n"]).alias("c"))
    return o.select("p_brand", F.transform(D.urn_probs(F.col("c")), lambda x: F.round(x, 6)).alias("probs"))


@query("SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS quality, round(sum(quality) / count(*)::DOUBLE / nullif(sum(sum(quality)) OVER (), 0), 9) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_prior(spark, d):
    g = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q"), F.sum("quality").alias("s"))
    total = F.broadcast(g.agg(F.sum("s").alias("all_")))  # one row
    return g.crossJoin(total).select("source", "lang", "n", F.round("q", 6).alias("quality"), F.round(F.col("s") / F.col("n") / F.nullif(F.col("all_"), F.lit(0)), 9).alias("share"))


@query("SELECT source, arg_max(lang, (n, lang)) AS majority, round(max(n) / sum(n)::DOUBLE, 6) AS accuracy FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def majority_baseline(spark, d):
    c = read(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source").agg(F.max(F.struct("n", "lang"))["lang"].alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("accuracy"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1, 2")
def latency_tumbling(spark, d):
    g = read(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90")).select("event_type", F.col("w.start").alias("start"), "n", "p50", "p90")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def latency_stream(spark, d):
    """The windows that are over two days before the last event, as a stream in append mode over the files of the table, repeated events dropped; its percentiles are approximate, so they aren't shown."""
    import uuid

    from quillon.sources.files import shared_folder
    from quillon.streaming.streams import windows_once

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # times without a zone as moments of UTC and back, whatever the session's zone
    moment = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    events = read(spark, d, "events").select("event_id", moment.alias("ts"), "event_type", "value")
    events.write.parquet(f"{at}/in")
    w = windows_once(spark, events, f"{at}/in", at, late="2 days", key="event_id")
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz"))
    return w.select("event_type", start.alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_dig(spark, d):
    return read(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, [json_extract_string(props, '$.k')] AS leaves FROM events")
def json_leaf_values(spark, d):
    from quillon.functions.text import leaf_values

    return read(spark, d, "events").select("event_id", leaf_values("props").alias("leaves"))


@query(f"SELECT source, family, split, count(*) AS n FROM (SELECT 'language' AS source, 'language' AS family, sha1(text) AS g FROM documents UNION ALL SELECT 'quality', 'quality', sha1(text) FROM documents JOIN labels USING (doc_id), range(0, 2)) s(source, family, g), LATERAL (SELECT {SPLIT.replace("doc_id", "g")} AS split) GROUP BY 1, 2, 3")
def document_records(spark, d):
    from quillon.sources.adapters import document_records as build

    return build(spark, d).groupBy("source", "family", "split").agg(F.count(F.lit(1)).alias("n"))
