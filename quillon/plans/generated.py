"""Queries on generated records, runs compared pairwise, layouts and pooled rates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import vec
from quillon.operators import generators as G

from .answers import TWO
from .base import md5_draw, over, pred_sql, predictions, read
from .datasets import REFUND

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_d = lambda m, *p: md5_draw(str(m), "1", *[f"'{x}'" if x.isalpha() and x != "id" else x for x in p])
_CASES = f"SELECT id, [14, 30, 45, 60][{_d(4, 'window', 'id')} + 1] AS win, [90, 180, 365][{_d(3, 'defective', 'id')} + 1] AS defective, [0, 7, 14][{_d(3, 'grace', 'id')} + 1] AS grace, [0, 0, 10, 15][{_d(4, 'fee', 'id')} + 1] AS fee, {_d(121, 'days', 'id')} AS days, ['unopened', 'opened', 'defective'][{_d(3, 'cond', 'id')} + 1] AS cond, ['standard', 'standard', 'gold'][{_d(3, 'tier', 'id')} + 1] AS tier FROM (SELECT o_orderkey AS id FROM orders)"


@query(f"SELECT id, 'refund:' || win || ':' || defective || ':' || grace || ':' || fee AS source_group, days, cond AS condition, tier, opened, {REFUND} AS decision FROM (SELECT *, cond <> 'unopened' AS opened FROM ({_CASES}))")
def refund_generator(spark, d):
    """A case for each order."""
    return G.refund_cases(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).select("id", "source_group", "days", "condition", "tier", "opened", "decision")


_T = "[" + ", ".join("{'q': '" + q + "', 'r': [" + ", ".join("[" + ", ".join(f"'{x}'" for x in r) + "]" for r in rs) + "]}" for q, *rs in G.REPLIES) + "]"


@query(f"WITH a AS (SELECT id, {_T}[{_d(len(G.REPLIES), 'q', 'id')} + 1] AS t, {_d(3, 'm', 'id')} AS m FROM (SELECT event_id AS id FROM events)), b AS (SELECT id, t.q AS question, t.r[m + 1][{md5_draw('len(t.r[m + 1])', '1', chr(39) + 'r' + chr(39), 'id')} + 1] AS reply, m FROM a) SELECT id, question, reply, 'choice' AS qtype, m AS hard FROM b UNION ALL SELECT id, question, reply, 'boolean', (m = 0)::INT FROM b")
def implicature_generator(spark, d):
    """A reply for each event, asked about twice."""
    return G.implicatures(read(spark, d, "events").select(F.col("event_id").alias("id"))).select("id", "question", "reply", "qtype", "hard")


_LEVELS = ("yes", "no", "middle", "conditional", "probably_yes", "probably_no")
_RELATIONS = ("negate", "suggests_opposite", "partial", "orthogonal")
_RULES = " ".join(f"WHEN relation = '{r}' AND level = '{a}' THEN '{b}'" for r, rule in (("negate", G.FLIP), ("suggests_opposite", G.SUGGEST), ("partial", G.PARTIAL)) for a, b in rule.items())
_IMPLIED = f"CASE WHEN relation IS NULL THEN level {_RULES} WHEN relation = 'orthogonal' THEN 'other' END"


@query(f"SELECT doc_id, relation, level, {_IMPLIED} AS label FROM (SELECT doc_id, [NULL, {', '.join(repr(x) for x in _RELATIONS)}][doc_id % 5 + 1] AS relation, [{', '.join(repr(x) for x in _LEVELS)}][doc_id % 6 + 1] AS level FROM documents)")
def implied_labels(spark, d):
    """What an answer of each level says under each relation of its topic to the one asked about."""
    i = F.col("doc_id")
    relation = F.element_at(F.array(F.lit(None), *map(F.lit, _RELATIONS)), (i % 5 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (i % 6 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", relation.alias("relation"), level.alias("level")).withColumn("label", G.implied(F.col("level"), F.col("relation")))


_TOPICS = "SELECT p_brand AS topic, 'Do you like ' || p_type || '?' AS question, ['yes', 'no', 'middle', 'conditional', 'probably_yes'][p_size % 5 + 1] AS level, 'About ' || p_brand || ' of size ' || p_size || '.' AS answer FROM part"
_EVERY = f"WITH t AS ({_TOPICS}), asked AS (SELECT DISTINCT topic, question FROM t), said AS (SELECT DISTINCT topic AS answer_topic, level, answer FROM t), c AS (SELECT a.topic, b.topic AS answer_topic, ['negate', 'partial', 'orthogonal'][len(a.topic || b.topic) % 3 + 1] AS relation FROM (SELECT DISTINCT topic FROM t) a JOIN (SELECT DISTINCT topic FROM t) b ON b.topic > a.topic AND substr(a.topic, 7, 1) = substr(b.topic, 7, 1)), e AS (SELECT asked.topic, answer_topic, NULL AS relation, level, question, answer FROM asked JOIN said ON topic = answer_topic UNION ALL SELECT c.topic, c.answer_topic, relation, level, question, answer FROM c JOIN asked ON asked.topic = c.topic JOIN said ON said.answer_topic = c.answer_topic WHERE level IN ('yes', 'no', 'middle', 'conditional'))"


@query(_EVERY + " SELECT relation, count(*) AS n FROM (SELECT DISTINCT question, answer, relation FROM e, (VALUES ('at dinner'), ('on a walk')) v(context)) GROUP BY 1")
def topic_items_by_relation(spark, d):
    """All distinct items of a topic graph over parts, by relation; question and answer tell the context apart."""
    p = read(spark, d, "part")
    level = F.element_at(F.array(*map(F.lit, ("yes", "no", "middle", "conditional", "probably_yes"))), F.col("p_size") % 5 + 1)
    t = p.select(F.col("p_brand").alias("topic"), F.concat(F.lit("Do you like "), "p_type", F.lit("?")).alias("question"), level.alias("level"), F.concat(F.lit("About "), "p_brand", F.lit(" of size "), F.col("p_size").cast("string"), F.lit(".")).alias("answer"))
    names = t.select("topic").distinct()
    other = names.select(F.col("topic").alias("answer_topic"))
    pairs = names.join(other, (F.substring("topic", 7, 1) == F.substring("answer_topic", 7, 1)) & (F.col("answer_topic") > F.col("topic")))
    relation = F.element_at(F.array(*map(F.lit, ("negate", "partial", "orthogonal"))), (F.length(F.concat("topic", "answer_topic")) % 3 + 1).cast("int"))
    asked, said = t.select("topic", "question").distinct(), t.select(F.col("topic").alias("answer_topic"), "level", "answer").distinct()
    direct = asked.join(said, F.col("topic") == F.col("answer_topic")).withColumn("relation", F.lit(None).cast("string"))
    related = pairs.withColumn("relation", relation).join(asked, "topic").join(said.where(F.col("level").isin("yes", "no", "middle", "conditional")), "answer_topic")
    return direct.unionByName(related).select("question", "answer", "relation").distinct().groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT doc_id::VARCHAR AS id, 'base' AS role, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM labels UNION ALL SELECT 's' || item_id, 'synthetic', 'item' FROM benchmark) SELECT role, label, count(*) AS n FROM m GROUP BY ROLLUP (role, label)")
def merge_receipt(spark, d):
    """Rows of a base and of a synthetic set, merged with ids that must be distinct, counted by role and label."""
    base = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("base").alias("role"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    synthetic = read(spark, d, "benchmark").select(F.concat(F.lit("s"), "item_id").alias("id"), F.lit("synthetic").alias("role"), F.lit("item").alias("label"))
    return G.receipt(G.merged(base, synthetic), "label", "role")


_URN = f"SELECT id, list_transform(range(1, {md5_draw('5', '1', chr(39) + 'k' + chr(39), 'id')} + 3), lambda j: {md5_draw('12', '1', chr(39) + 'c' + chr(39), 'id', 'j')} + 1) AS counts FROM (SELECT o_orderkey AS id FROM orders)"


@query(f"WITH u AS ({_URN}), p AS (SELECT id, list_transform(counts, lambda c: c / list_sum(counts)) AS p FROM u) SELECT id, 'choice' AS qtype, list_transform(p, lambda x: round(x, 6)) AS p FROM p UNION ALL SELECT id, 'boolean', [round(1 - p[1], 6), round(p[1], 6)] FROM p")
def urn_generator(spark, d):
    """An urn for each order."""
    return G.urn_questions(G.urns(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")))).select("id", "qtype", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


@query("SELECT s AS step, round(CASE WHEN s < w THEN 0.001::DOUBLE * (s + 1) / w ELSE 0.0005::DOUBLE * (1 + cos(pi() * (s - w) / greatest(1, n - w)::DOUBLE)) END, 9) AS lr FROM (SELECT o_orderkey AS s FROM orders), (SELECT max(o_orderkey) + 1 AS n, (max(o_orderkey) + 10) // 10 AS w FROM orders)")
def learning_rate_schedule(spark, d):
    """The rate at which each order is learnt from, one order a step by their keys; a tenth of the steps warms up."""
    s = read(spark, d, "orders").select(F.col("o_orderkey").alias("step"))
    n = s.agg((F.max("step") + 1).alias("n"), F.expr("(max(step) + 10) div 10").alias("w"))
    lr = G.learning_rate(F.col("step"), F.col("n"), F.col("w"), 0.001)
    return s.crossJoin(F.broadcast(n)).select("step", F.round(lr, 9).alias("lr"))  # one row


@query("WITH " + ", ".join(pred_sql(s, f"r{i}") for i, s in enumerate((2.0, 5.0, 10.0))) + ", u AS (" + " UNION ALL ".join(f"SELECT {i} AS run, vec_id, p FROM r{i}" for i in range(3)) + f") SELECT a.run AS a, b.run AS b, count(*) AS n, sum((list_position(a.p, list_max(a.p)) <> list_position(b.p, list_max(b.p)))::INT) AS changed, round(max({over('0.5::DOUBLE * abs(a.p[i] - b.p[i])', 'a.p')}), 6) AS max_tv FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.run < b.run GROUP BY 1, 2")
def run_pairs(spark, d):
    """Runs of one file compared two by two, i < j."""
    u = None
    for i, s in enumerate((2.0, 5.0, 10.0)):
        one = predictions(spark, d, s).select(F.lit(i).alias("run"), "vec_id", "p")
        u = one if u is None else u.unionAll(one)
    a, b = u.select(F.col("run").alias("a"), "vec_id", F.col("p").alias("p")), u.select(F.col("run").alias("b"), "vec_id", F.col("p").alias("q"))
    m = a.join(b, "vec_id").where("a < b")
    return m.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum((vec.argmax("p") != vec.argmax("q")).cast("long")).alias("changed"), F.round(F.max(vec.total_variation("p", "q")), 6).alias("max_tv"))


@query(TWO + f", v AS (SELECT family, {over('0.5::DOUBLE * abs(p[i] - q[i])')} AS tv FROM both_) SELECT family, round(quantile_cont(tv, 0.5), 6) AS median, round(quantile_cont(tv, 0.9), 6) AS p90, round(max(tv), 6) AS max, round(avg((tv > 0.1)::INT), 6) AS above FROM v GROUP BY 1")
def question_tv(spark, d):
    q = predictions(spark, d, 5.0).select("vec_id", F.col("p").alias("q"))
    v = predictions(spark, d).join(q, "vec_id").select("family", vec.total_variation("p", "q").alias("tv"))
    return v.groupBy("family").agg(F.round(F.percentile("tv", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("tv", F.lit(0.9)), 6).alias("p90"), F.round(F.max("tv"), 6).alias("max"), F.round(F.avg((F.col("tv") > 0.1).cast("double")), 6).alias("above"))


@query("SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - n AS start FROM (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n FROM conversations)")
def running_offsets(spark, d):
    n = read(spark, d, "conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long").alias("n"))
    at = F.sum("n").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return n.withColumn("start", at)


_RATE = "SELECT lang, source, count(*) AS n, avg(quality) AS q, avg(toxic) AS t FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"


@query(f"SELECT lang, round(sum(q * n) / sum(n), 6) AS pooled, count(CASE WHEN q - t > 0.01 THEN 1 END) AS better, count(CASE WHEN q - t < -0.01 THEN 1 END) AS worse, count(CASE WHEN abs(q - t) <= 0.01 THEN 1 END) AS flat, round(quantile_cont(q - t, 0.5), 6) AS median_delta FROM ({_RATE}) GROUP BY 1")
def pooled_deltas(spark, d):
    r = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t")).withColumn("x", F.col("q") - F.col("t"))
    return r.groupBy("lang").agg(F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("pooled"), F.count_if(F.col("x") > 0.01).alias("better"), F.count_if(F.col("x") < -0.01).alias("worse"), F.count_if(F.abs("x") <= 0.01).alias("flat"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median_delta"))
