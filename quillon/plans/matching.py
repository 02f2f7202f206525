"""Queries that match texts with tables: claims, lexicons, fairness; draws of families; hidden vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import claims as CL
from quillon.operators import dataset as D
from quillon.operators import fairness as FA
from quillon.operators import lexicon as L
from quillon.operators import reports as R

from .base import md5_draw, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _claims(spark, d):
    """Numbers of three tables as they would be printed."""
    rows = [("part", "part", "p_partkey", "p_retailprice", ".2f"), ("supplier", "supplier", "s_suppkey", "s_suppkey", ".0f"), ("event", "events", "event_id", "value", ".1f")]
    out = None
    for name, table, key, value, spec in rows:
        one = read(spark, d, table).select(F.concat(F.lit(f"{name}:"), F.col(key)).alias("claim_id"), F.col(value).cast("double").alias("value"), F.lit(spec).alias("spec"), F.col(key).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("claim_id", "n", CL.printed("value", F.lit(1.0), "spec").alias("form"))


_CLAIMS = "cl AS (SELECT 'part:' || p_partkey AS claim_id, p_partkey AS n, printf('%.2f', p_retailprice::DOUBLE) AS form FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_suppkey, printf('%.0f', s_suppkey::DOUBLE) FROM supplier UNION ALL SELECT 'event:' || event_id, event_id, printf('%.1f', value::DOUBLE) FROM events)"
_SAYS = "contains(text, form) AND regexp_matches(text, '(^|[^0-9.])' || replace(form, '.', '\\.') || '([^0-9]|$)')"


@query(f"WITH {_CLAIMS}, f AS (SELECT DISTINCT form FROM cl), m AS (SELECT form, doc_id FROM f JOIN documents ON {_SAYS}) SELECT claim_id, form, doc_id FROM cl JOIN m USING (form)")
def claims_said_by(spark, d):
    """Every claim with every document that says its number."""
    return CL.said_by(_claims(spark, d), read(spark, d, "documents"))


@query(f"WITH {_CLAIMS}, c AS (SELECT claim_id, form, n % (SELECT 2 * count(*) FROM documents) AS doc FROM cl WHERE n < 4000) SELECT claim_id, doc, CASE WHEN doc_id IS NULL THEN 'document missing' WHEN NOT coalesce({_SAYS}, false) THEN 'document does not say it' END AS problem FROM c LEFT JOIN documents ON doc_id = doc")
def claims_forward(spark, d):
    """Claims that name one document each, and what is wrong with them; half of the documents they may name are missing."""
    docs = read(spark, d, "documents")
    named = _claims(spark, d).where("n < 4000").select("claim_id", "form", (F.col("n") % (2 * docs.count())).alias("doc"))
    return CL.check_claims(named, docs).select("claim_id", "doc", "problem")


_EDGE = "[^\\p{L}\\p{N}_]"
_HAS = lambda term: f"regexp_matches(lower(text), '(^|{_EDGE})(' || {term} || ')({_EDGE}|$)')"


def _pairs_of_words(spark, d):
    """A lexicon made of the data: the first two words of each benchmark item."""
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))
    return read(spark, d, "benchmark").where(F.size(w) > 1).select(F.concat(w[0], F.lit(" "), w[1]).alias("term"), F.concat(F.lit("c"), F.col("item_id") % 5).alias("category"))


_PAIRS = "w AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}]+') AS w FROM benchmark), lx AS (SELECT DISTINCT w[1] || ' ' || w[2] AS term, 'c' || (item_id % 5) AS category FROM w WHERE len(w) > 1)"


@query(f"WITH {_PAIRS} SELECT doc_id, category, count(*) AS terms FROM documents JOIN lx ON contains(lower(text), lower(term)) AND {_HAS('lower(term)')} GROUP BY 1, 2")
def lexicon_terms(spark, d):
    """Documents by category of the two-word terms that they hold, a term counted once."""
    found = L.mentions(read(spark, d, "documents"), _pairs_of_words(spark, d), "doc_id", "text")
    return found.select("doc_id", "category", "term").distinct().groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("terms"))


_TERMS = [t for terms in L.IDENTITY.values() for t in terms]


def _comments(spark, d):
    """Labelled documents as comments of two families: a third of them mention an identity, a third hold a term within another word."""
    term = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("doc_id") % len(_TERMS) + 1).cast("int"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" about "), F.upper(F.left(term, F.lit(1))), F.substring(term, F.lit(2), F.length(term)), F.lit(", people"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" about x"), term, F.lit("ly things"))).otherwise("")
    x, toxic = (F.col("n_chars") % 100) / 100.0, F.col("toxic").cast("double")
    boolean = F.col("doc_id") % 2 == 0
    weights = [1 + F.pmod(F.col("n_chars") * (i + 1), F.lit(7)) for i in range(5)]
    total = sum(weights[1:], weights[0])
    level = F.pmod(2 * F.col("toxic") + 3 * F.col("quality") + F.col("doc_id"), F.lit(5))
    p = F.when(boolean, F.array(1 - x, x)).otherwise(F.array(*[w / total for w in weights]))
    t = F.when(boolean, F.array(1 - toxic, toxic)).otherwise(F.array(*[(level == i).cast("double") for i in range(5)]))
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", F.when(boolean, "boolean").otherwise("level").alias("family"), F.concat(F.coalesce("text", F.lit("")), said).alias("comment"), p.alias("p"), t.alias("t"))
    return L.with_categories(rows, L.identity_lexicon(spark), "comment")


def _comments_sql() -> str:
    """Common table expression s (doc_id, family, categories, correct, xent, false_toxic, missed_toxic)."""
    names = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"
    term = f"{names}[doc_id % {len(_TERMS)} + 1]"
    text = f"coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' about ' || upper(left({term}, 1)) || substr({term}, 2) || ', people' WHEN 1 THEN ' about x' || {term} || 'ly things' ELSE '' END"
    cats = ", ".join("CASE WHEN " + _HAS(f"'{'|'.join(v)}'") + f" THEN '{k}' END" for k, v in sorted(L.IDENTITY.items()))
    w = [f"(1 + (n_chars * {i + 1}) % 7)" for i in range(5)]
    level = "(2 * toxic + 3 * quality + doc_id) % 5"
    p = f"CASE WHEN b THEN [1 - (n_chars % 100) / 100.0::DOUBLE, (n_chars % 100) / 100.0::DOUBLE] ELSE [{', '.join(f'{x} / ({chr(43).join(w)})::DOUBLE' for x in w)}] END"
    t = f"CASE WHEN b THEN [1 - toxic::DOUBLE, toxic::DOUBLE] ELSE list_transform(range(0, 5), lambda i: ({level} = i)::INT::DOUBLE) END"
    gold, said = "(list_position(t, list_max(t)) - 1)", "(list_position(p, list_max(p)) - 1)"
    toxic, calm, called = f"CASE WHEN b THEN t[2] >= 0.5 ELSE {gold} >= 3 END", f"CASE WHEN b THEN t[2] < 0.5 ELSE {gold} <= 1 END", f"CASE WHEN b THEN p[2] >= 0.5 ELSE {said} >= 3 END"
    return f"""WITH c0 AS (SELECT doc_id, doc_id % 2 = 0 AS b, {text} AS text, n_chars, toxic, quality FROM documents JOIN labels USING (doc_id)), c1 AS (SELECT doc_id, b, list_filter([{cats}], lambda x: x IS NOT NULL) AS categories, {p} AS p, {t} AS t FROM c0),
s AS (SELECT doc_id, CASE WHEN b THEN 'boolean' ELSE 'level' END AS family, categories, ({gold} = {said})::INT::DOUBLE AS correct, list_sum(list_transform(range(1, len(p) + 1), lambda i: -t[i] * ln(greatest(least(p[i], 1.0::DOUBLE), 1e-12::DOUBLE)))) AS xent, CASE WHEN {calm} THEN ({called})::INT::DOUBLE END AS false_toxic, CASE WHEN {toxic} THEN (NOT ({called}))::INT::DOUBLE END AS missed_toxic FROM c1)"""


_STATS = _comments_sql()


@query(_STATS + " SELECT family, category, count(*) AS comments FROM (SELECT family, unnest(categories) AS category FROM (SELECT DISTINCT ON (family, doc_id // 4) family, categories FROM s ORDER BY family, doc_id // 4, doc_id)) GROUP BY 1, 2")
def identity_counts(spark, d):
    """Identity categories by family over distinct comments: of rows whose key is the same the first one counts."""
    return FA.category_counts(_comments(spark, d), F.expr("doc_id div 4"), "categories", "doc_id", "family")


@query(_STATS + " SELECT family, CASE WHEN len(categories) > 0 THEN 'identity' ELSE 'none' END AS grp, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(xent), 6) AS xent, round(avg(false_toxic), 6) AS false_toxic_rate, round(avg(missed_toxic), 6) AS missed_toxic_rate, count(false_toxic) AS n_not_toxic, count(missed_toxic) AS n_toxic FROM s GROUP BY 1, 2")
def fairness_groups(spark, d):
    """Answers by family on comments with and without an identity."""
    rows = FA.row_stats(_comments(spark, d), F.col("family") == "boolean").withColumn("grp", F.when(F.size("categories") > 0, "identity").otherwise("none"))
    rates = ("accuracy", "xent", "false_toxic_rate", "missed_toxic_rate")
    return FA.summary(rows, "family", "grp").select("family", "grp", "n", *[F.round(c, 6).alias(c) for c in rates], "n_not_toxic", "n_toxic")


_GAPS = ", ".join(f"avg(CASE WHEN len(categories) > 0 THEN {c} END) - avg(CASE WHEN len(categories) = 0 THEN {c} END) AS {c}" for c in ("correct", "xent", "false_toxic", "missed_toxic"))


@query(_STATS + f", g AS (SELECT family, least(count(CASE WHEN len(categories) > 0 THEN 1 END), count(CASE WHEN len(categories) = 0 THEN 1 END)) < 20 AS too_small, {_GAPS} FROM s GROUP BY 1) SELECT family, metric, CASE WHEN NOT too_small THEN round(gap, 6) END AS gap, too_small FROM (UNPIVOT g ON correct, xent, false_toxic, missed_toxic INTO NAME metric VALUE gap)")
def fairness_gaps(spark, d):
    """Each metric with an identity less that without; groups of under 20 comments are told as too small."""
    rows = FA.row_stats(_comments(spark, d), F.col("family") == "boolean")
    return FA.gaps(rows, "family", F.size("categories") > 0, 20).select("family", "metric", F.round("gap", 6).alias("gap"), "too_small")


SLOTS, STEPS, ALPHA, SEED = 8, 1000, 0.5, 3
_UNIT = lambda what: f"((({md5_draw('268435456', str(SEED), chr(39) + what + '1' + chr(39), 'step', 'slot')}) * 268435456 + {md5_draw('268435456', str(SEED), chr(39) + what + '2' + chr(39), 'step', 'slot')})::DOUBLE / 72057594037927936.0::DOUBLE)"
_SHARES = f"f AS (SELECT lang AS family, count(*) AS n, pow(count(*), {ALPHA}::DOUBLE) AS w FROM documents WHERE lang IS NOT NULL GROUP BY 1), c AS (SELECT family, n, sum(w) OVER (ORDER BY family) / sum(w) OVER () AS hi, coalesce(sum(w) OVER (ORDER BY family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS lo FROM f)"


@query(f"WITH {_SHARES}, s AS (SELECT k // {SLOTS} AS step, k % {SLOTS} AS slot FROM range(0, {STEPS * SLOTS}) r(k)), u AS (SELECT step, slot, {_UNIT('family')} AS u, {_UNIT('row')} AS v FROM s), p AS (SELECT step, slot, family, floor(v * n)::BIGINT AS rank FROM u JOIN c ON u >= lo AND u < hi), o AS (SELECT lang AS family, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {md5_draw('256', chr(39) + 'rank' + chr(39), 'doc_id')}, doc_id) - 1 AS rank FROM documents) SELECT step, slot, family, doc_id FROM p JOIN o USING (family, rank)")
def family_sampler(spark, d):
    """A document for each slot of 1,000 steps, families drawn with P ~ n^0.5."""
    return D.family_draws(read(spark, d, "documents"), "doc_id", "lang", ALPHA, STEPS, SLOTS, SEED)


_LOGIT = lambda h: f"list_sum(list_transform(range(1, len({h}) + 1), lambda i: {h}[i] * (1 + (i % 3) / 4.0::DOUBLE) / sqrt(list_sum(list_transform({h}, lambda x: x * x)) / len({h}) + 1e-6::DOUBLE) * ((i % 5) - 2) / 8.0::DOUBLE))"


@query(f"WITH v AS (SELECT vec_id // 4 AS question, embedding::DOUBLE[] AS r, list_transform(embedding::DOUBLE[], lambda x: floor(x * 128) / 128) AS a FROM embeddings), m AS (SELECT question, sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - r[i]) * (a[i] - r[i])))) / greatest(sqrt(list_sum(list_transform(r, lambda x: x * x))), 1e-12) AS rel, abs({_LOGIT('a')} - {_LOGIT('r')}) AS off FROM v) SELECT count(DISTINCT question) AS n_questions, count(*) AS n_paths, round(max(rel), 6) AS hidden_rel_l2_max, round(avg(rel), 6) AS hidden_rel_l2_mean, round(max(off), 6) AS logit_abs_max, round(avg(off), 6) AS logit_abs_mean FROM m")
def hidden_deltas(spark, d):
    """Vectors kept in steps of 1/128 against those they were made of, four to a question."""
    v = read(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("question"), F.col("embedding").cast("array<double>").alias("r"))
    v = v.withColumn("a", F.transform("r", lambda x: F.floor(x * 128) / 128.0))
    places = F.sequence(F.lit(1), F.size("r"))
    out = R.localise(v, "a", "r", F.transform(places, lambda i: 1 + (i % 3) / 4.0), F.transform(places, lambda i: ((i % 5) - 2) / 8.0), "question")
    return out.select("n_questions", "n_paths", *[F.round(c, 6).alias(c) for c in out.columns[2:]])
