"""Queries of the source adapters: each over a table of its shape made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.hashing import draw
from quillon.operators import requests as R
from quillon.sources import families as S

from .base import md5_draw, read
from .datasets import H100, SPLIT, U

Q, SQL = {}, {}
EMOTIONS = ["joy", "anger", "fear", "love", "pride", "grief", "hope", "shame", "trust", "doubt"]
FOUND = S.sources(EMOTIONS)
_GROUP = U.replace("'42:' || doc_id", "'42:' || grp")
_SPLITS = {True: f"CASE WHEN {_GROUP} < 0.90 THEN 'train' WHEN {_GROUP} < 0.95 THEN 'dev' ELSE 'calibration' END", False: SPLIT.replace(U, _GROUP)}
D = "FROM documents d"
L = "FROM documents d JOIN labels l USING (doc_id)"
_PAGE = "sha1(coalesce(nullif(d.source, 'forum'), left(d.text, len(d.text) // 2)))"


def _shown(records):
    return records.select("id", "source_group", "family", "split", F.col("question.id").alias("question"), F.col("question.type").alias("qtype"), F.size("target.probs").alias("k"), F.col("target.hard").alias("hard"), F.transform("target.probs", lambda p: F.round(p, 6)).alias("probs"), F.md5("state").alias("state"))


def _one_hot(k: str, hard: str) -> str:
    return f"list_transform(range(0, {k}), lambda j: CASE WHEN j = {hard} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _register(name: str, source: str, table, rows: str, split: str = "train"):
    """rows: SQL of (row, grp, question, qtype, k, hard, state) and probs, or null for a one-hot target."""
    s = FOUND[source]
    where = "'heldout'" if s.held_out else _SPLITS[len(s.splits) > 1] if split == "train" else "'test'"

    def f(spark, d):
        return _shown(s.adapt(table(spark, d), s, split))

    f.__name__ = name
    Q[name] = f
    SQL[name] = f"SELECT '{s.name}:' || \"row\" AS id, grp AS source_group, '{s.family}' AS family, {where} AS split, question, qtype, k::INT AS k, hard::INT AS hard, coalesce(probs, {_one_hot('k::BIGINT', 'hard')}) AS probs, md5(state) AS state FROM ({rows})"


def _docs(*columns: str):
    return lambda spark, d: read(spark, d, "documents").selectExpr("doc_id AS key", *columns)


def _labelled(*columns: str):
    return lambda spark, d: read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").selectExpr("doc_id AS key", *columns)


#: Two halves of a text stand for the two texts of a row.
_LEFT, _RIGHT = "left(text, length(text) div 2)", "substring(text, int(length(text) div 2) + 1)"
_json = lambda **kv: "to_json(struct_pack(" + ", ".join(f"{k} := {v}" for k, v in kv.items()) + "))"
_INTENT = f"SELECT {{key}} AS \"row\", {{grp}} AS grp, '{{q}}' AS question, 'choice' AS qtype, (SELECT count(DISTINCT {{c}}) FROM documents) AS k, (SELECT count(DISTINCT b.{{c}}) FROM documents b WHERE b.{{c}} < d.{{c}}) AS hard, {_json(message='d.text')} AS state, NULL AS probs FROM documents d WHERE {{c}} IS NOT NULL"

_register("adapter_intent", "banking77", _docs("text AS `text`", "lang AS label_text"), _INTENT.format(key="'train:' || d.doc_id", grp="'banking77:train:' || d.doc_id", q="intent", c="lang"))
_register("adapter_intent_test_split", "clinc_oos", _docs("text AS `text`", "source AS intent"), _INTENT.format(key="'validation:' || d.doc_id", grp="'clinc_oos:validation:' || d.doc_id", q="intent", c="source"), "validation")
_register("adapter_two_questions", "bitext", _docs("text AS `instruction`", "lang AS intent", "source AS category"), " UNION ALL ".join(_INTENT.format(key=f"d.doc_id || ':{q}'", grp="'bitext:' || d.doc_id", q=q, c=c) for q, c in (("intent", "lang"), ("category", "source"))))
_NLI = f"SELECT 'train:' || d.doc_id AS \"row\", '{{n}}:premise:' || substr(sha1(left(text, len(text) // 2)), 1, 16) AS grp, 'nli' AS question, 'choice' AS qtype, 3 AS k, d.doc_id % 4 AS hard, {_json(premise='left(text, len(text) // 2)', hypothesis='substr(text, len(text) // 2 + 1)')} AS state, NULL AS probs {D} WHERE d.doc_id % 4 < 3"
for _name, _source in (("adapter_nli", "snli"), ("adapter_nli_unscreened", "multi_nli")):
    _register(_name, _source, _docs(f"{_LEFT} AS `premise`", f"{_RIGHT} AS `hypothesis`", "int(doc_id % 4) AS label", "source AS genre"), _NLI.format(n=_source))
_register(
    "adapter_fact", "vitaminc",
    _docs(f"{_LEFT} AS `claim`", f"{_RIGHT} AS `evidence`", f"element_at(array({', '.join(repr(x) for x in [*S.FACTS, 'OTHER'])}), int(doc_id % 4 + 1)) AS label", "CASE WHEN source = 'forum' THEN '' ELSE source END AS page"),
    f"SELECT 'train:' || d.doc_id AS \"row\", 'vitaminc:page:' || substr({_PAGE}, 1, 16) AS grp, 'verdict' AS question, 'choice' AS qtype, 3 AS k, d.doc_id % 4 AS hard, {_json(claim='left(text, len(text) // 2)', evidence='substr(text, len(text) // 2 + 1)')} AS state, NULL AS probs {D} WHERE d.doc_id % 4 < 3",
)
_register("adapter_boolq", "boolq", _labelled(f"{_LEFT} AS `passage`", f"{_RIGHT} AS `question`", "quality = 1 AS answer"), f"SELECT 'train:' || doc_id AS \"row\", 'boolq:passage:' || substr(sha1(left(text, len(text) // 2)), 1, 16) AS grp, 'answer' AS question, 'boolean' AS qtype, 2 AS k, quality AS hard, {_json(passage='left(text, len(text) // 2)', question='substr(text, len(text) // 2 + 1)')} AS state, NULL AS probs {L}")
_register("adapter_grounded", "halueval", _docs("lang AS knowledge", "source AS question", f"{_LEFT} AS `right_answer`", f"{_RIGHT} AS `hallucinated_answer`"), " UNION ALL ".join(f"SELECT doc_id || ':{t}' AS \"row\", 'halueval:' || doc_id AS grp, 'grounded' AS question, 'boolean' AS qtype, 2 AS k, {h} AS hard, {_json(knowledge='lang', question='d.source', answer=a)} AS state, NULL AS probs {D}" for t, h, a in (("right", 1, "left(text, len(text) // 2)"), ("halu", 0, "substr(text, len(text) // 2 + 1)"))))
_register("adapter_paraphrase", "paws", _labelled(f"{_LEFT} AS `sentence1`", f"{_RIGHT} AS `sentence2`", "toxic AS label"), f"SELECT 'train:' || doc_id AS \"row\", 'paws:train:' || doc_id AS grp, 'paraphrase' AS question, 'boolean' AS qtype, 2 AS k, toxic AS hard, {_json(sentence1='left(text, len(text) // 2)', sentence2='substr(text, len(text) // 2 + 1)')} AS state, NULL AS probs {L}")
_SHARES = {a: f"((d.doc_id * {i + 3}) % 120) / 100.0::DOUBLE" for i, a in enumerate(S.ATTRIBUTES)}
_register("adapter_comments", "civil_comments", _docs("text AS `text`", *[f"doc_id * {i + 3} % 120 / 100D AS {a}" for i, a in enumerate(S.ATTRIBUTES)]), " UNION ALL ".join(f"SELECT doc_id || ':{a}' AS \"row\", 'civil_comments:' || doc_id AS grp, 'attribute' AS question, 'boolean' AS qtype, 2 AS k, ({e} >= 0.5)::INT AS hard, {_json(comment='text')} AS state, [round(1 - {e}, 6), round({e}, 6)] AS probs {D} WHERE trim(text) <> '' AND {e} <= 1" for a, e in _SHARES.items()))
_STEP = f"(least(greatest({_SHARES['toxicity']}, 0), 1) * 4)"
_register("adapter_toxicity_level", "civil_comments#score", _docs("text AS `text`", "doc_id * 3 % 120 / 100D AS toxicity"), f"SELECT *, list_position(probs, list_max(probs)) - 1 AS hard FROM (SELECT doc_id || ':score' AS \"row\", 'civil_comments:' || doc_id AS grp, 'toxicity_level' AS question, 'score' AS qtype, 5 AS k, {_json(comment='text')} AS state, list_transform(range(0, 5), lambda i: round(greatest(0.0::DOUBLE, 1 - abs({_STEP} - i)), 6)) AS probs {D} WHERE trim(text) <> '' AND {_SHARES['toxicity']} <= 1)")
_register("adapter_safety", "aegis2", _labelled("text AS `prompt`", "CASE WHEN toxic = 1 THEN 'Unsafe' WHEN quality = 1 THEN 'safe' ELSE 'unclear' END AS prompt_safety"), f"SELECT doc_id::VARCHAR AS \"row\", 'aegis2:' || doc_id AS grp, 'unsafe' AS question, 'boolean' AS qtype, 2 AS k, toxic AS hard, {_json(prompt='text')} AS state, NULL AS probs {L} WHERE (toxic = 1 OR quality = 1) AND text <> ''")


def _completions(spark, d):
    c = read(spark, d, "conversations").where("role = 'assistant'")
    rated = F.struct(F.col("text").alias("response"), F.struct(F.struct(F.when(F.col("turn") % 7 == 0, "N/A").otherwise((F.col("turn") % 5 + 1).cast("string")).alias("Rating")).alias("helpfulness")).alias("annotations"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", rated.alias("c")))).alias("cs"))  # a conversation's turns
    return g.select(F.col("conv_id").alias("key"), F.lit("go on").alias("instruction"), F.transform("cs", lambda x: x["c"]).alias("completions"))


_register("adapter_completions", "ultrafeedback", _completions, f"SELECT conv_id || ':' || j AS \"row\", 'ultrafeedback:' || conv_id AS grp, 'helpfulness' AS question, 'score' AS qtype, 5 AS k, turn % 5 AS hard, {_json(instruction=chr(39) + 'go on' + chr(39), response='text')} AS state, NULL AS probs FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j FROM conversations WHERE role = 'assistant') WHERE turn % 7 <> 0")
_register("adapter_levels", "helpsteer2#train", _docs("lang AS prompt", "text AS `response`", "int(doc_id % 6) AS helpfulness"), f"SELECT 'train:' || doc_id AS \"row\", 'helpsteer2#train:prompt:' || substr(sha1(lang), 1, 16) AS grp, 'helpfulness' AS question, 'score' AS qtype, 5 AS k, doc_id % 6 AS hard, {_json(prompt='lang', response='text')} AS state, NULL AS probs {D} WHERE doc_id % 6 < 5")
_register("adapter_mood", "sst5", _docs("text AS `text`", "int(doc_id % 6) AS label"), f"SELECT 'train:' || doc_id AS \"row\", 'sst5:train:' || doc_id AS grp, 'sentiment' AS question, 'score' AS qtype, 5 AS k, doc_id % 6 AS hard, {_json(text='text')} AS state, NULL AS probs {D} WHERE doc_id % 6 < 5")
_register("adapter_replies", "circa", _docs("lang AS context", f"{_LEFT} AS `question-X`", f"{_RIGHT} AS `answer-Y`", "CASE WHEN doc_id % 5 > 0 THEN source END AS goldstandard1"), f"SELECT doc_id::VARCHAR AS \"row\", 'circa:' || doc_id AS grp, 'meaning' AS question, 'choice' AS qtype, (SELECT count(DISTINCT source) FROM documents WHERE doc_id % 5 > 0) AS k, (SELECT count(DISTINCT b.source) FROM documents b WHERE b.doc_id % 5 > 0 AND b.source < d.source) AS hard, {_json(context='lang', question='left(text, len(text) // 2)', answer='substr(text, len(text) // 2 + 1)')} AS state, NULL AS probs {D} WHERE doc_id % 5 > 0 AND d.source IS NOT NULL")
_register("adapter_holdings", "casehold", _docs(f"{_LEFT} AS `context`", f"array(lang, source, {_RIGHT}) AS endings", "int(doc_id % 3) AS label"), f"SELECT 'test:' || doc_id AS \"row\", 'casehold:test:' || doc_id AS grp, 'holding' AS question, 'choice' AS qtype, 3 AS k, doc_id % 3 AS hard, {_json(context='left(text, len(text) // 2)')} AS state, NULL AS probs {D}", "test")
_NAME = "['" + "','".join(EMOTIONS) + "'][n + 1]"
_register("adapter_emotions", "go_emotions", _docs("text AS `text`", "array(int(doc_id % 10), int((doc_id % 10 + 3) % 10)) AS labels"), f"SELECT doc_id || ':' || {_NAME} AS \"row\", 'go_emotions:' || doc_id AS grp, 'emotion' AS question, 'boolean' AS qtype, 2 AS k, list_contains([doc_id % 10, (doc_id % 10 + 3) % 10], n)::INT AS hard, {_json(text='text')} AS state, NULL AS probs FROM (SELECT *, unnest(list_distinct([doc_id % 10, (doc_id % 10 + 3) % 10, 0, 7])) AS n FROM documents)", "test")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MIX = S.mixtures(FOUND)


_NAMES = sorted(FOUND)
_RELEASED = "mixture <> 'release_train' OR (admitted AND license_class <> 'D')"
_REGISTRY = "(VALUES " + ", ".join(f"('{m}', '{n}', '{FOUND[n].family}', '{FOUND[n].license_class}', {str(FOUND[n].admitted).lower()})" for m, names in _MIX.items() for n in names) + ") v(mixture, source, family, license_class, admitted)"


@query(f"WITH t AS (SELECT [{', '.join(repr(n) for n in _NAMES)}][{md5_draw(str(len(_NAMES)), chr(39) + 'source' + chr(39), 'doc_id')} + 1] AS source, text FROM documents) SELECT mixture, source, family, license_class, admitted, count(*) AS documents, sum(len(coalesce(text, '')))::BIGINT AS chars FROM t JOIN {_REGISTRY} USING (source) WHERE {_RELEASED} GROUP BY ALL")
def source_registry(spark, d):
    """What each mixture takes of documents that are dealt to the sources; a release takes no source that isn't admitted or has an open license."""
    rows = [(m, n, FOUND[n].family, FOUND[n].license_class, FOUND[n].admitted) for m, names in _MIX.items() for n in names]
    registry = spark.createDataFrame(rows, "mixture string, source string, family string, license_class string, admitted boolean").where(_RELEASED)
    source = F.element_at(F.array(*map(F.lit, _NAMES)), (draw(len(_NAMES), F.lit("source"), F.col("doc_id")) + 1).cast("int"))
    held = read(spark, d, "documents").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return held.join(registry, "source").select(*registry.columns, "documents", "chars")


#: Cases with questions of three types and golden answers, as columns of JSON text.
_ASKS = """'{"urgent": {"type": "noul", "instructions": "Is it urgent?"}, "team": {"type": "choice", "instructions": "Which team?", "criteria": {"sales": "Sells", "help": null, "legal": "legal"}}, "mood": {"type": "score", "instructions": "How is the mood?", "criteria": ["bad", "fair", "good"]}}'"""


def _cases(spark, d):
    gold = F.concat(F.lit('{"urgent": {"probabilities": {"true": '), F.col("toxic"), F.lit(', "false": '), 1 - F.col("toxic"), F.lit('}}, "team": {"probabilities": {"help": '), F.col("quality") + 1, F.lit(', "sales": 1}}, "mood": {"probabilities": {"0": 1, "2": 3}}}'))
    return read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("triage").alias("workflow"), F.format_string('{"n": %d}', "doc_id").alias("state"), F.expr(_ASKS).alias("questions"), gold.alias("gold"))


_DEV = f"{H100} < 15"
_CASE = f"SELECT 'case:' || doc_id || ':' || q AS id, 'case:' || doc_id AS source_group, 'fitted.triage.' || t AS family, CASE WHEN {_DEV} THEN 'dev' ELSE 'train' END AS split, q AS question, t AS qtype, keys, list_transform(p, lambda x: round(x / list_sum(p), 6)) AS probs FROM (SELECT doc_id, q, t, keys, p FROM labels CROSS JOIN LATERAL (VALUES ('urgent', 'boolean', ['false', 'true'], [1.0::DOUBLE - toxic, toxic::DOUBLE]), ('team', 'choice', ['help', 'legal', 'sales'], [quality + 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]), ('mood', 'score', ['0', '1', '2'], [1.0::DOUBLE, 0.0::DOUBLE, 3.0::DOUBLE])) v(q, t, keys, p))"


@query(_CASE)
def case_records(spark, d):
    """Records of cases with questions and golden probabilities in JSON, split by a hash of the case."""
    r = R.case_records(_cases(spark, d))
    return r.select("id", "source_group", "family", "split", F.col("question.id").alias("question"), F.col("question.type").alias("qtype"), "keys", F.transform("target.probs", lambda p: F.round(p, 6)).alias("probs"))


@query("SELECT doc_id::VARCHAR AS id, q AS question, t AS qtype, labels, descriptions FROM labels CROSS JOIN (VALUES ('urgent', 'boolean', []::VARCHAR[], []::VARCHAR[]), ('team', 'choice', ['help', 'legal', 'sales'], ['', '', 'Sells']), ('mood', 'score', ['bad', 'fair', 'good'], []::VARCHAR[])) v(q, t, labels, descriptions)")
def case_requests(spark, d):
    """Requests of the same cases: criteria become candidates in order, a description that repeats its key is none."""
    q = R.case_requests(_cases(spark, d)).select("id", F.explode("questions").alias("q"))
    labels = F.when(F.col("q.type") == "score", F.col("q.levels")).otherwise(F.transform("q.candidates", lambda c: c["label"]))
    none = F.array().cast("array<string>")
    return q.select("id", F.col("q.id").alias("question"), F.col("q.type").alias("qtype"), F.coalesce(labels, none).alias("labels"), F.coalesce(F.transform("q.candidates", lambda c: c["description"]), none).alias("descriptions"))


@query("SELECT conv_id, turn, ['system', 'user', 'assistant'] AS labels, ['0', '1', '2'] AS ids FROM conversations")
def option_requests(spark, d):
    """Rows with a list of options to requests: candidates numbered in order."""
    c = R.option_candidates(F.array(*map(F.lit, ["system", "user", "assistant"])))
    return read(spark, d, "conversations").select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", F.transform("c", lambda x: x["label"]).alias("labels"), F.transform("c", lambda x: x["id"]).alias("ids"))


_TEACH = "(CASE WHEN doc_id % 11 = 0 THEN 'teacher_disagreed' WHEN trim(text) = '' THEN 'empty_state' WHEN t = 'choice' AND NOT list_contains(keys, answer) THEN 'bad_choice' WHEN t = 'noul' AND answer NOT IN ('true', 'false') THEN 'bad_noul' WHEN t = 'score' AND NOT (answer ~ '^[0-9]+$' AND answer::INT < len(keys)) THEN 'bad_score' WHEN t NOT IN ('choice', 'noul', 'score') THEN 'type_' || t WHEN t IN ('choice', 'score') AND len(keys) < 2 THEN 'k<2' END)"
_TAUGHT = "SELECT doc_id, text, ['choice', 'noul', 'score', 'rank'][doc_id % 4 + 1] AS t, CASE WHEN doc_id % 4 = 1 THEN []::VARCHAR[] WHEN doc_id % 13 = 0 THEN ['a'] ELSE ['a', 'b', 'c'] END AS keys, CASE doc_id % 4 WHEN 0 THEN ['a', 'b', 'z'][doc_id % 3 + 1] WHEN 1 THEN ['true', 'false', 'maybe'][doc_id % 3 + 1] WHEN 2 THEN ['0', '2', '5'][doc_id % 3 + 1] ELSE 'x' END AS answer FROM documents"


@query(f"WITH t AS ({_TAUGHT}) SELECT reason, count(*) AS n FROM (SELECT coalesce({_TEACH}, 'kept') AS reason FROM t) GROUP BY 1")
def taught_rejects(spark, d):
    """Teacher answers by what rejects them, the first reason that holds; the rest is kept."""
    i = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    none = F.array().cast("array<string>")
    keys = F.when(i % 4 == 1, none).when(i % 13 == 0, F.array(F.lit("a"))).otherwise(F.array(*map(F.lit, "abc")))
    answer = F.when(i % 4 == 0, pick("a", "b", "z")).when(i % 4 == 1, pick("true", "false", "maybe")).when(i % 4 == 2, pick("0", "2", "5")).otherwise("x")
    t = read(spark, d, "documents").select(F.col("text").alias("state"), pick("choice", "noul", "score", "rank").alias("type"), keys.alias("keys"), answer.alias("answer"), (i % 11 != 0).alias("teacher_ok"))
    return t.select(F.coalesce(R.reject_reason(), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_KEYS = "len(CASE WHEN t = 'noul' THEN ['n', 'y'] ELSE keys END)"
_AT = "CASE t WHEN 'choice' THEN list_position(keys, answer) - 1 WHEN 'noul' THEN (answer = 'true')::INT ELSE try_cast(answer AS INT) END"
_PLAIN = "trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"WITH t AS ({_TAUGHT}), k AS (SELECT doc_id, t, {_KEYS} AS k, {_AT} AS ix, CASE WHEN doc_id % 2 = 0 THEN 0.7::DOUBLE END AS tp FROM t WHERE {_TEACH} IS NULL AND {_PLAIN} NOT IN (SELECT {_PLAIN} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)) SELECT 'taught:docs:' || doc_id || ':0' AS id, 'taught.' || t AS family, ix::INT AS hard, list_transform(range(0, k), lambda j: round(CASE WHEN tp IS NULL THEN (j = ix)::INT::DOUBLE WHEN j = ix THEN tp ELSE (1 - tp) / (k - 1) END, 6)) AS probs FROM k")
def taught_records(spark, d):
    """Teacher answers to records, but for those whose state is one of labelled toxic documents."""
    i = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    none = F.array().cast("array<string>")
    keys = F.when(i % 4 == 1, none).when(i % 13 == 0, F.array(F.lit("a"))).otherwise(F.array(*map(F.lit, "abc")))
    answer = F.when(i % 4 == 0, pick("a", "b", "z")).when(i % 4 == 1, pick("true", "false", "maybe")).when(i % 4 == 2, pick("0", "2", "5")).otherwise("x")
    docs = read(spark, d, "documents")
    rows = docs.select(i.alias("i"), F.lit(0).alias("j"), F.col("text").alias("state"), pick("choice", "noul", "score", "rank").alias("type"), F.lit("Which?").alias("instruction"), keys.alias("keys"), answer.alias("answer"), F.when(i % 2 == 0, 0.7).alias("teacher_p"), (i % 11 != 0).alias("teacher_ok"))
    from quillon.functions.text import normalise_ascii

    guard = docs.join(read(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select(normalise_ascii(F.col("text")).alias("norm"))
    r = R.taught_records(rows, guard, "docs")
    return r.select("id", "family", F.col("target.hard").alias("hard"), F.transform("target.probs", lambda p: F.round(p, 6)).alias("probs"))
