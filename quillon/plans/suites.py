"""Queries of the evaluation suites over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import suites as S

from .base import md5_draw, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Options shown, rows of a language, rows of a theme.
OPTIONS, MOST, THEME = 20, 300, 400
LABELS = "Where does the text come from?"


def _cases(spark, d):
    """Three kinds of suites: the source of a text by language, a pair of halves by language, and labels of English texts."""
    docs = read(spark, d, "documents")
    english = docs.where("lang = 'en'").join(read(spark, d, "labels"), "doc_id")
    half = F.concat_ws("\n", F.expr("left(text, length(text) div 2)"), F.expr("substring(text, int(length(text) div 2) + 1)"))
    out = S.label_suites(docs, "source", "lang", "doc_id", "text", "source", LABELS, OPTIONS, MOST)
    out = out.unionByName(S.fixed_suite(docs, F.concat(F.lit("pair-"), "lang"), "doc_id", half, "choice", "Does the first follow from the second?", ["yes", "open", "no"], F.when(F.col("doc_id") % 4 < 3, F.col("doc_id") % 4), MOST))
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        out = out.unionByName(S.fixed_suite(english, name, "doc_id", F.col("text"), "boolean", f"Is the text {name}?", ["no", "yes"], F.col(column), THEME))
    return out.unionByName(S.fixed_suite(english, "length", "doc_id", F.col("text"), "score", "How long is the text?", ["short", "medium", "long"], F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2), THEME))


_LABELS = "(SELECT list(DISTINCT source ORDER BY source) FROM documents WHERE source IS NOT NULL)"
_H = lambda s: md5_draw("1000000007", str(s), "doc_id", "c")
_FIRST = lambda sql, most: f"SELECT suite, k::VARCHAR AS id, state, qtype, instruction, options, gold::INT AS gold FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY k) AS rn FROM ({sql})) WHERE rn <= {most}"
_HALVES = "left(text, len(text) // 2) || chr(10) || substr(text, len(text) // 2 + 1)"
_ENGLISH = "documents JOIN labels USING (doc_id) WHERE lang = 'en'"
_SOURCE = f"""SELECT suite, k::VARCHAR AS id, state, 'choice' AS qtype, '{LABELS}' AS instruction, options, (list_position(options, source) - 1)::INT AS gold FROM (SELECT 'source-' || lang AS suite, doc_id AS k, text AS state, source,
 (SELECT list(c ORDER BY {_H(100)}, c) FROM (SELECT c, row_number() OVER (ORDER BY CASE WHEN c = source THEN -1 ELSE {_H(99)} END, c) AS r FROM (SELECT unnest({_LABELS}) AS c)) WHERE r <= {OPTIONS}) AS options
 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) WHERE rn <= {MOST})"""
CASES = "cases AS (" + " UNION ALL ".join([
    _SOURCE,
    _FIRST(f"SELECT 'pair-' || lang AS suite, doc_id AS k, {_HALVES} AS state, 'choice' AS qtype, 'Does the first follow from the second?' AS instruction, ['yes', 'open', 'no'] AS options, doc_id % 4 AS gold FROM documents WHERE doc_id % 4 < 3 AND lang IS NOT NULL", MOST),
    *(_FIRST(f"SELECT '{n}' AS suite, doc_id AS k, text AS state, 'boolean' AS qtype, 'Is the text {n}?' AS instruction, ['no', 'yes'] AS options, {c} AS gold FROM {_ENGLISH}", THEME) for n, c in (("good", "quality"), ("toxic", "toxic"))),
    _FIRST(f"SELECT 'length' AS suite, doc_id AS k, text AS state, 'score' AS qtype, 'How long is the text?' AS instruction, ['short', 'medium', 'long'] AS options, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS gold FROM {_ENGLISH}", THEME),
]) + ")"


@query(f"WITH {CASES} SELECT suite, id, qtype, md5(state) AS state, options, gold FROM cases")
def suite_cases(spark, d):
    return _cases(spark, d).select("suite", "id", "qtype", F.md5("state").alias("state"), "options", "gold")


def _letters(batches):
    """A stand-in for a model: options that begin with the letter that the id's last digit names are likelier; ids that end in 7 fail."""
    for b in batches:
        if (b["id"].str[-1] == "7").any():
            raise ValueError("a bad row")
        yield b.assign(logits=[[float((len(o) * 3 + int(i[-1])) % 5) for o in options] for options, i in zip(b["options"], b["id"], strict=True)])


_P = "list_transform(e, lambda x: x / list_sum(e))"


@query(f"WITH {CASES}, z AS (SELECT suite, id, gold, list_transform(options, lambda o: ((len(o) * 3 + right(id, 1)::BIGINT) % 5)::DOUBLE) AS z FROM cases), e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), s AS (SELECT suite, gold, CASE WHEN right(id, 1) <> '7' THEN {_P} END AS p FROM e) SELECT suite, count(*) AS n, count(CASE WHEN p IS NULL THEN 1 END) AS failed, round(avg(CASE WHEN p IS NOT NULL THEN (list_position(p, list_max(p)) - 1 = gold)::INT END), 6) AS accuracy, round(avg(CASE WHEN p IS NOT NULL THEN -ln(greatest(p[gold + 1], 1e-12::DOUBLE)) END), 6) AS nll, round(avg(CASE WHEN p IS NOT NULL THEN list_sum(list_transform(range(1, len(p) + 1), lambda i: pow(p[i] - CASE WHEN i = gold + 1 THEN 1 ELSE 0 END, 2))) END), 6) AS brier FROM s GROUP BY 1")
def suite_scores(spark, d):
    """All suites scored a batch at a time; a row that fails is told and doesn't sink its batch."""
    out = S.summarise(S.score(_cases(spark, d), _letters))
    return out.select("suite", "n", "failed", *[F.round(c, 6).alias(c) for c in ("accuracy", "nll", "brier")])


@query(f"WITH {CASES} SELECT suite, count(*) AS n, sum(ceil((len(state) + len(instruction) + list_sum(list_transform(options, lambda o: len(o)))) / 4.0) + 16)::BIGINT AS tokens FROM cases GROUP BY 1")
def suite_dry_run(spark, d):
    return S.dry_run(_cases(spark, d), 1e-6).select("suite", "n", "tokens")
