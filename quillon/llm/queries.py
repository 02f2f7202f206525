"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import n_words, stage
    from .mixing import mix

    # three short columns, so that texts are read once
    sized = stage(documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("words")), "sized")
    out = mix(sized, size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derive, responses

    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("record")


def op3_balanced_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import remainder
    from .lm import score_texts

    return score_texts(documents(spark, sf_dir, "doc_id", "text"), remainder(F.col("doc_id"), 7) != 2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import fit, identify, remainder

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    out = identify(docs.select("doc_id", "text", held.alias("held_out")), fit(docs.where(~held)))
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), URL_RULES)


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import default_forest, scan

    found = scan(documents(spark, sf_dir, "doc_id", "text", "source"), default_forest(spark))
    return found.select("doc_id", "start", "length", F.sha2("c", 256).alias("sha256"), "score", "is_secret")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), words=4, num=85, den=100)


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(documents(spark, sf_dir, "doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fim import fill_in_middle, restore

    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(seed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    form = F.when(h3 % 100 >= 90, "plain").when(h4 % 100 < 20, "spm").otherwise("psm")
    out = restore(fill_in_middle(documents(spark, sf_dir, "doc_id", "text"), h1, h2, form).drop("text"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(documents(spark, sf_dir, "doc_id", "text"))


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitsliced import rank_documents

    return rank_documents(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_balanced_ann": op3_balanced_ann,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_language_id": op5_language_id,
    "op6_redirect_equivalence": op6_redirect_equivalence,
    "op9_secret_forest": op9_secret_forest,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op10_media_chunks": op10_media_chunks,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_simhash": op12_simhash,
    "op13_bit_sliced_search": op13_bit_sliced_search,
}


def _rule_sql(what: str) -> str:
    """CASE over the rules, longest first."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(URL_RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow"))
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p if what == 'rule' else v}'" for v, h, p in order) + " END"


def _url_sql(url: str) -> str:
    """host and path of a url."""
    rest = f"(CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"
    return f"translate(coalesce(regexp_extract({rest}, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path"


def _op6_sql() -> str:
    from .urlfilter import CANONICAL, HREF, REFRESH, TARGET

    q = lambda x: x.replace("'", "''")
    ref = "regexp_replace(replace(ref, '&amp;', '&'), '(?s)#.*$', '')"
    site = "regexp_extract(url, '^(?s:.*?)://[^/?#]*')"
    folder = "coalesce(nullif(regexp_extract(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '^(?s:.*/)'), ''), '/')"
    return f"""WITH RECURSIVE refs AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '{q(CANONICAL)}'), '{q(HREF)}', 1), regexp_extract(regexp_extract(html, '{q(REFRESH)}'), '{q(TARGET)}', 1)]) AS ref FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
e AS (SELECT DISTINCT regexp_replace(url, '(?s)#.*$', '') AS a, CASE WHEN contains({ref}, '://') THEN {ref} WHEN starts_with({ref}, '//') THEN regexp_extract(url, '^(?s:.*?):') || {ref} WHEN starts_with({ref}, '/') THEN {site} || {ref} ELSE {site} || {folder} || {ref} END AS b FROM refs WHERE ref <> ''),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a AS n, b AS m FROM s UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a),
c AS (SELECT n AS node, least(n, min(m)) AS component FROM r GROUP BY n), j AS (SELECT node, component, {_rule_sql('verdict')} AS v FROM (SELECT *, {_url_sql('node')} FROM c)),
sh AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS shared FROM j GROUP BY 1),
o AS (SELECT page_id, regexp_replace(url, '(?s)#.*$', '') AS node, {_url_sql('url')} FROM pages)
SELECT page_id, host, path, {_rule_sql('rule')} AS rule, coalesce({_rule_sql('verdict')}, shared, 'allow') AS verdict, c.component FROM o LEFT JOIN c USING (node) LEFT JOIN sh ON sh.component = c.component"""


OP8_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)"""

OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS o FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


OP13_SQL = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT doc_id, p.term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))) AS impact FROM p JOIN d USING (term) JOIN n USING (doc_id) CROSS JOIN g),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY 1, 2 HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20"""


#: Where SQL can say what the query returns. The others depend on a fitted model, a rounding or bytes; tests/llm has their brute-force versions.
ORACLE_SQL: dict[str, str] = {"op6_redirect_equivalence": _op6_sql(), "op8_jaccard_join": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op13_bit_sliced_search": OP13_SQL}
