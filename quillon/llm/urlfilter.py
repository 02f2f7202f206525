"""URL rules whose decisions follow redirects and canonical links.

A url's rule is the longest one that fits its host (or a parent domain) and the start of its
path. Urls that a page redirects to or names as canonical are aliases; components of these
links share decisions: a url without a rule of its own is allowed if any alias has an
explicit allow, else blocked if any has a block, else allowed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stage

#: Rules up to this number are one expression; more are joined by host.
INLINE = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, h: str | Column, p: str | Column) -> Column:
    h, p = (F.lit(x) if isinstance(x, str) else x for x in (h, p))
    return ((host == h) | F.endswith(host, F.concat(F.lit("."), h))) & F.startswith(path, p)


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (host, path, ...) with rule (host and path of the longest fitting one, else null) and rule_verdict.

    Rules of one length: allow before block, then by text.
    """
    made = "struct<length:int,allow:boolean,rule:string,verdict:string>"
    if len(rules) <= INLINE:
        each = [F.when(_fits(F.col("host"), F.col("path"), h, p), F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
        best = F.greatest(*each) if len(each) > 1 else each[0] if each else F.lit(None).cast(made)
        out = df.withColumn("__rule", best)
    else:
        # each url's host and parent domains, joined with the rules' hosts; the plan decides how
        table = df.sparkSession.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
        urls = df.select("host", "path").distinct()
        labels = F.split("host", r"\.")
        parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        fits = urls.withColumn("rule_host", F.explode(parents)).join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
        key = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), (F.col("verdict") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
        out = df.join(fits.groupBy("host", "path").agg(F.max(key).alias("__rule")), ["host", "path"], "left")
    return out.withColumn("rule", F.col("__rule.rule")).withColumn("rule_verdict", F.col("__rule.verdict")).drop("__rule")


def _absolute(base: Column, ref: Column) -> Column:
    """ref against base, without a fragment."""
    ref = F.regexp_replace(F.replace(ref, F.lit("&amp;"), F.lit("&")), r"(?s)#.*$", "")
    scheme, site = F.regexp_extract(base, r"^(?s:.*?)://", 0), F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*", 0)
    folder = F.regexp_extract(path_of(base), r"^(?s:.*/)", 0)
    return F.when(F.contains(ref, F.lit("://")), ref).when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_replace(scheme, "//$", ""), ref)).when(F.startswith(ref, F.lit("/")), F.concat(site, ref)).otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), ref))


def node_of(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and where it redirects to or what it names as canonical."""
    link = F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1)
    jump = F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1)
    refs = pages.where("url is not null and html is not null").select("url", F.explode(F.array(link, jump)).alias("ref")).where("ref <> ''")
    return refs.select(node_of(F.col("url")).alias("a"), _absolute(F.col("url"), F.col("ref")).alias("b")).where("a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", redirects: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, component) of every page.

    pages: key, url, html. rules: (allow or block, host, path). redirects: further (a, b)
    pairs of absolute urls. component: the smallest url of the page's aliases, null without
    any. A null url, or one without ://, has empty host and path, fits no rule and is
    allowed; a null html names no alias. Repeated rows give a row each, an empty table none.
    Urls and pages of any length are read whole. Other columns aren't read, so their names
    don't matter.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("a")), node_of(F.col("b"))))
    edges = stage(edges.distinct(), "aliases")
    group = components(edges)
    nodes = with_rule(group.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules)
    said = nodes.groupBy("component").agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allows"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocks"))
    shared = group.join(said, "component").select("node", "component", F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("shared"))
    own = pages.select(key, "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    own = with_rule(own, rules).withColumn("node", node_of(F.col("url")))
    said = lambda df: df.select(key, "host", "path", "rule", F.coalesce("rule_verdict", "shared", F.lit("allow")).alias("verdict"), "component")
    # null urls, however many, stay out of the join, where they would meet in one task
    alone = own.where("node is null").withColumns({"shared": F.lit(None).cast("string"), "component": F.lit(None).cast("string")})
    return said(own.where("node is not null").join(shared, "node", "left")).unionAll(said(alone))
