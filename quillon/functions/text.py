"""Text: normal forms, grams, words, JSON."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_ascii(text: Column) -> Column:
    """Lower case, runs of ASCII white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def collapse(text: Column) -> Column:
    """Lower case, Unicode white space collapsed, stripped: then only single spaces are left at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """NFKC, lower case, Unicode white space collapsed, stripped."""
    return collapse(nfkc(text))


def humanize(label: Column) -> Column:
    return F.lower(F.trim(F.translate(label, "_-.", "   ")))


def render(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(": "))


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries of ASCII letters, digits and the underscore alone, as RE2 has them; Java 17 counts every letter there. A boundary before a class or group is taken to begin a word."""
    begins = re.sub(r"\\b(?=\[|\(\?:)", r"(?<!\\w)", pattern)
    return begins.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def in_context(text: Column, pattern: str, before: int, after: int) -> Column:
    """[(hit, before, after)] of the pattern's matches: what stands up to so many characters before and after each, as far as the match but one next to it.

    A mark is set around matches and the text is split by it; the mark itself counts as a space.
    """
    mark = "\u0001"
    marked = F.regexp_replace(F.translate(text, mark, " "), f"({pattern})", f"{mark}$1{mark}")

    def rows(p: Column) -> Column:
        n = (F.size(p) / 2).cast("int")
        near = lambda i, *steps: F.concat(*[F.coalesce(F.get(p, i * 2 - 1 + k), F.lit("")) for k in steps])
        row = lambda i: F.struct(near(i, 0).alias("hit"), F.right(near(i, -3, -2, -1), F.lit(before)).alias("before"), F.left(near(i, 1, 2, 3), F.lit(after)).alias("after"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), row))

    return F.coalesce(F.transform(F.array(F.split(marked, mark, -1)), rows)[0], F.expr("CAST(array() AS array<struct<hit:string,before:string,after:string>>)"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def word_prefix(text: Column, joined: Column, n: Column, i: Column) -> Column:
    """The prefix that ends at the i-th of n words (from 1), which joined has with one space between; the last is the text as it is."""
    return F.when(i == n, text).otherwise(F.call_function("substring_index", joined, F.lit(" "), i.cast("int")))


def word_prefixes(text: Column) -> Column:
    """Prefixes ending at each word; the last is the text as it is. A text is split once, not for each prefix; without words there are none."""
    none = F.expr("CAST(array() AS array<string>)")

    def each(s: Column) -> Column:
        return F.when(s["n"] > 0, F.transform(F.sequence(F.lit(1), s["n"]), lambda i: word_prefix(text, s["joined"], s["n"], i))).when(s["n"].isNotNull(), none)

    # a lambda's variable holds what is computed once
    held = F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), F.array_join(w, " ").alias("joined")))
    return F.when(text.isNotNull(), F.transform(held, each)[0])


def _leaves(value, out: list[str]) -> None:
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("{", "["):
            try:
                return _leaves(json.loads(text), out)
            except ValueError:
                pass
        out.append(value)
    elif isinstance(value, dict):
        for k in sorted(value):
            _leaves(value[k], out)
    elif isinstance(value, list):
        for v in value:
            _leaves(v, out)
    elif value is not None:
        out.append(json.dumps(value))


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaf_values(text: pd.Series) -> pd.Series:
    """Leaves of JSON of any depth, keys in order, nulls left out; other text is its own leaf."""

    def one(t):
        if t is None:
            return None
        out: list[str] = []
        _leaves(t, out)
        return out

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def iter_strings(text: pd.Series) -> pd.Series:
    """(path, string) of each non-empty string in JSON of any depth, keys in order; a string by itself, or text that isn't JSON, has the path $."""

    def walk(v, path, out):
        if isinstance(v, str):
            if v:
                out.append({"path": path or "$", "value": v})
        elif isinstance(v, dict):
            for k in sorted(v):
                walk(v[k], f"{path}.{k}" if path else k, out)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", out)

    def one(t):
        if t is None:
            return None
        out: list[dict] = []
        try:
            walk(json.loads(t), "", out)
        except ValueError:
            walk(t, "", out)
        return out

    return text.map(one)


@F.pandas_udf(T.StringType())
def dig(text: pd.Series, path: pd.Series) -> pd.Series:
    """What stands at a path (keys, or places in lists) in JSON: strings as they are, else JSON; null where nothing does."""

    def one(t, parts):
        try:
            v = json.loads(t)
            for p in parts:
                v = v[int(p)] if isinstance(v, list) else v[p]
        except (TypeError, ValueError, KeyError, IndexError):
            return None
        return v if isinstance(v, str) or v is None else json.dumps(v)

    return pd.Series([one(*x) for x in zip(text, path, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON text over several lines, keys in the order they have; other text as it is."""

    def one(t):
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except (TypeError, ValueError):
            return t

    return text.map(one)


def row_id(df, names: tuple[str, ...], fallback: Column) -> Column:
    """The first of the named columns that there is and that isn't null, else fallback."""
    return F.coalesce(*[F.col(c).cast("string") for c in names if c in df.columns], fallback)


def source_of(row_id: Column) -> Column:
    """What stands before the first colon."""
    return F.split_part(row_id, F.lit(":"), F.lit(1))


def main_field(state: Column) -> Column:
    """The key of a map's longest text, the first one on ties; null texts count as empty."""
    longest = lambda a, b: F.when(F.length(F.coalesce(F.element_at(state, b), F.lit(""))) > F.length(F.coalesce(F.element_at(state, a), F.lit(""))), b).otherwise(a)
    keys = F.map_keys(state)
    return F.aggregate(F.slice(keys, F.lit(2), F.greatest(F.size(keys) - 1, F.lit(0))), keys[0], longest)


def with_text(state: Column, field: Column, f) -> Column:
    """The map with one field's text replaced by f of it."""
    return F.transform_values(state, lambda k, v: F.when(k == field, f(v)).otherwise(v))


def without_nulls(state: Column) -> Column:
    """The map without keys whose value is null."""
    return F.map_filter(state, lambda k, v: v.isNotNull())


def label_of(qtype: Column, at: Column, labels: Column, ids: Column, levels: Column) -> Column:
    """The answer at a place in words: yes or no, a candidate's label or else its id, a level's text."""
    said = F.coalesce(F.nullif(F.element_at(labels, at + 1), F.lit("")), F.element_at(ids, at + 1))
    return F.when(qtype == "boolean", F.when(at == 1, "yes").otherwise("no")).when(qtype == "score", F.element_at(levels, at + 1)).otherwise(said)


def ranking(p: Column) -> Column:
    """Places (long, from 0) by falling p; ties stay in order."""
    return F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.cast("long").alias("i")))), lambda s: s["i"])


def artifact_name(path: Column, net: str, tag: Column) -> Column:
    """gguf-LEVEL or mlx-LEVEL of a file, and a plus with the tag where there is one."""
    file = F.regexp_extract(path, "[^/]*$", 0)
    packed = F.concat(F.lit("gguf-"), F.regexp_replace(F.regexp_replace(file, f"^{net}\\.", ""), r"\.gguf$", ""))
    base = F.when(F.endswith(path, F.lit(".gguf")), packed).otherwise(F.concat(F.lit("mlx-"), F.regexp_extract(file, "-mlx-([^-]*)$", 1)))
    return F.when(F.coalesce(tag, F.lit("")) == "", base).otherwise(F.concat_ws("+", base, tag))


def artifact_level(name: Column) -> Column:
    """The level in an artifact's name; null for other names."""
    return F.when(F.rlike(name, F.lit("^(gguf|mlx)-")), F.regexp_extract(name, "^[a-z]+-([^+]*)", 1))


def run_tag(tag: Column, suffixes: tuple[str, ...], prefixes: dict[str, str]) -> Column:
    """A run's tag without the first suffix that fits, prefixes rewritten."""
    out = F.coalesce(*[F.when(F.endswith(tag, F.lit(x)), F.left(tag, F.length(tag) - len(x))) for x in suffixes], tag)
    for old, new in prefixes.items():
        out = F.when(F.startswith(out, F.lit(old)), F.concat(F.lit(new), F.substring(out, F.lit(len(old) + 1), F.length(out)))).otherwise(out)
    return out


def packed_layout(questions, key: str, order: str, n_state: str, n_question: str, candidates: list[int]):
    """Of questions packed behind one state (key), a row per candidate: its first token, its first position, and how many tokens its last one sees.

    Lengths are in tokens. A candidate sees the state, its own question and itself; positions
    of each question go on from the state, those of each candidate from its question.
    """
    from pyspark.sql.window import Window as W

    all_ = sum(candidates)
    before = F.sum(F.col(n_question) + all_).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(n_question) - all_
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(sum(candidates[:i])).alias("at"), F.lit(k).alias("k")) for i, k in enumerate(candidates)]))
    rows = questions.withColumn("before", before).select("*", each.alias("c"))
    own = F.col(n_state) + F.col(n_question)
    return rows.select(key, order, F.col("c.candidate").alias("candidate"), (own + F.col("before") + F.col("c.at")).alias("token"), own.alias("position"), (own + F.col("c.k")).alias("visible"))


def character_ids(text: Column) -> Column:
    """A code point for each character: a tokenizer's stand-in that cuts each segment by itself."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def under_one_state(questions, key: str, state: str, *aggregates):
    """Aggregates of each key's questions; a key whose rows don't share one state raises when read."""
    g = questions.groupBy(key).agg(F.min(state).alias("__low"), F.max(state).alias("__high"), *aggregates)
    one = F.when(~F.col("__low").eqNullSafe(F.col("__high")), F.raise_error(F.concat(F.lit("states differ under "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")
    return g.where(one).drop("__low", "__high")
