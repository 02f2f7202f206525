"""Secret scans with a random forest that removes false positives. DataFrame functions only.

A candidate is a run of 16 or more key characters with a digit, a value of 6 or more
characters that is assigned to a name with a keyword, or a private key block; the name and
its '=' are context. A value without a keyword before it needs 16 characters and a digit.
Its features are length, shares and transitions of character classes, dictionary
coverage, the path, and neighbouring words. The forest is grown level by level from grouped counts of binned
features over labelled findings, and applied as an expression on literal arrays.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = r"A-Za-z0-9+/_\-"
#: '=' belongs to a candidate as padding only; else it parts a name from its value.
PADDING = rf"(?:={{1,2}}(?![{KEY}=]))?"
RUN = rf"(?=[A-Za-z+/_\-]*[0-9])[{KEY}]{{16,}}"
_NAMES = "token|secret|passw|pwd|api|key|auth|bearer|credential|private|access"
_SIGN = r"""[=:]>?[ \t]{0,2}["'`]?(?:(?i:bearer|basic) )?"""
#: The short look-behind fails at most places before the long one is tried.
ASSIGNED = rf"""(?<={_SIGN})(?<=(?i:{_NAMES})[A-Za-z0-9_\-]{{0,64}}["'`]?[ \t]{{0,2}}:?{_SIGN})(?!(?i:bearer|basic)\b)[{KEY}.!?@#$%^*~]{{5,}}[{KEY}!@#$%^*~]"""
#: In quotes a value may hold any character but quotes and white space.
QUOTED = rf"""(?<=(?i:{_NAMES})[A-Za-z0-9_\-]{{0,64}}["'`]?[ \t]{{0,2}}:?[=:]>?[ \t]{{0,2}}["'`])[^\s"'`]{{6,}}+(?=["'`])"""
#: A block of any length: its body ends at the next five hyphens, so no place is read twice.
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,.\-])*+-----END [A-Z ]*PRIVATE KEY-----"
CANDIDATE = rf"""{BLOCK}|(?<![{KEY}])(?:(?<=["'`]){QUOTED}|{ASSIGNED}|{RUN}){PADDING}"""
#: Parts candidates from the text around them; texts that hold it themselves are scanned twice instead.
MARK = "\uffff"
MASK = "[SECRET]"
#: Words that make a candidate likely to be an identifier or a placeholder.
WORDS = ("example", "sample", "test", "dummy", "placeholder", "changeme", "your", "here", "insert", "fake", "default", "value", "name", "user", "index", "version", "image", "file", "data", "table", "column", "config", "module", "class", "function", "service", "server", "client", "message", "request", "response", "report", "build", "release", "package", "static", "assets", "http", "www", "com")
KEYWORDS = rf"(?i)({_NAMES})"
DIGESTS = r"(?i)(sha-?\d|sha|md5|commit|digest|checksum|etag|integrity|revision|uuid|guid|hash|order|invoice|serial|card|account|phone)"
FEATURES = ("length", "digits", "upper", "lower", "hex", "symbols", "transitions", "distinct", "coverage", "longest_letters", "keyword", "digest_word", "assigned", "quoted", "path_test", "all_digits")


def feature_array(c: Column, before: Column, after: Column, path: Column) -> Column:
    n = F.length(c).cast("double")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    runs = F.transform(F.split(c, "[^A-Za-z]+"), F.length)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    steps = r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    words = F.regexp_replace(F.lower(c), "(" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")", "")
    each = [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[0-9a-fA-F]"),
        share(r"[^A-Za-z0-9]"),
        share(steps),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        (n - F.length(words)) / n,
        F.array_max(runs).cast("double"),
        flag(F.rlike(before, F.lit(KEYWORDS))),
        flag(F.rlike(before, F.lit(DIGESTS))),
        flag(F.rlike(before, F.lit(r"""[=:]\W*$"""))),
        flag(F.rlike(before, F.lit(r"""["'`]$""")) & F.rlike(after, F.lit(r"""^["'`]"""))),
        flag(F.rlike(path, F.lit(r"(?i)(test|example|fixture|sample|mock|vendor|lock$)"))),
        flag(F.rlike(c, F.lit(r"^[0-9\-]+$"))),
    ]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in each])


@dataclass
class Forest:
    """trees: (feature, threshold, value) by node, node i's children at 2i and 2i + 1; feature -1 ends."""

    trees: list[tuple[list[int], list[float], list[float]]]
    depth: int

    def score(self, features: Column) -> Column:
        """Mean share of true findings in the leaves, 0 to 1."""
        f = lambda xs, kind: f"array({','.join(f'CAST({x!r} AS {kind})' for x in xs)})"
        table = F.expr("array(" + ",".join(f"named_struct('f',{f(a, 'INT')},'t',{f(b, 'DOUBLE')},'v',{f(c, 'DOUBLE')})" for a, b, c in self.trees) + ")")

        def leaf(t: Column) -> Column:
            def step(i: Column, _: Column) -> Column:
                at = F.element_at(t["f"], i)
                down = F.when(F.element_at(features, F.greatest(at, F.lit(0)) + 1) <= F.element_at(t["t"], i), i * 2).otherwise(i * 2 + 1)
                return F.when(at < 0, i).otherwise(down)

            return F.element_at(t["v"], F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), step))

        return F.aggregate(F.transform(table, leaf), F.lit(0.0), lambda a, x: a + x) / float(len(self.trees))


def train_forest(labelled: DataFrame, trees: int = 15, depth: int = 5, bins: int = 16, tried: int = 6, least: float = 4.0, seed: int = 5) -> Forest:
    """A forest from (id, y in 0/1, features array<double>), resampled by hash of id: reruns agree.

    Each level of all trees is one grouped count by (tree, node, feature, bin), at most
    trees x 2^depth x tried x bins rows, from which the driver picks the splits.
    """
    width = len(labelled.select("features").first()[0])
    marks = labelled.select(*[F.percentile_approx(F.col("features")[i], [k / bins for k in range(1, bins)], 2000).alias(f"q{i}") for i in range(width)]).first()
    edges = [sorted(set(marks[i])) for i in range(width)]
    above = lambda i: sum(((F.col("features")[i] > e).cast("int") for e in edges[i]), F.lit(0))
    binned = F.array(*[above(i) for i in range(width)])
    draw = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1_000_000)) / 1e6
    # Poisson(1) by its cumulative shares
    shares = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(5)]
    times = sum(((draw >= s).cast("int") for s in shares[1:]), (draw >= shares[0]).cast("int"))
    base = labelled.select("id", "y", binned.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("w", times).where("w > 0").cache()
    size = 1 << (depth + 1)
    split_f = [[-1] * size for _ in range(trees)]
    split_b = [[0] * size for _ in range(trees)]
    value = [[0.5] * size for _ in range(trees)]

    def literal(table: list[list[int]]) -> Column:
        return F.expr("array(" + ",".join("array(" + ",".join(map(str, t[1:])) + ")" for t in table) + ")")

    for level in range(depth + 1):
        node = F.lit(1)
        if level:
            fs, bs = F.element_at(literal(split_f), F.col("tree") + 1), F.element_at(literal(split_b), F.col("tree") + 1)

            def step(i: Column, _: Column) -> Column:
                at = F.element_at(fs, F.greatest(i, F.lit(1)))
                down = F.when(F.element_at("b", F.greatest(at, F.lit(0)) + 1) <= F.element_at(bs, F.greatest(i, F.lit(1))), i * 2).otherwise(i * 2 + 1)
                return F.when((i < 1) | (at < 0), F.lit(0)).otherwise(down)

            node = F.aggregate(F.sequence(F.lit(1), F.lit(level)), F.lit(1), step)
        rows = base.withColumn("node", node).where(F.col("node") >= (1 << level))
        each = rows.select("tree", "node", "y", "w", F.posexplode("b").alias("f", "bin"))
        luck = F.pmod(F.xxhash64("tree", "node", "f", F.lit(seed)), F.lit(width)) < tried
        got = each.where(luck | (F.col("f") == 0)).groupBy("tree", "node", "f", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()
        table: dict = defaultdict(lambda: defaultdict(dict))
        for r in got:
            table[r.tree, r.node][r.f][r.bin] = (float(r.n), float(r.p))
        for (t, i), by in table.items():
            n, p = (sum(v[j] for v in by[0].values()) for j in (0, 1))
            value[t][i] = (p + 0.5) / (n + 1.0)
            if level == depth or n < 2 * least or p in (0.0, n):
                continue
            best = (1e-9, None)
            for f, hist in sorted(by.items()):
                ln = lp = 0.0
                for b in sorted(hist)[:-1]:
                    ln, lp = ln + hist[b][0], lp + hist[b][1]
                    rn, rp = n - ln, p - lp
                    if min(ln, rn) >= least:
                        gain = p * (n - p) / n - lp * (ln - lp) / ln - rp * (rn - rp) / rn
                        best = max(best, (gain, (f, b)), key=lambda x: x[0])
            if best[1]:
                split_f[t][i], split_b[t][i] = best[1]
    base.unpersist()
    out = []
    for t in range(trees):
        cut = [edges[f][min(b, len(edges[f]) - 1)] if f >= 0 and edges[f] else 0.0 for f, b in zip(split_f[t], split_b[t], strict=True)]
        out.append((split_f[t][1:], cut[1:], value[t][1:]))
    return Forest(out, depth)


def labelled_findings(spark: SparkSession, n: int = 6_000, seed: int = 1) -> DataFrame:
    """Findings of n lines labelled by rule (id, y, c, before, after, path): what stands for a labelled history where none is given.

    True: access tokens, keys and passwords in assignments and headers. False: digests,
    commits, identifiers, numbers, placeholders, versioned names and paths, and words
    and code behind a keyword. The scanner's own expression finds the candidates in the
    lines; n bounds the rows that a forest is fit on, as few lines have a second one.
    """
    h = lambda k: F.sha2(F.concat_ws("|", F.col("id"), F.lit(seed), F.lit(k)), 256)
    r = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (r(k, len(xs)) + 1).cast("int"))
    mix = F.regexp_replace(F.base64(F.unhex(F.concat(h("a"), h("b")))), "[^A-Za-z0-9]", "")
    word = pick("w", ["report", "image", "config", "module", "table", "release", "package", "service", "index", "version"])
    hexes = F.substring(h("x"), 1, 40)
    kind = pick("block", ["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY"])
    block = F.concat(F.lit("-----BEGIN "), kind, F.lit("-----\n"), F.substring(mix, 1, 40), F.lit("\n"), F.repeat(F.concat(F.substring(mix, 3, 38), F.lit("\n")), (r("lines", 12) + 1).cast("int")), F.lit("-----END "), kind, F.lit("-----"))
    plain = pick("plain", ["required", "string", "nobody", "Johnson", "different", "request.headers", "config.get_token", "os.environ", "$DB_PASSWORD", "your_token1", "2024-01-02", "20240102", "version2", "module.key_1", "www.example.com/a1", "NoneType", "getTokenFromRequestHeader", "please&thank&you", "readAccessPolicyDocuments", "/etc/app/key.pem", "{{ vault_password }}"])
    cut = lambda x, at, n: F.substring(x, at, n)
    hexed = h("x")
    secrets = [
        hexes,
        cut(hexed, 1, 32),
        F.concat(F.lit("sk_live_"), cut(mix, 1, 24)),
        cut(mix, 1, 40),
        F.concat(F.lit("ghp_"), cut(mix, 1, 36)),
        F.concat(F.lit("AKIA"), F.upper(cut(h("k"), 1, 16))),
        F.upper(hexes),
        F.concat_ws("-", pick("slack", ["xoxb", "xoxp", "xapp"]), cut(F.translate(hexed, "abcdef", "123456"), 1, 11), cut(F.translate(hexed, "abcdef", "123456"), 12, 12), cut(mix, 1, 24)),
        F.concat(pick("vendor", ["glpat-", "AIza", "npm_", "dop_v1_", "hf_"]), cut(mix, 1, 35)),
        cut(mix, 1, 10),
        cut(hexed, 1, 12),
        F.concat(cut(mix, 1, 8), F.lit("!"), cut(hexed, 1, 1)),
        cut(F.translate(mix, "0123456789", "qWzXvKjYpT"), 1, 24),
        F.concat(cut(mix, 1, 7), F.lit("&"), cut(mix, 9, 4)),
        block,
        F.concat(pick("w1", ["dragon", "hunter", "summer", "monkey", "winter", "pass"]), r("d", 99).cast("string"), pick("w2", ["secret", "login", "admin", "blue", "word"]), pick("sign", ["!", "", "#", "?"])),
    ]
    others = [
        hexes,
        hexed,
        F.concat_ws("-", cut(hexed, 1, 8), cut(hexed, 9, 4), cut(hexed, 13, 4), cut(hexed, 17, 4), cut(hexed, 21, 12)),
        cut(F.translate(hexed, "abcdef", "123456"), 1, 16),
        F.concat_ws("_", word, F.lit("default"), pick("v", ["name", "value", "column"]), r("d", 99).cast("string")),
        F.concat(F.lit("your_"), pick("v", ["api_key", "token", "secret"]), F.lit("_here_1234")),
        F.concat(F.lit("/static/assets/"), word, F.lit("-"), r("d", 9999).cast("string")),
        F.concat(F.lit("EXAMPLEKEY"), F.repeat(F.lit("0"), 12)),
        F.concat_ws("-", word, F.lit("service-release"), r("d", 99).cast("string")),
        plain,
        plain,
    ]
    true = F.element_at(F.array(*secrets), (r("kind2", len(secrets)) + 1).cast("int"))
    false = F.element_at(F.array(*others), (r("kind", len(others)) + 1).cast("int"))
    y = r("y", 2).cast("int")
    given = pick("b", ['token = "', "api_key: ", "password='", "Authorization: Bearer ", "secret=", '"access_key": "', "export AUTH_TOKEN=", 'TOKEN = "', "api_key=", "DB_PASSWORD=", "/v1/items?id=3&token=", "--auth-token=", "SECRET_KEY_FOR_RELEASE_2="])
    named = pick("b", ["password: ", "token = ", "author: ", "key=", "api: ", 'secret="', "access_token=", "private: ", "?api_key="])
    is_block, is_marked = (y == 1) & (r("kind2", len(secrets)) == 14), (y == 1) & (r("kind2", len(secrets)) == 13)
    is_token = (y == 1) & r("kind2", len(secrets)).isin(7, 8) & (r("bare", 2) == 0)
    alone = F.when(is_block, pick("alone", ["", "cat id_rsa: ", "key:", "ssl_key = ", "deploy key "])).when(is_marked, pick("q", ['token = "', "password='", 'DB_PASSWORD="', '"secret": "'])).when(is_token, pick("bare", ["", "use ", "see ", "it is "]))
    context = F.when(alone.isNotNull(), alone).when(y == 1, given).when(r("kind", 11) >= 9, named).otherwise(F.when(r("kind", 11) < 3, pick("b", ["commit ", "sha256:", "md5 ", "integrity: ", "revision ", "uuid=", 'checksum = "'])).otherwise(pick("b", ["see ", "id ", "order ", "card ", "file ", "the ", ", ", "key: ", "version=", "image=", "/static?file="])))
    before = F.concat(pick("p", ["the report of ", "and then ", "", "in those days ", "use "]), context)
    quote = F.regexp_extract(before, """["']$""", 0)
    path = pick("f", ["src/app.py", "config/prod.env", "tests/test_api.py", "README.md", "src0", ""])
    value = F.when(y == 1, true).otherwise(false)
    line = F.concat(before, value, F.when(quote != "", quote).otherwise(pick("t", ["", " and", "\n", "&page=2"])))
    rows = spark.range(n).select("id", y.alias("y"), value.alias("value"), path.alias("path"), F.explode(_findings(line)).alias("x"))
    return rows.select("id", ((F.col("y") == 1) & (F.col("x.c") == F.col("value"))).cast("int").alias("y"), "x.c", "x.before", "x.after", "path")


def default_forest(spark: SparkSession, n: int = 6_000) -> Forest:
    rows = labelled_findings(spark, n)
    return train_forest(rows.select("id", "y", feature_array(F.col("c"), F.col("before"), F.col("after"), F.col("path")).alias("features")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _gaps(text: Column, body) -> Column:
    """body(texts around candidates, [(gap, c, before, after)] of each): before is what the text has before c, candidates too."""

    def rows(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]
        shifted = lambda a: F.slice(F.concat(F.array(F.lit("")), a), F.lit(1), F.size(found))
        each = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("c"), F.slice(gaps, 2, F.greatest(F.size(found), F.lit(1))).alias("next"), shifted(gaps).alias("gap0"), shifted(found).alias("c0"))
        return body(gaps, F.transform(each, near))

    def near(x: Column) -> Column:
        before = F.right(F.concat(F.right(x["gap0"], F.lit(40)), x["c0"], F.right(x["gap"], F.lit(40))), F.lit(40))
        return F.struct(x["gap"].alias("gap"), x["c"].alias("c"), before.alias("before"), F.left(x["next"], F.lit(20)).alias("after"))

    every_second = lambda parts, odd: F.filter(parts, lambda _, i: i % 2 == odd)
    marked = lambda t: F.split(F.regexp_replace(t, CANDIDATE, f"{MARK}$0{MARK}"), MARK, -1)
    once = lambda t: _let(marked(t), lambda parts: F.struct(every_second(parts, 0).alias("gaps"), every_second(parts, 1).alias("found")))
    twice = lambda t: F.struct(F.split(t, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(CANDIDATE), 0).alias("found"))
    return _let(text, lambda t: _let(F.when(F.contains(t, F.lit(MARK)), twice(t)).otherwise(once(t)), rows))


def _starts(sizes: Column, run: int = 256) -> Column:
    """Sums of the sizes (long) before each place, in runs, so that long arrays aren't copied over and over."""
    none = F.array().cast("array<bigint>")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(a: Column, first: Column) -> Column:
        start = F.struct(none.alias("out"), first.alias("at"))
        return F.aggregate(a, start, lambda x, y: F.struct(F.array_append(x["out"], x["at"]).alias("out"), (x["at"] + y).alias("at")), lambda x: x["out"])

    def body(size: Column) -> Column:
        n = F.ceil(F.size(size) / float(run)).cast("int")
        runs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(size, i * run + 1, F.lit(run)))).otherwise(F.array().cast("array<array<bigint>>"))
        return _let(runs, lambda r: F.flatten(F.zip_with(r, sums(F.transform(r, total), F.lit(0).cast("long")), sums)))

    return _let(sizes, body)


def _findings(text: Column) -> Column:
    """[(start from 1, c, before, after)] of a text's candidates."""

    def body(_: Column, rows: Column) -> Column:
        sizes = F.transform(rows, lambda x: (F.length(x["gap"]) + F.length(x["c"])).cast("long"))
        row = lambda x, at: F.struct((at + F.length(x["gap"]) + 1).cast("int").alias("start"), x["c"].alias("c"), x["before"].alias("before"), x["after"].alias("after"))
        return _let(rows, lambda r: F.zip_with(r, _starts(sizes), row))

    return _gaps(text, body)


def scan(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: (key, start from 1, length, c, score, is_secret) of every whole text.

    path: a column with the document's path or source, or None. Null and empty texts have
    no candidates; repeated rows give theirs each.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col(key).alias("key"), where.alias("path"), F.explode(_findings(F.col(text))).alias("x"))
    rows = rows.select("key", "path", "x.*").withColumn("features", feature_array(F.col("c"), F.col("before"), F.col("after"), F.col("path")))
    score = F.round(forest.score(F.col("features")), 9)
    return rows.select(F.col("key").alias(key), "start", F.length("c").alias("length"), "c", score.alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs with each secret in text replaced by mask; other columns and texts stay as they are, null and empty texts and repeated rows too."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")

    def shown(x: Column) -> Column:
        features = feature_array(x["c"], x["before"], x["after"], where)
        return F.concat(x["gap"], F.when(F.round(forest.score(features), 9) >= threshold, F.lit(mask)).otherwise(x["c"]))

    return docs.withColumn(text, _gaps(F.col(text), lambda gaps, rows: F.concat(F.array_join(F.transform(rows, shown), ""), F.element_at(gaps, -1))))
