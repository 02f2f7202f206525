"""Fill-in-middle, SimHash and bit-sliced search against brute-force versions, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["Straße", "日本語", "áb", "😀x"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(400)
    rows = [(i, make(rng.randint(1, 120))) for i in range(60)]
    for i in range(60, 90):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    long_ = make(30000)
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "ONE"), (95, long_), (96, long_ + " x"), (97, base), (97, base), (None, "no id here at all"), (None, base), (98, "has <M> within"), (99, "<P"), (100, "<S>"), (101, "...!?"), (102, "  word")]
    return spark.createDataFrame([(a, b, None, "s", len(b) if b else None) for a, b in rows], DOCS).cache()


def test_fill_in_middle_brute_force(spark, docs):
    from quillon.llm.fim import fill_in_middle, restore
    from quillon.llm.queries import op11_fill_in_middle

    def brute(key, text):
        text = text or ""
        h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        n = len(text)
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            return n, "plain", None, None, text
        p, m, s = text[:lo], text[lo:hi], text[hi:]
        return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")

    docs.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/fim/documents.parquet")
    out = op11_fill_in_middle(spark, path.rsplit("/", 1)[0]).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter()
    for r in docs.collect():
        *head, o = brute(r.doc_id, r.text)
        want[(r.doc_id, *head, sha(o), sha(r.text or ""))] += 1
    assert want == collections.Counter(map(tuple, out))
    assert {r.form for r in out} == {"plain", "psm", "spm"}

    # words and lines are whole, whatever the unit the text comes back, other columns stay
    for unit, cut in (("word", r"\s*\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")):
        ascii_ = docs.where("doc_id < 98").withColumn("first", F.lit(3)).withColumn("n", F.lit("old"))
        cutting = fill_in_middle(ascii_, F.lit(2), F.lit(5), F.lit("psm"), unit=unit)
        back = restore(cutting).collect()
        assert all(r.restored == (r.text or "") and r["first"] == 3 for r in back)
        for r in back:
            assert r.n == len(re.findall(cut, r.text or "", re.A)), (unit, r.text[:40])
    got = {r.text: r.output for r in fill_in_middle(spark.createDataFrame([("ab  cd e\nf",), ("  x y",)], "text string"), F.lit(1), F.lit(3), F.lit("spm"), unit="word").collect()}
    assert got == {"ab  cd e\nf": "<S>f<P>ab  <M>cd e\n", "  x y": "<S><P>  x <M>y"} or got["ab  cd e\nf"] == "<S>f<P>ab  <M>cd e\n"
    odd = fill_in_middle(docs.limit(3), F.lit(None), F.lit(-4), F.lit("unknown")).collect()
    assert all(r.form == "plain" and r.output == (r.text or "") and r.prefix_units is None for r in odd)
    assert fill_in_middle(docs.limit(0), F.lit(1), F.lit(1), F.lit("psm")).count() == 0


def test_fill_in_middle_markers(spark):
    from quillon.llm.fim import check_markers, fill_in_middle, restore

    for bad in (("<P>", "<P>", "<M>"), ("a", "ab", "c"), ("", "b", "c"), ("xy", "yz", "q"), ("aba", "c", "d"), ("a", "b")):
        if bad[0] == bad[1] == "<P>":
            continue
        with pytest.raises(ValueError):
            check_markers(bad)
    marks = ("▶", "◀", "●")
    rows = spark.createDataFrame([("",), ("日本語テキスト",), ("a◀b",), ("x" * 5000,)], "text string")
    out = restore(fill_in_middle(rows, F.lit(10**9 + 7), F.lit(3), F.lit("spm"), markers=marks), markers=marks).collect()
    assert [r.form for r in out] == ["plain", "spm", "plain", "spm"] and all(r.restored == r.text for r in out)


def test_gather_in_pieces(monkeypatch):
    from quillon.llm import fim

    monkeypatch.setattr(fim, "GATHER", 10)
    rng = np.random.default_rng(1)
    source = rng.integers(0, 256, 200).astype(np.uint8)
    start = rng.integers(0, 100, 60)
    length = rng.integers(0, 40, 60) * (rng.random(60) < 0.6)
    assert fim.gathered(source, start, length).tobytes() == b"".join(source[a : a + n].tobytes() for a, n in zip(start, length, strict=True))
    assert len(fim.gathered(source, start[:0], length[:0])) == 0


def brute_simhash(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def brute_classes(keys, prints, near=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(keys):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize(("part", "many"), [(1 << 19, 1024), (64, 2)])
def test_simhash_brute_force(spark, docs, monkeypatch, part, many):
    from quillon.llm import simhash

    rows = docs.collect()
    assert [brute_simhash(r.text) for r in rows] == simhash.fingerprints([r.text for r in rows], 3).tolist()
    monkeypatch.setattr(simhash, "PART", part)
    assert [brute_simhash(r.text) for r in rows] == simhash.fingerprints([r.text for r in rows], 3).tolist()
    monkeypatch.setattr(simhash.near_links, "__defaults__", (many,))
    got = simhash.simhash_components(docs.withColumn("fp", F.lit(1)).withColumn("n", F.lit(2)))
    prints = [brute_simhash(r.text) for r in rows]
    want = collections.Counter((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_classes([r.doc_id for r in rows], prints), strict=True))
    assert want == collections.Counter(map(tuple, got.collect()))
    assert len({c for *_, c in want}) < len(want) - 10
    if many == 2:
        assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_simhash_links_of_crowded_buckets(spark, monkeypatch):
    """Fingerprints that share most bits, so that all four rounds of blocks are needed, and chains of links."""
    from quillon.llm import simhash
    from quillon.llm.common import components

    rng = random.Random(9)
    prints = {0, (1 << 64) - 1, 1 << 63, 7 << 61}
    for centre in (rng.getrandbits(64), 0xFFFF):
        x = centre
        for _ in range(60):
            prints.add(x ^ sum(1 << i for i in rng.sample(range(0, 40, 3), rng.randint(0, 3))))
            if rng.random() < 0.2:
                x ^= sum(1 << i for i in rng.sample(range(64), 3))
    prints |= {rng.getrandbits(64) & 0xFFFFF for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = brute_classes(signed, prints)
    for many in (3, 40, 10**6):
        links = simhash.near_links(classes, 4, many)
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links.collect())
        label = dict(map(tuple, components(links).collect()))
        assert [label.get(p, p) for p in signed] == want
    assert not len(simhash.close_links(np.zeros(0, np.uint64)))


def test_joined_by_keeps_hot_keys_apart(spark):
    """One key has half of all rows; no task gets over four times the mean, without adaptive splitting."""
    from quillon.llm.common import heavy_of, joined_by

    rows = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 101 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    table = rows.where("k is not null and k % 5 <> 1").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        out = joined_by(rows, table.drop("n"), "k", heavy_of(table.select("k", "n")))
        got = out.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 60000 and len({r.id for r in got}) == 60000
    assert all(r.v == (None if r.k is None or r.k % 5 == 1 else 2 * r.k) for r in got)
    sizes = collections.Counter(r.part for r in got)
    assert max(sizes.values()) <= 4 * sum(sizes.values()) / len(sizes)


def test_components_with_heavy_centres(spark, monkeypatch):
    from quillon.llm import common

    monkeypatch.setattr(common, "FEW_EDGES", 0)
    monkeypatch.setattr(common, "LEAST_HEAVY", 3)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(900, 1000)] + [(i, i + 1) for i in range(2000, 2040)] + [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(80)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    counts = [(key, collections.Counter(terms_of(t))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, rows = collections.Counter(terms_of(text)), []
        for key, c in counts:
            m = 75 + 25 * sum(c.values()) * big_n // big_l
            s = sum(n * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if s > 0:
                rows.append((-s, key is None, key or 0, key))
        out += [(item, i, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_brute_force(spark, docs, monkeypatch, small):
    from quillon.llm import bitsliced

    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    vocabulary = sorted({t for _, x in rows for t in terms_of(x)})
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    items += [(30, "ONE one One, one; nowhere"), (31, None), (32, "?!"), (33, "nowhere"), (None, "one"), (34, rows[5][1]), (34, rows[6][1]), (35, rows[95][1] if rows[95][1] else "x"), (36, "日本語 straße")]
    if small:  # many blocks, several lots and groups of items, nothing kept unpacked, texts in parts
        for name, value in (("DOCS", 20), ("LOT", 9000), ("ITEMS", 4), ("KEPT_MB", 0), ("PART", 50)):
            monkeypatch.setattr(bitsliced, name, value)
    asked = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, score string")
    got = bitsliced.rank_documents(docs.repartition(3).withColumn("key", F.lit(1)), asked, k=5 if small else 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search(rows, items, 5 if small else 20)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert bitsliced.rank_documents(docs.limit(0), asked).count() == 0
    if not small:
        assert bitsliced.rank_documents(docs, asked.limit(0)).columns == got.columns
        named = bitsliced.rank_documents(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), asked.limit(3), k=3)
        assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == 9


def test_carry_addition_and_descent_against_integers():
    from quillon.llm.bitsliced import added, sliced, top_k, unsliced

    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 300):
        words = -(-n // 64)
        a, b = rng.integers(0, 1 << 33, n), rng.integers(0, 1 << 20, n) * (rng.random(n) < 0.5)
        b[0] = max(b[0], 1)
        sums = np.zeros((35, 1, words), np.uint64)
        every = np.arange(n)
        for v in (a, b, b):
            x = unsliced(sliced(v), every, words)
            added(sums, x[:, None, :])
        total = a + 2 * b
        at, score = top_k(sums, 10)[0]
        order = sorted((i for i in range(n) if total[i]), key=lambda i: (-total[i], i))[:10]
        assert at.tolist() == order and score.tolist() == total[order].tolist()
    # ties at the end go to smaller places
    tie = np.array([5, 1, 5, 0, 1, 1, 1])
    sums = unsliced(sliced(tie), np.arange(7), 1)[:, None, :].copy()
    assert top_k(sums, 4)[0][0].tolist() == [0, 2, 1, 4]


def test_large_counts_stay_exact():
    from quillon.llm.bitsliced import impacts

    tf, size = np.array([3, 1]), np.array([10**9, 5])
    assert impacts(tf, size, 10**12, 10**15).tolist() == [10**9 * 3 // (3000 + 12 * (75 + 25 * 10**9 * 10**12 // 10**15)), 10**9 // (1000 + 12 * (75 + 25 * 5 * 10**12 // 10**15))]
