"""Claims, lexicons, fairness, family draws and hidden vectors against plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import claims, dataset, fairness, lexicon, reports


def test_claims_are_found_as_whole_numbers(spark):
    rng = random.Random(1)
    parts = ["0.8185", "81.8 %", "81.8%", "-5.30", "3-5.30", "a-5.30", "7.68e-02", "+2", "2.5", "12", "1,234", "0.818.", "2.11.0", "5.3", ".5", "x0.5", "-0.50,", "1e5", "12%", "00", "9.9.9", "٣"]
    docs = [(i, rng.choice([" ", ", ", "", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(80, None), (81, ""), (82, "0.818"), (82, "0.818"), (83, "1" * 5000 + " 0.5"), (84, ",".join("12" for _ in range(3000)))]
    forms = ["0.8185", "0.818", "81.8", "81.8%", "-5.30", "5.30", "7.68e-02", "7.68", "02", "-02", "2", "+2", "2.5", "1,234", "234", "1", "0.5", "5", "-0.50", "12", "12%", "2.11.0", "11", "0", "9.9", "1e5", "1" * 5000, "1" * 4999, None, "nan", "0.5.", "abc"]
    asked = [(f"c{i}", f) for i, f in enumerate(forms)] + [("c0", "0.8185")]
    got = claims.said_by(spark.createDataFrame(asked, "claim_id string, form string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(c, f, k) for c, f in asked if f and re.match(claims.FORM, f) for k, t in docs if t and re.search(rf"(?<![0-9.]){re.escape(f)}(?![0-9])", t)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200
    named = spark.createDataFrame([("a", "0.818", 82), ("b", "0.818", 900), ("c", "abc", 82), ("d", "0.8", 82), ("e", None, 80), ("f", "1", None)], "claim_id string, form string, doc long")
    bad = {r.claim_id: r.problem for r in claims.check_claims(named, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert bad == {"a": None, "b": "document missing", "c": "no printed number", "d": "document does not say it", "e": "no printed number", "f": "document missing"}
    assert claims.said_by(spark.createDataFrame([], "claim_id string, form string"), spark.createDataFrame(docs, "doc_id long, text string")).count() == 0
    said = [claims.printed(F.lit(v).cast("double"), F.lit(s).cast("double"), F.lit(f).cast("string")) for v, s, f in ((0.81849, 100.0, ".1f"), (0.125, 1.0, ".2f"), (0.0768, None, ".2e"), (None, 1.0, ".2f"), (1.0, 1.0, "q"))]
    assert list(spark.range(1).select(*said).first()) == ["81.8", "0.12", "7.68e-02", None, None]
    plan = claims.said_by(spark.createDataFrame(asked, "claim_id string, form string"), spark.createDataFrame(docs, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("lot", [500_000, 40])
def test_lexicon_brute_force(spark, monkeypatch, lot):
    monkeypatch.setattr(lexicon, "LOT", lot)
    rng = random.Random(3)
    terms = [(t, c) for c, v in lexicon.IDENTITY.items() for t in v] + [("native", "more"), ("C++", "signs"), ("Straße", "more"), ("man", "twice"), ("été", "more"), ("", "none"), (None, "none")]
    bits = [t for t, _ in terms if t] + ["human", "manly", "amen", "native  american", "non binary", "blacksmith", "MAN", "Native American", "C++x", "xC++", "trans-gender", "gay.", "_man", "man_", "été2", "ſtraight", "İman", "mané"]
    texts = [(i, rng.choice([" ", ", ", "-", ""]).join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for i in range(150)] + [(150, None), (151, "")]
    docs = spark.createDataFrame(texts, "k long, text string").withColumn("term", F.lit("x"))
    lex = spark.createDataFrame(terms, "term string, category string")
    fold = lambda t: t.replace("ſ", "s")
    want = collections.Counter()
    for k, t in texts:
        for term, cat in terms:
            if t and term:
                for m in re.finditer(rf"(?=\b{re.escape(term)}\b)", fold(t), re.I):
                    want[k, m.start(), term, cat] += 1
    got = collections.Counter(map(tuple, lexicon.mentions(docs, lex, "k", "text").collect()))
    assert got == want and len(want) > 150
    cats = {r.k: r.categories for r in lexicon.with_categories(docs, lex, "text").collect()}
    assert cats == {k: sorted({c for (x, _, _, c) in want if x == k}) for k, _ in texts}
    assert lexicon.with_categories(docs, lex, "text").columns == ["k", "text", "term", "categories"]
    assert lexicon.mentions(docs, lex.limit(0), "k", "text").count() == 0


def test_fairness_by_family(spark):
    rows = [(True, [0.4, 0.6], [1.0, 0.0]), (True, [0.6, 0.4], [0.0, 1.0]), (True, [0.5, 0.5], [0.5, 0.5]), (False, [0.1, 0.1, 0.1, 0.6, 0.1], [0.0, 1.0, 0.0, 0.0, 0.0]), (False, [0.5, 0.1, 0.1, 0.2, 0.1], [0.0, 0.0, 0.0, 0.0, 1.0]), (False, [0.1, 0.1, 0.6, 0.1, 0.1], [0.0, 0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "b boolean, p array<double>, t array<double>")
    got = [(r.correct, r.false_toxic, r.missed_toxic) for r in fairness.row_stats(df, F.col("b")).collect()]
    assert got == [(0.0, 1.0, None), (0.0, None, 1.0), (1.0, None, 0.0), (0.0, 1.0, None), (0.0, None, 1.0), (1.0, None, None)]
    stats = fairness.row_stats(df, F.col("b")).withColumn("f", F.lit("x"))
    gap = {r.metric: (r.gap, r.too_small) for r in fairness.gaps(stats, "f", F.col("b"), 3).collect()}
    assert gap["correct"] == (0.0, False) and gap["false_toxic"] == (0.0, False)
    assert all(r.gap is None and r.too_small for r in fairness.gaps(stats, "f", F.col("b"), 4).collect())


def test_family_draws(spark):
    sizes = {"a": 400, "b": 100, "c": 25, "d": 1}
    rows = [(i, f) for i, f in enumerate(f for f, n in sizes.items() for _ in range(n))] + [(9000, None), (None, "a")]
    df = spark.createDataFrame(rows, "k long, fam string")
    got = dataset.family_draws(df, "k", "fam", 0.5, 500, 6, 1).collect()
    assert sorted((r.step, r.slot) for r in got) == [(s, t) for s in range(500) for t in range(6)]
    of, n = dict(rows), 3000
    assert all(of[r.k] == r.family for r in got)
    total = sum(x**0.5 for x in sizes.values())
    seen = collections.Counter(r.family for r in got)
    for f, x in sizes.items():
        share = x**0.5 / total
        assert abs(seen[f] - n * share) <= 3 * (n * share * (1 - share)) ** 0.5 + 1
    assert len({r.k for r in got if r.family == "c"}) == 25 and max(collections.Counter(r.k for r in got if r.family == "a").values()) < 20
    again = dataset.family_draws(df.repartition(5), "k", "fam", 0.5, 500, 6, 1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert dataset.family_draws(df.limit(0), "k", "fam", 0.5, 5, 6).count() == 0
    ranks = dataset.group_rank(df.where("k is not null and fam is not null"), "fam", "k", 4).collect()
    for f, x in sizes.items():
        assert sorted(r["rank"] for r in ranks if r.fam == f) == list(range(x))


def test_hidden_vectors_are_localised(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (1, [3.0, 4.0], [0.0, 4.0]), (2, None, [1.0, 1.0])], "q long, a array<double>, r array<double>")
    r = reports.localise(df, "a", "r", F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(-1.0)), "q", 0.0).first()
    logit = lambda h: (h[0] - 2 * h[1]) / (sum(x * x for x in h) / 2) ** 0.5
    assert (r.n_questions, r.n_paths, r.hidden_rel_l2_max, r.hidden_rel_l2_mean) == (1, 2, 0.75, 0.375)
    assert r.logit_abs_max == pytest.approx(abs(logit([3, 4]) - logit([0, 4]))) and r.logit_abs_mean == pytest.approx(r.logit_abs_max / 2)
