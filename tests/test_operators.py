"""The reference's own invariants and edge cases, on small tables."""

import collections

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing, text, vec
from quillon.operators import contamination, dataset, metrics, pii, resample
from quillon.sources import adapters, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0] if values else spark.range(1).select(column.alias("x")).first()[0]


def test_smooth_ece_of_calibrated_answers_is_small(spark):
    rows = [(0.2, float(i < 100)) for i in range(500)] + [(0.8, float(i < 400)) for i in range(500)]
    got = metrics.smooth_ece(spark.createDataFrame(rows, "conf double, ok double")).first().smooth_ece
    assert got < 0.03


def test_floor_gate_on_recorded_rows(spark):
    rows = spark.createDataFrame([(6000, 0, 0.01, 0), (6000, 0, 0.0767, 28), (6000, 0, 0.2, 0), (6000, 1, 0.01, 0)], "n int, n_nonfinite int, tv_max double, n_argmax_diff int")
    got = [(round(r.z, 2), r.verdict) for r in metrics.floor_gate(rows, 6000, 7.677e-02, 28).collect()]
    assert got[0] == (-5.3, "pass") and got[1] == (0.0, "at floor") and got[2][1] == "no" and got[3][1] == "no"


def test_paired_bootstrap_of_a_model_with_itself_is_zero(spark):
    rows = spark.range(200).select(F.pmod("id", F.lit(10)).alias("g"), F.lit(0.0).alias("d"))
    r = resample.bootstrap(resample.group_sums(rows, "g", x=F.col("d")), F.col("x") / F.col("n"), 50).first()
    assert (r.lo, r.hi) == (0.0, 0.0)
    few = resample.bootstrap(resample.group_sums(rows.where("g < 3"), "g", x=F.col("d")), F.col("x") / F.col("n"), 50).first()
    assert few.lo is None


def test_urn_and_targets(spark):
    assert one(spark, dataset.urn_probs(F.array(*[F.lit(x).cast("long") for x in (1, 2, 5)]))) == pytest.approx([1 / 8, 2 / 8, 5 / 8])
    assert one(spark, vec.ordinal_soft_target(F.lit(0.3), 5)) == pytest.approx([0, 0.8, 0.2, 0, 0])
    assert one(spark, vec.teacher_target(4, F.lit(1), F.lit(0.1))) == pytest.approx([0.25] * 4)
    assert one(spark, vec.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))) == 0
    assert one(spark, vec.temper(F.array(F.lit(0.0), F.lit(0.2), F.lit(0.8)), 0.5)) == pytest.approx([0, 0.04 / 0.68, 0.64 / 0.68])


def test_violations_reject_probabilities_that_miss_one(spark):
    good = adapters.boolean(spark.createDataFrame([(1, "a text", 0.25)], "k long, t string, p double"), "s", "k", "t", F.col("p"), F.sha1("t"), "Is it?")
    assert dataset.violations(good).count() == 0
    bad = good.withColumn("target", F.struct(F.lit("soft").alias("semantic_kind"), F.lit("human").alias("provenance"), F.array(F.lit(0.6), F.lit(0.5)).alias("probs"), F.lit(0).alias("hard")))
    assert dataset.violations(bad).first().reasons == ["probs sum"]
    with pytest.raises(Exception, match="probs sum"):
        dataset.require_sound(bad).collect()


def test_hash_split_is_a_rule_of_the_key(spark):
    import hashlib

    got = one(spark, hashing.group_hash(F.lit("abc"), 42))
    assert got == int(hashlib.sha256(b"42:abc").hexdigest()[:12], 16) / 16**12
    assert one(spark, hashing.h100(F.lit("abc"))) == int(hashlib.sha256(b"abc").hexdigest(), 16) % 100


def test_text_functions(spark):
    assert one(spark, text.normalise(F.col("t")), t=" ﬁne  TEXT\n") == "fine text"
    assert one(spark, text.leaf_values(F.col("t")), t='{"b": [1, "x"], "a": {"c": null, "d": "{\\"e\\": 2}"}}') == ["2", "1", "x"]
    assert one(spark, text.word_prefixes(F.col("t")), t="a  b") == ["a", "a  b"]
    assert one(spark, text.humanize(F.lit("Card_lost-or.stolen"))) == "card lost or stolen"


def test_checksums(spark):
    assert one(spark, pii.iban_ok(F.lit("GB82WEST12345698765432"))) is True
    assert one(spark, pii.iban_ok(F.lit("GB82WEST12345698765431"))) is False
    assert one(spark, pii.luhn_ok(F.lit("4111 1111 1111 1111"))) is True
    assert one(spark, pii.luhn_ok(F.lit("4111 1111 1111 1112"))) is False


def brute_hits(t):
    """All eight channels by Python's own regular expressions, from the rules as said."""
    import re

    out = []
    lists = set(pii.GIVEN), set(pii.SURNAMES)

    def luhn(n):
        d = [int(c) for c in reversed(n)]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    def real(channel, h):
        n, low = re.sub("[^0-9]", "", h), h.lower()
        if channel == "email":
            local, domain = low.split("@")
            return not (domain in pii.PLACEHOLDER_DOMAINS or re.search(r"[.](example|test)$", domain) or local in pii.PLACEHOLDER_LOCALS or re.fullmatch("(user|test|sample|foo|bar)[0-9]*", local) or any(x in domain for x in ("example", "placeholder", "fake")))
        if channel == "phone":
            return not (any(x in n for x in pii.PLACEHOLDER_DIGITS) or len(set(n)) <= 2 or n in pii.WHOLE_NUMBERS)
        if channel == "iban":
            c = h.replace(" ", "")
            return not (c.startswith("XX") or "EXAMPLE" in c or len(set(c[4:])) <= 2) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
        if channel == "card":
            return luhn(n) and len(set(n)) > 2 and n not in pii.TEST_CARDS and not (n.startswith("4444") and len(set(n)) <= 3)
        if channel == "street":
            return not any(x in low for x in pii.STREET_WORDS) and re.match(r"[0-9]+ ([a-z0-9.'-]+)", low)[1] not in pii.PLACEHOLDER_STREETS
        return not all(p in pii.PLACEHOLDER_NAMES for p in (w.rstrip(".") for w in low.split()) if p not in ("mr", "mrs", "ms", "miss", "dr", "prof"))

    for channel, pattern in pii.CHANNELS.items():
        for m in re.finditer(pattern, t):
            h, n, w = m[0], re.sub("[^0-9]", "", m[0]), m[0].split()
            tokens = re.findall("[a-z0-9']+", h.lower())
            ok = {
                "email": True,
                "phone": 10 <= len(n) <= 15 and not re.search(pii.CITATION, t[max(0, m.start() - 24) : m.end() + 8].lower()),
                "iban": len(h.replace(" ", "")) >= 15,
                "card": 13 <= len(n) <= 19 and bool(re.search("[ -]", h)) and n[:3] not in ("978", "979"),
                "street": len(tokens) >= 3 and not set(tokens[1:-1]) & set(pii.NOT_STREETS),
                "name_full": w[0] in lists[0] and w[-1] in lists[1] and w[0].lower() not in pii.STARTERS,
                "name_titled": w[-1] in lists[0] | lists[1],
                "name_given": h in lists[0] and h.lower() not in pii.STARTERS + pii.AMBIGUOUS and not re.search(r"(?:Mr|Mrs|Ms|Miss|Dr|Prof)[.]?\s+$", t[: m.start()]) and not ((x := re.match(r"\s+([A-Z][a-z]+)\b", t[m.end() :])) and x[1] in lists[1]),
            }[channel]
            if ok:
                out.append((channel, h, pii.REAL if real(channel, h) else pii.PLACEHOLDER))
    return out


def test_personal_data_brute_force(spark):
    import random

    rng = random.Random(3)
    parts = ["jane.roe@firm.co", "user7@firm.co", "a@b.example", "+49 (30) 901 820 44", "212-867-5309", "555 010 4477", "in 410 F. 2d 212 867 5309", "4539 5787 6362 1486", "4111-1111-1111-1111", "4539578763621486", "978-3-16-148410-0", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "XX89370400440532013000", "22 Baker Hill Road", "123 Main Street", "15 minutes Drive", "Mary Johnson", "Dr. Wilson", "Mr. John Smith", "Susan", "Linda", "met with", "and then", "caf\u00e9"]
    texts = [" , ".join(rng.sample(parts, rng.randint(1, 8))) for _ in range(120)] + ["", " ".join(parts * 300)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {}
    for r in pii.hits(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append((r.channel, r.hit, r.label))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(brute_hits(t)), t[:200]
    assert {c for h in got.values() for c, _, _ in h} == set(pii.CHANNELS) and -1 not in got
    # lists as a table give the same names, and so do longer lists
    names = spark.createDataFrame([(n, "given") for n in (*pii.GIVEN, "Grace", "The", "Susan")] + [(n, "surname") for n in pii.SURNAMES], "name string, kind string")
    listed = {}
    for r in pii.name_hits(df, names, "doc_id", "text").collect():
        listed.setdefault(r.doc_id, []).append((r.channel, r.hit, r.label))
    assert {i: sorted(h) for i, h in listed.items()} == {i: x for i, h in got.items() if (x := sorted(y for y in h if y[0].startswith("name")))}
    odd = spark.createDataFrame([(1, "The Johnson met Grace and Grace Johnson, Mark Brown")], "doc_id long, text string")
    more = names.union(spark.createDataFrame([("Mark", "given")], names.schema))
    assert sorted(r.hit for r in pii.name_hits(odd, more, "doc_id", "text").collect()) == ["Grace Johnson", "Mark Brown"]
    v = pii.verdict(pii.hits(df.where("doc_id < 0"), "doc_id", "text")).first()
    assert v.verdict == "clean"
    only = spark.createDataFrame([(1, "Susan met Linda"), (2, "4539 5787 6362 1486")], "doc_id long, text string")
    assert pii.verdict(pii.hits(only.where("doc_id = 1"), "doc_id", "text")).first().verdict == "names-only"
    assert pii.verdict(pii.hits(only, "doc_id", "text")).first().verdict == "contact-looks-real"


def test_contamination_scan_brute_force(spark, monkeypatch):
    """Planted exact, near and unlike texts; grams met by broadcast and by a join."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(40)]
    evals = [b if i % 4 == 0 else b.replace("a", "b", 2) if i % 4 == 1 else b[: len(b) // 3] + " " + word() * 9 if i % 4 == 2 else " ".join(word() for _ in range(20)) for i, b in enumerate(base)] + ["short", "", None]
    train = [*base, "short", "", None, base[0], "x" * 40_000]
    t = contamination.normal(spark.createDataFrame(list(enumerate(train)), "id0 long, text string"), "id0")
    e = contamination.normal(spark.createDataFrame(list(enumerate(evals)), "id0 long, text string"), "id0")

    def grams(x):
        return {x[i : i + 13] for i in range(len(x) - 12)} if x else set()

    norm = lambda x: None if x is None else " ".join(x.lower().split())
    for most in (4_000_000, 0):
        monkeypatch.setattr(contamination, "WANTED", most)
        pairs = {(r.train_id, r.eval_id): (r.shared, r.jaccard) for r in contamination.jaccard_pairs(t, e).collect()}
        want = {}
        for i, a in enumerate(map(norm, train)):
            for j, b in enumerate(map(norm, evals)):
                if both := len(grams(a) & grams(b)):
                    want[i, j] = (both, pytest.approx(both / len(grams(a) | grams(b))))
        assert pairs == want
    monkeypatch.setattr(contamination, "WANTED", max(1, sum(len(x or "") for x in evals) // 3))  # some lots
    rare = {(r.eval_id, r.train_id): r.shared for r in contamination.rare_candidates(t, e, 3, 50).collect()}
    df = collections.Counter(g for a in train for g in grams(norm(a)))
    assert rare == {(j, i): k for j, x in enumerate(evals) for i, a in enumerate(train) if (k := sum(df[g] <= 3 for g in grams(norm(x)) & grams(norm(a))))}
    rows = {r.eval_id: r for r in contamination.scan(t, e).collect()}
    assert len(rows) == len(evals)
    for j, x in enumerate(evals):
        best = max(((len(grams(norm(a)) & grams(norm(x))) / max(1, len(grams(norm(a)) | grams(norm(x)))), -i) for i, a in enumerate(train) if a), default=(0, 0))
        if x and len(x) >= 13 and best[0] >= 0.3:
            assert (rows[j].jaccard, rows[j].train_id) == (pytest.approx(best[0]), -best[1])
        assert rows[j].exact == (bool(x) and norm(x) in set(map(norm, train)))
        assert rows[j].jaccard_hit == (best[0] >= 0.8 or x == "short") and (rows[j].near_duplicate or not rows[j].jaccard_hit)
    r = contamination.report(contamination.scan(t, e)).first()
    assert (r.n_eval, r.exact_matches) == (len(evals), sum(x.exact for x in rows.values()))


def test_signatures_are_the_rule_in_64_bits(spark):
    texts = ["", "short", "exactly 13 ch", "a longer text of more than thirteen characters, twice over and more", "日本語のテキストがここにあります。もう少し長く。", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    got = {r.id: r.sig for r in contamination.signatures(df, 8).collect()}
    assert set(got) == {0, 1, 2, 3, 4}

    def h(gram):
        x = 0
        for c in gram:
            x = (x * contamination.BASE + ord(c)) % 2**64
        return x

    for i, t in enumerate(texts[:5]):
        grams = [t[j : j + 13] for j in range(len(t) - 12)] or [t]
        assert got[i] == [min((a * h(g) + b) % 2**64 % (2**61 - 1) for g in grams) for a, b in contamination.coefficients(8)]
    assert max(map(max, got.values())) > 2**40


def test_gram_index_reads_no_training_text(spark, tmp_path):
    """A second evaluation set meets the stored index after the training files are gone, without an exchange on the index's side."""
    import random
    import shutil
    import uuid

    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    train = [make(30) for _ in range(40)]
    spark.createDataFrame(list(enumerate(train)), "id long, norm string").write.parquet(f"{tmp_path}/t")
    evals = [spark.createDataFrame([(j, train[rng.randrange(40)][:60] + " " + make(5)) for j in range(6)] + [(90, None), (91, "x")], "id long, norm string").cache() for _ in range(2)]
    t = spark.read.parquet(f"{tmp_path}/t")
    want = [sorted(map(tuple, contamination.rare_candidates(t, e, 5, 3).collect())) for e in evals]
    index = contamination.GramIndex(spark, f"g_{uuid.uuid4().hex}", 8)
    index.add(t.where("id < 25")).add(t.where("id >= 25"))
    assert sorted(map(tuple, index.candidates(evals[0], 5, 3).select("eval_id", "train_id", "shared").collect())) == want[0] and want[0]
    shutil.rmtree(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            found = index.shared(evals[1], 5)
            plan = found._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            at = next(i for i, x in enumerate(lines) if "FileScan" in x and index.name in x)
            indent = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
            above = []
            for x in reversed(lines[:at]):
                d = len(x) - len(x.lstrip(" :+-*()0123456789"))
                if d < indent:
                    above.append(x)
                    indent = d
                if "Join" in x:
                    break
            assert not any("Exchange" in x for x in above), plan
            assert "SelectedBucketsCount: 8 out of 8" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, index.candidates(evals[1], 5, 3).select("eval_id", "train_id", "shared").collect())) == want[1]


def test_contamination_on_empty_short_and_equal_texts(spark):
    t = contamination.normal(spark.createDataFrame([(1, ""), (2, None), (3, "short"), (4, "A text that is long enough"), (5, "a  text that is long enough")], "doc_id long, text string"), "doc_id")
    e = contamination.normal(spark.createDataFrame([(9, "a text that is long ENOUGH"), (8, "")], "doc_id long, text string"), "doc_id")
    assert [tuple(r) for r in contamination.exact_matches(t, e).collect()] == [(9, 4)]
    assert {(r.train_id, r.jaccard) for r in contamination.jaccard_pairs(t, e).collect()} == {(4, 1.0), (5, 1.0)}


def test_contamination_sees_through_compatibility_forms(spark, tmp_path):
    import unicodedata

    from quillon.plans import queries

    item = "the official office finds five different offers in the first file of the day"
    copies = {1: item.replace(" ", "\u00a0"), 2: item.replace("ffi", "\ufb03").replace("fi", "\ufb01"), 3: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in item), 4: "\u2003" + item.upper() + "\u3000", 5: "a text of another kind that has nothing in common"}
    spark.createDataFrame(list(copies.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {n: queries()[n](spark, str(tmp_path)).collect() for n in ("contam_exact", "contam_jaccard13", "contam_minhash_lsh", "contam_rare_gram", "contam_window40", "guard_anti_join")}
    brute = {i for i, t in copies.items() if " ".join(unicodedata.normalize("NFKC", t).lower().split()) == item}
    assert brute == {1, 2, 3, 4} and [(r.eval_id, r.train_id) for r in got["contam_exact"]] == [("benchmark:9", 1)]
    assert {r.train_id for r in got["contam_jaccard13"] if r.jaccard == 1} == brute and {r.train_id for r in got["contam_minhash_lsh"] if r.similarity == 1} == brute
    assert {r.train_id for r in got["contam_rare_gram"]} == brute and {r.train_id for r in got["contam_window40"]} == brute
    # the guard has no NFKC, but Unicode white space
    assert {r.doc_id for r in got["guard_anti_join"]} == {2, 3, 5}


def test_windows_are_found_wherever_they_stand(spark):
    import random

    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    parts = {1: item[:60], 2: item[-60:], 3: item[len(item) // 2 - 60 : len(item) // 2 + 60], 4: item[30:50]}
    t = contamination.normal(spark.createDataFrame([(i, f"before it {p} after it") for i, p in parts.items()], "id0 long, text string"), "id0")
    e = contamination.normal(spark.createDataFrame([(9, item), (8, "under forty")], "id0 long, text string"), "id0")
    assert {(r.train_id, r.eval_id) for r in contamination.window_hits(t, e).collect()} == {(1, 9), (2, 9), (3, 9)}


def test_packs_keep_the_budget(spark):
    rows = spark.createDataFrame([("a", i, 2 + i % 3, 10 * (i + 1)) for i in range(6)], "s string, id int, k int, w int")
    got = {}
    for r in dataset.greedy_pack(rows, "s", "id", "k", "w", 600).join(rows, ["s", "id"]).collect():
        got.setdefault(r.pack, []).append(r)
    assert all(sum(r.k for r in p) * max(r.w for r in p) <= 600 for p in got.values())
    with pytest.raises(Exception, match="over the budget"):
        dataset.greedy_pack(rows, "s", "id", "k", "w", 100).collect()


def test_registered_packs_count_questions_over_the_budget(spark, tmp_path):
    from quillon.plans import queries

    docs = spark.createDataFrame([(i, "en", 9_000 + i) for i in range(40)] + [(40, "en", 128_657), (41, "de", 30_000)], "doc_id long, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packs = {}
    for r in queries()["pack_questions"](spark, str(tmp_path)).join(docs, "doc_id").collect():
        packs.setdefault((r["shard"], r["pack"]), []).append((r.doc_id % 4 + 2, r.n_chars // 4 + 1))
    assert sum(map(len, packs.values())) == 40
    assert all(sum(k for k, _ in p) * max(w for _, w in p) <= 16384 for p in packs.values())
    assert {(r.lang, r.n) for r in queries()["pack_questions_over_budget"](spark, str(tmp_path)).collect()} == {("en", 1), ("de", 1)}


def test_mail_cleaning(spark):
    from quillon.operators.mail import clean_mail

    mails = {
        "Hello,\nI need help.\n\nThis message is confidential and intended for the addressee.\nOn Monday 3 May Bob wrote:\n> old text": "Hello,\nI need help.",
        "I need it.\nIs this confidential?\nThanks,\nAnn Lee": "I need it.\nIs this confidential?",
        "Preciso do contrato.\nEm seg., 3 de mai. de 2024 Ana <ana@x.com> escreveu:\n> antigo": "Preciso do contrato.",
        "Em resposta ao que escreveu:\nsim": "Em resposta ao que escreveu:\nsim",
        "Quiero ayuda.\nEl lun, 3 may 2024, Ana Ruiz\n<ana@x.com> escribi\u00f3:\n> viejo": "Quiero ayuda.",
        "Please refund me.\nFrom: Shop <s@x.com>\nSent: Monday": "Please refund me.",
        "De: 10/09 a 15/09\nPara: 20/09 favor trocar": "De: 10/09 a 15/09\nPara: 20/09 favor trocar",
        "It broke.\nDe: Maria Souza\nEnviado em: segunda\nold": "It broke.",
        "Fine then.\nSent from my iPhone": "Fine then.",
        "Segue.\nEnviado do meu smartphone Samsung Galaxy.": "Segue.",
        "Oi.\nEnviado do meu celular o comprovante ontem.": "Oi.\nEnviado do meu celular o comprovante ontem.",
        "Thanks for the quick reply.\nCan you call me?": "Thanks for the quick reply.\nCan you call me?",
        "One.\nTwo.\nKind regards, \u0141ukasz": "One.\nTwo.",
        "Um.\nDois.\nMuito obrigado pela aten\u00e7\u00e3o!\nAna": "Um.\nDois.",
        "Um.\nDois.\nObrigado pelo retorno, mas n\u00e3o veio.": "Um.\nDois.\nObrigado pelo retorno, mas n\u00e3o veio.",
        "Por error compr\u00e9 dos billetes.": "Por error compr\u00e9 dos billetes.",
        "Is the information in this e-mail confidential?": "Is the information in this e-mail confidential?",
        "Confidential: I need a refund.": "Confidential: I need a refund.",
        "I am locked out\nThis e-mail and its\ncontents are confidential and intended solely for you. Call me.": "I am locked out Call me.",
        "Antes de imprimir o boleto, confira o valor.": "Antes de imprimir o boleto, confira o valor.",
        "Oi.\n\nAntes de imprimir, pense no meio ambiente.": "Oi.",
        "Se recebeu esta mensagem por engano, apague. Preciso de ajuda.": "Preciso de ajuda.",
        "a\n> b\nc": "a\nc",
        "top\n-----Mensagem original-----\nold": "top",
        "top\n________\nold": "top",
        "x  y\tz\r\nq": "x y z\nq",
        "": "",
    }
    rows = spark.createDataFrame(list(enumerate([*mails, None])), "i int, t string")
    got = [r.c for r in rows.select("i", clean_mail("t").alias("c")).orderBy("i").collect()]
    assert dict(zip([*mails, None], got, strict=True)) == {**mails, None: None}
    long_ = spark.createDataFrame([("word " * 2000,), ("line\n" * 5000,)], "t string").select(clean_mail("t", None).alias("w"), clean_mail("t").alias("c")).collect()
    assert long_[0].w == ("word " * 2000).strip() and len(long_[0].c) == 3000 and long_[1].w == ("line\n" * 5000).strip()


def test_files_round_trip_and_seal(spark, tmp_path):
    rec = adapters.boolean(spark.createDataFrame([(i, f"text {i}", 0.25) for i in range(8)], "k long, t string, p double"), "s", "k", "t", F.col("p"), F.sha1("t"), "Is it?")
    files.write_json_lines(rec, f"{tmp_path}/r")
    assert files.read_records(spark, f"{tmp_path}/r").count() == 8
    files.write_splits(rec, f"{tmp_path}/s")
    with pytest.raises(PermissionError):
        files.read_split(spark, f"{tmp_path}/s", "test")
    for _ in range(2):
        files.append_new(rec, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 8
    (tmp_path / "m.md").write_text("# A\n0. zero\n1. one\n## B\n| x | [y](u) |\n|---|---|\n| 1 | `2` |\n")
    s = files.markdown_sections(spark, f"{tmp_path}/m.md")
    assert [(r.heading, r.text) for r in files.instruction_bank(s).orderBy("idx").collect()] == [("A", "zero"), ("A", "one")]
    assert [r.cells for r in files.markdown_tables(s).orderBy("line").collect()] == [["x", "y"], ["1", "2"]]


def test_stream_windows(spark, tmp_path):
    """Windows end: late rows are dropped and counted, repeated ones count once, state doesn't grow with the stream."""
    import os
    import shutil

    from quillon.streaming.streams import append_once, dropped_late, latency_windows, read_stream, run_windows, state_rows

    at = lambda hours: F.lit("2024-01-01").cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, CAST({hours} AS INT))")
    rows = lambda ids, hours: spark.range(*ids).select("id", at(hours).alias("ts"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    parts = [rows((0, 240), "id"), rows((200, 240), "id").unionByName(rows((240, 480), "id")), rows((480, 720), "id"), rows((5000, 5007), "5"), rows((720, 960), "id")]
    (tmp_path / "in").mkdir()
    for i, p in enumerate(parts):  # one file a batch, in order of time
        p.coalesce(1).write.parquet(f"{tmp_path}/p{i}")
        shutil.move(next((tmp_path / f"p{i}").glob("*.parquet")), tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 10 * i,) * 2)
    q = run_windows(read_stream(spark, f"{tmp_path}/in", parts[0].schema), f"{tmp_path}/w", f"{tmp_path}/c", late="2 days", key="id")
    # 40 days of 24 rows; the three that end within two days of the last row aren't over yet
    got = {(r.start.month, r.start.day): (r.n, r.mean) for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    assert all(got[1, d + 1] == (24, 24 * d + 11.5) for d in range(31)) and got[2, 1] == (24, 24 * 31 + 11.5)
    full = spark.read.parquet(f"{tmp_path}/w").groupBy().agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    assert (full.n, full.k) == (37 * 24, 37)
    assert dropped_late(q) == 7
    assert state_rows(q) < 200
    append_once(read_stream(spark, f"{tmp_path}/in", parts[0].schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 967
    assert latency_windows(parts[0]).agg(F.sum("n")).first()[0] == 240


def test_decide_scores_each_question_once_and_rejects_empty_requests(spark):
    from quillon.operators.scoring import decide

    schema = "state_id string, state string, questions array<struct<id:string,type:string,instruction:string,candidates:array<struct<id:string,text:string>>>>"
    q = [("q1", "choice", "which?", [("a", "x"), ("b", "longer")])]

    def scorer(batches):
        for b in batches:
            yield b.assign(logit=b["candidate"].str.len().astype(float))

    got = decide(spark.createDataFrame([("s", "t", q), ("r", "t", q)], schema), scorer).collect()
    assert len(got) == 2 and all(r.answers[0].answer == 1 for r in got)
    with pytest.raises(Exception, match="1 to 64"):
        decide(spark.createDataFrame([("s", "t", [])], schema), scorer).collect()


def test_more_files(spark, tmp_path):
    import zipfile

    rec = adapters.boolean(spark.createDataFrame([(i, f"text {i}", 0.25) for i in range(8)], "k long, t string, p double"), "s", "k", "t", F.col("p"), F.sha1("t"), "Is it?")
    assert files.write_records(rec, f"{tmp_path}/r") == 8
    assert files.read_records(spark, f"{tmp_path}/r", most=3).count() == 3
    with pytest.raises(Exception, match="split"):
        files.write_records(rec.withColumn("split", F.lit("no")), f"{tmp_path}/bad")
    (tmp_path / "one.txt").write_text("a\nb\n")
    assert files.copy_verbatim(spark, f"{tmp_path}/one.txt", f"{tmp_path}/two.txt") == files.file_digests(spark, f"{tmp_path}/one.txt").first().sha256
    with pytest.raises(FileExistsError):
        files.copy_verbatim(spark, f"{tmp_path}/one.txt", f"{tmp_path}/two.txt")
    m = files.write_manifest(rec, ["family", "split"], f"{tmp_path}/m", f"{tmp_path}/one.txt", "license_class").collect()
    assert {(r.kind, r.value) for r in m} >= {("count", "8"), ("license", "8")} and any(r.kind == "file" and r.bytes == 4 for r in m)
    with zipfile.ZipFile(tmp_path / "names.zip", "w") as z:
        z.writestr("names.csv", "name,n\nALL,9\nSmith,3\n\"Lee, A\",2\nOrr,1\n")
    assert [tuple(r) for r in files.csv_in_zip(spark, f"{tmp_path}/names.zip", "names.csv", ["name", "n"], 2, ("ALL",)).collect()] == [("Smith", "3"), ("Lee, A", "2")]
    (tmp_path / "spec.md").write_text('## Candidates\n```json\n[{"id": "true", "description": " Yes. "}, {"id": "false", "description": "No."}]\n```\n## Other\n```json\n{bad\n```\n## Table\n| Run name | Score (%) |\n|---|---|\n| a | 12.5% |\n| b | **1,200** |\n| c | none |\n')
    s = files.markdown_sections(spark, f"{tmp_path}/spec.md")
    blocks = files.json_blocks(s)
    assert [(r.heading, r.body is None) for r in blocks.orderBy("block").collect()] == [("Candidates", False), ("Other", True)]
    described = files.authored(blocks, "candidates")
    assert {(r.id, r.description) for r in described.collect()} == {("true", "Yes."), ("false", "No.")}
    assert files.authored_criteria(described).first().criteria == {"true": "Yes.", "false": "No."}
    values = {(r.column, r.text): r.number for r in files.table_values(files.markdown_tables(s)).collect()}
    assert values["score", "12.5%"] == 0.125 and values["score", "**1,200**"] == 1200 and values["score", "none"] is None and ("run_name", "a") in values
    for _ in range(2):
        assert files.tokenised(rec, f"{tmp_path}/cache", "v1", F.split("state", " ")).count() == 8
    lines = files.report_lines(rec.groupBy("family").count(), "Counts")
    assert lines[0] == "## Counts" and lines[-2] == "| s | 8 |"
    with pytest.raises(ValueError):
        files.report_lines(spark.range(20), "x", 10)
    assert files.public(spark.createDataFrame([("i", "secret", 2)], "id string, text string, n long"), ["id"]).columns == ["id", "n"]
    (tmp_path / "items.jsonl").write_text('{"case": 1, "correct": true}\n{"case": 2, "missing": true}\n')
    assert files.item_rows(spark, f"{tmp_path}/items.jsonl", "case long, correct boolean").count() == 1


def test_stream_of_requests_is_answered_once(spark, tmp_path):
    from quillon.streaming.streams import decide_stream, read_stream

    schema = "state_id string, state string, questions array<struct<id:string,type:string,instruction:string,candidates:array<struct<id:string,text:string>>>>"
    q = [("q1", "choice", "which?", [("a", "x"), ("b", "longer")])]
    rows = spark.createDataFrame([("s", "t", q), ("r", "t", q), ("s", "t", q)], schema)
    rows.write.parquet(f"{tmp_path}/in")

    def scorer(batches):
        for b in batches:
            yield b.assign(logit=b["candidate"].str.len().astype(float))

    for _ in range(2):
        decide_stream(read_stream(spark, f"{tmp_path}/in", rows.schema), scorer, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.state_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["r", "s"]


def test_topic_sampler_and_merges(spark):
    from quillon.operators import generators as G

    topics = spark.createDataFrame([("tea", "Do you like tea?", "yes", "I love tea."), ("tea", "Do you like tea?", "no", "Never tea."), ("milk", "Is there milk?", "yes", "There is milk.")], "topic string, question string, level string, answer string")
    contrasts = spark.createDataFrame([("tea", "milk", "negate"), ("milk", "tea", "orthogonal")], "topic string, answer_topic string, relation string")
    every = G.topic_items(topics, contrasts, ["at home", "at work"], 12).collect()
    assert len({(r.question, r.answer, r.context) for r in every}) == 12
    assert {(r.level, r.label) for r in every if r.relation == "negate"} == {("yes", "no")} and {r.label for r in every if r.relation == "orthogonal"} == {"other"}
    some = [(r.question, r.answer, r.context) for r in G.topic_items(topics, contrasts, ["at home", "at work"], 5).collect()]
    assert some == [(r.question, r.answer, r.context) for r in G.topic_items(topics.repartition(3), contrasts, ["at home", "at work"], 5).collect()]
    with pytest.raises(Exception, match="only 12 distinct items"):
        G.topic_items(topics, contrasts, ["at home", "at work"], 13).collect()
    a = spark.createDataFrame([("1", "x")], "id string, v string")
    with pytest.raises(Exception, match="repeated id"):
        G.merged(a, a).collect()


def test_ordered_rank_is_exact(spark):
    import random

    values = random.Random(2).sample(range(100_000), 3000)
    got = dataset.ordered_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", sample=500, cuts=16).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted(values) and sorted(r["rank"] for r in got) == list(range(3000))
    names = [f"n{v}" for v in values[:40]]
    got = dataset.ordered_rank(spark.createDataFrame([(v,) for v in names], "v string"), "v", sample=20, cuts=4).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted(names)


def test_alternation_stops_with_the_shorter_class(spark):
    from quillon.operators import reports

    def by_hand(rows, most):
        left, out = {k: [i for i, x in rows if x == k] for k in (1, 0)}, []
        while len(out) < most:
            want = 1 if len(out) % 2 == 0 else 0
            if not left[want]:
                break
            out.append(left[want].pop(0))
        return out

    for rows, most in (([(i, int(i % 5 == 0)) for i in range(30)], 100), ([(i, int(i % 5 > 0)) for i in range(30)], 100), ([(i, i % 2) for i in range(30)], 7)):
        got = reports.alternate(spark.createDataFrame(rows, "i int, k int"), "k", 1, 0, [F.col("i")], most).orderBy("place").collect()
        assert [r.i for r in got] == by_hand(rows, most)


def test_small_text_functions(spark):
    assert one(spark, text.pretty_json(F.col("t")), t='{"b":[1],"a":"\u00e9"}') == '{\n  "b": [\n    1\n  ],\n  "a": "\u00e9"\n}'
    assert one(spark, text.pretty_json(F.col("t")), t="plain") == "plain"
    got = one(spark, F.transform(text.in_context(F.col("t"), "[0-9]+", 3, 2), lambda m: F.concat_ws("|", m["before"], m["hit"], m["after"])), t="abcd12ef345\u0001g")
    assert got == ["bcd|12|ef", "2ef|345| g"]
    assert one(spark, F.size(text.in_context(F.col("t"), "[0-9]+", 3, 2)), t="none") == 0


def test_personal_data_beside_letters_that_are_not_ascii(spark, tmp_path):
    """Word boundaries are those of the SQL: a letter with an accent ends a word."""
    import duckdb

    from quillon import plans

    texts = ["Häus 212-867-5309 now", "é212-867-5309", "212-867-5309ü", "ñus +49 30 901 820 44", "+49 30 901 820 44é", "éjane.roe@firm.co", "jane.roe@firm.coß", "ßDE89 3704 0044 0532 0130 00é", "é4539 5787 6362 1486", "22 Baker Hill Roadé", "éMary Johnsoné", "Dr. Wilsoné", "Susané Brown", "Susan Smithé", "Dr. \u0085Susan", "Mr. Susan"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pii_phone", "pii_verdict", "pii_rollup", "pii_redact", "pii_listed_names", *(f"pii_{c}" for c in pii.CHANNELS)):
        df = plans.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str), name
