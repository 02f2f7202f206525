"""Faults found in round 3."""

import os

import pytest
from pyspark.sql import functions as F

from quillon import plans
from quillon.functions import tokens
from quillon.operators import claims, contamination, resample

SF = "/root/testdata/sf0.001"


def test_index_of_a_vocabulary_keeps_its_grams_alone(spark):
    """The rows of an index of all grams, from a far smaller table; other evaluation sets raise."""
    import random
    import uuid

    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    train = [make(400) for _ in range(30)]
    t = spark.createDataFrame(list(enumerate(train)), "id long, norm string")
    e = spark.createDataFrame([(i, train[i][50:90] + make(20)) for i in range(5)], "id long, norm string")
    want = sorted(map(tuple, contamination.rare_candidates(t, e).collect()))
    index = contamination.GramIndex(spark, f"v_{uuid.uuid4().hex}", 4, vocabulary=e)
    index.add(t.where("id < 10")).add(t.where("id >= 10"))
    assert sorted(map(tuple, index.candidates(e).select("eval_id", "train_id", "shared").collect())) == want and want
    assert spark.table(index.name).count() < 500
    with pytest.raises(ValueError):
        index.candidates(spark.createDataFrame([(1, make(60))], "id long, norm string"))


def test_claims_of_one_form_meet_documents_in_lots(spark, monkeypatch):
    """A form of many claims and documents isn't met in one task, and nothing that is joined is made distinct."""
    monkeypatch.setattr(claims, "LOT", 4)
    monkeypatch.setattr(claims, "PAIRS", 100)
    asked = spark.range(50).select(F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("2.5").alias("form"))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("about 2.5, or 2.5").alias("text"))
    found = claims.said_by(asked.unionAll(asked), docs.unionAll(docs))
    assert found.count() == found.distinct().count() == 2000
    assert found.groupBy(F.spark_partition_id()).count().count() > 4


@pytest.mark.parametrize("pairs, least", [(1_000, 20), (10**9, 4)])
def test_draws_are_dealt_by_their_work(spark, monkeypatch, pairs, least):
    monkeypatch.setattr(resample, "PAIRS", pairs)
    sums = spark.range(40).select(F.col("id").alias("g"), F.lit(1.0).alias("n"), F.col("id").cast("double").alias("x"))
    each = resample._each_draw(sums, 500, 1)
    assert each.count() == 20_000 and each.rdd.getNumPartitions() >= least


def test_token_ids_are_made_in_small_lots(spark, monkeypatch):
    from quillon.plans.formats import tokenizer_files

    path = next(iter(tokenizer_files()))
    texts = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("word and "), "id")).alias("t")).coalesce(1)
    own = tokens._tokenizer(path)
    for r in texts.withColumn("ids", tokens.token_ids("t", path)).collect():
        assert r.ids == (None if r.t is None else own.encode(r.t, add_special_tokens=False).ids)
    assert tokens.AT_ONCE <= 64


def test_sessions_pass_small_batches_to_python(spark):
    import __spark_entry__ as e

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        e.queries()["contam_exact"](spark, SF)
        assert int(spark.conf.get(key)) == e.BATCH[key]
        spark.conf.set(key, "100")
        e.queries()["contam_exact"](spark, SF)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)


def test_a_files_parts_are_digested_by_themselves(spark, tmp_path, monkeypatch):
    from quillon.plans import formats

    monkeypatch.setattr(formats, "PART", 20_000)
    monkeypatch.setattr(formats, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    assert tuple(plans.queries()["verbatim_copies"](spark, SF).first()) == (3, 3)
    parts = [os.path.getsize(f"{at}/{n}") for at, _, names in os.walk(f"{tmp_path}/copies/to") for n in names if n.startswith("part-")]
    assert len(parts) > 6
    one = next(f"{at}/{n}" for at, _, names in os.walk(f"{tmp_path}/copies/from") for n in names if n.startswith("part-"))
    os.remove(one)
    from quillon.sources import files

    with pytest.raises(FileExistsError):
        files.copy_folder_verbatim(spark, f"{tmp_path}/copies/from", f"{tmp_path}/copies/to")


@pytest.mark.parametrize("name", ["implicature_generator", "learning_rate_schedule", "refund_generator", "source_registry", "urn_generator", "baseline_prompts", "hash_buckets"])
def test_query_reads_a_table(spark, name):
    assert plans.queries()[name](spark, SF).inputFiles()


@pytest.mark.parametrize("bits, pairs", [(1 << 30, 2_000_000), (1024, 50)])
def test_rare_grams_are_met_in_as_many_jobs_for_any_evaluation_side(spark, monkeypatch, bits, pairs):
    """Training texts aren't read anew for lots of evaluation rows, and a full bit map or small counts change no result."""
    import random
    from collections import Counter

    monkeypatch.setattr(contamination, "WANTED", 200)
    monkeypatch.setattr(contamination, "BITS", bits)
    monkeypatch.setattr(contamination, "PAIRS", pairs)
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    often = make(30)
    train = [make(150) + (often if i % 2 else "") for i in range(30)]
    held = [(i, rng.choice(train)[20:80] + rng.choice(train)[40:70] + often + make(20)) for i in range(60)]
    t = spark.createDataFrame(list(enumerate(train)), "id long, norm string")
    grams = lambda s: {s[i : i + 13] for i in range(len(s) - 12)}
    df = Counter(g for s in train for g in grams(s))
    sc, jobs = spark.sparkContext, []
    for rows in (held[:5], held):
        group = f"rare-{bits}-{len(rows)}"
        sc.setJobGroup(group, "")
        got = {(r.eval_id, r.train_id): r.shared for r in contamination.rare_candidates(t, spark.createDataFrame(rows, "id long, norm string"), 5, 1000).collect()}
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
        both = {(i, j): grams(s) & grams(x) for i, s in rows for j, x in enumerate(train)}
        want = {k: sum(df[g] <= 5 for g in v) for k, v in both.items() if any(df[g] <= 5 for g in v)}
        assert got == want and want
        o = contamination._Overlaps(t, spark.createDataFrame(rows, "id long, norm string"), 5)
        found = {(r.eval_id, r.train_id): r.jaccard for r in o.jaccard(o.pairs()).collect()}
        text = dict(rows)
        assert found == {(i, j): len(both[i, j]) / len(grams(text[i]) | grams(train[j])) for i, j in want}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3, jobs


def test_prefixes_split_a_text_once(spark):
    """The text isn't split again for each prefix; white space alone has no prefix, null has none to list."""
    from quillon.functions import text

    assert str(text.word_prefixes(F.col("t"))).count("split(") == 1
    rows = [(1, " a\t\tb  c "), (2, " \n"), (3, None), (4, "x"), (5, "")]
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id long, t string").select("id", text.word_prefixes(F.col("t")).alias("p")).collect()}
    assert got == {1: ["a", "a b", " a\t\tb  c "], 2: [], 3: None, 4: ["x"], 5: []}


def test_prefixes_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, " a\t\tb  c "), (1, 1, " \n"), (1, 2, None), (2, 0, "x"), (2, 1, ""), (2, 2, "été   你好 a")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.queries()["word_prefixes"](spark, str(tmp_path)).select("conv_id", "turn", "i", "prefix").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT conv_id, turn, i, prefix FROM ({plans.oracle_sql()['word_prefixes']})").fetchall())
