"""Findings of round 4: the contamination scan's disk."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon import plans
from quillon.operators import contamination

SF = "/root/testdata/sf0.001"


def _shuffled(spark, group, run):
    """What run returns, and the records that its jobs' stages shuffled."""
    sc = spark.sparkContext
    sc.setJobGroup(group, "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_scan_shuffles_neither_grams_nor_pairs(spark):
    """Every pair shares rare grams; only the top ones of each evaluation row are shuffled, whatever the grams."""
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()
    common = make(40)
    t = spark.createDataFrame([(i, make(300) + common) for i in range(120)], "id long, norm string").repartition(3)
    e = spark.createDataFrame([(i, make(300) + common[:30]) for i in range(80)], "id long, norm string").repartition(3)
    got, records = _shuffled(spark, "scan-records", lambda: contamination.scan(t, e, top=5).collect())
    assert len(got) == 80 and all(r.train_id is not None and 0 < r.jaccard < 0.1 for r in got)
    assert records < 120 * 80, records  # the pairs; grams are 47,000


@pytest.mark.parametrize("lot, mapped, bits, cells", [(4_000_000, 40_000_000, 1 << 29, 2_000_000), (900, 2_000, 1 << 29, 100), (900, 2_000, 1024, 7)])
def test_scan_by_lots_is_that_of_brute_force(spark, monkeypatch, lot, mapped, bits, cells):
    """Lots, full maps and small tables of counts change no result, with rare and frequent grams, texts under 13 characters, null and empty ones."""
    for name, value in (("LOT", lot), ("MAPPED", mapped), ("BITS", bits), ("CELLS", cells), ("PAIRS", 50 if cells < 100 else 1_000_000)):
        monkeypatch.setattr(contamination, name, value, raising=False)
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()
    often = make(30)
    train = [make(120) + (often if i % 2 else "") for i in range(30)] + ["short", "", None]
    held = [rng.choice(train[:30])[20:80] + rng.choice(train[:30])[40:70] + often + make(20) for _ in range(50)] + ["short", "", None, "other"]
    t, e = (spark.createDataFrame(list(enumerate(x)), "id long, norm string") for x in (train, held))
    grams = lambda s: {s[i : i + 13] for i in range(len(s or "") - 12)}
    df = Counter(g for s in train for g in grams(s))
    want = {}
    for i, s in enumerate(held[:50]):
        both = {j: grams(s) & grams(x) for j, x in enumerate(train)}
        rare = {j: n for j, b in both.items() if (n := sum(df[g] <= 5 for g in b))}
        top = sorted(rare, key=lambda j: (-rare[j], j))[:3]
        want[i] = max(len(both[j]) / len(grams(s) | grams(train[j])) for j in top)
    got = {r.eval_id: r for r in contamination.scan(t, e, most_df=5, top=3, permutations=4, rows=4).collect()}
    assert len(got) == len(held)
    for i in want:  # a shared band of all four may add a candidate
        assert got[i].jaccard == want[i], i
    assert (got[50].train_id, got[50].jaccard, got[50].exact) == (30, 1.0, True)
    assert got[52].train_id is None and not got[52].exact and not got[51].exact


def test_report_reads_documents_without_shuffling_them(spark):
    """Few toxic ids are told to all tasks, so neither side of the scan shuffles texts."""
    from quillon.plans import texts

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in texts._held(spark, SF):
            assert "SortMergeJoin" not in side.select("id", F.length("norm"))._jdf.queryExecution().executedPlan().toString()
        assert plans.queries()["contam_report"](spark, SF).first().n_eval > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
