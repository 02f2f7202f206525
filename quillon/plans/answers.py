"""Queries on answers: metrics, calibration, temperature, resampling, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import vec
from quillon.functions.hashing import draw
from quillon.operators import metrics as M
from quillon.operators.scoring import few_labels
from quillon.operators.resample import SHARES, bootstrap, gap, group_sums

from .base import ARGMAX, BRIER, CONF, ENTROPY, HIT, NLL, md5_draw, over, pred_sql, predictions, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


PRED = "WITH " + pred_sql()
MODE = "(list_position(p, list_max(p)) - 1)"
SPREAD = over(f"p[i] * abs(i - 1 - {MODE})")
EVEN = f"({over(f'abs(i - 1 - {MODE})::DOUBLE')} / len(p))"
T = "list_transform(range(0, 121), lambda j: exp(ln(0.25::DOUBLE) + j * (ln(4.0::DOUBLE) - ln(0.25::DOUBLE)) / 120))"


@query(f"""{PRED} SELECT vec_id, {ARGMAX} AS answer, round(greatest(0.0::DOUBLE, (list_max(p) - 1.0::DOUBLE / len(p)) / (1.0::DOUBLE - 1.0::DOUBLE / len(p))), 6) AS choice_conf,
 round(greatest(0.0::DOUBLE, 1.0::DOUBLE - {SPREAD} / greatest({EVEN}, 1e-12::DOUBLE)), 6) AS score_conf, round({over("p[i] * (i - 1)")}, 6) AS level, round({ENTROPY}, 6) AS entropy FROM pred""")
def decide_centroid(spark, d):
    p = predictions(spark, d)
    return p.select("vec_id", vec.argmax("p").alias("answer"), F.round(vec.choice_confidence("p"), 6).alias("choice_conf"), F.round(vec.score_confidence("p"), 6).alias("score_conf"), F.round(vec.expected_level("p"), 6).alias("level"), F.round(vec.entropy("p"), 6).alias("entropy"))


@query(f"""{PRED} SELECT family, count(*) AS n, round(avg({HIT}), 6) AS accuracy, round(avg({NLL}), 6) AS nll, round(avg({BRIER}), 6) AS brier, round(avg({ENTROPY}), 6) AS entropy FROM pred GROUP BY ROLLUP (family)""")
def eval_summary_by_family(spark, d):
    return M.summarize(predictions(spark, d), "family").select("family", "n", *r6("accuracy", "nll", "brier", "entropy"))


def _ece_sql(v: str, at: str) -> str:
    return f"SELECT '{v}' AS variant, family, round(sum(abs(c - o) / a), 6) AS ece FROM (SELECT family, {at} AS bin, sum(conf) AS c, sum(ok) AS o FROM pairs GROUP BY 1, 2) JOIN (SELECT family, count(*) AS a FROM pairs GROUP BY 1) USING (family) WHERE bin >= 0 GROUP BY 2"


PAIRS = PRED + f", pairs AS (SELECT vec_id, family, {CONF} AS conf, {HIT} AS ok FROM pred)"


@query(f"{PAIRS} {_ece_sql('a', 'least(floor(conf * 15), 14)')} UNION ALL {_ece_sql('b', 'ceil(conf * 15) - 1')} UNION ALL {_ece_sql('c', 'greatest(ceil(conf * 15) - 1, 0)')}")
def ece_variants(spark, d):
    pairs = M.pairs_of(predictions(spark, d), "family")
    out = [M.ece(pairs, "family", variant=v).select(F.lit(v).alias("variant"), "family", *r6("ece")) for v in "abc"]
    return out[0].unionAll(out[1]).unionAll(out[2])


KERNEL = "(exp(-0.5 * pow((g - conf) / 0.05, 2)) + exp(-0.5 * pow((g + conf) / 0.05, 2)) + exp(-0.5 * pow((g - (2 - conf)) / 0.05, 2)))"
REL = PAIRS + f""", w AS (SELECT family, g / 200.0::DOUBLE AS g, conf, ok FROM pairs CROSS JOIN range(0, 201) AS r(g)), rel AS (SELECT family, g, sum({KERNEL}) AS density, sum({KERNEL} * conf) / sum({KERNEL}) AS confidence, sum({KERNEL} * ok) / sum({KERNEL}) AS accuracy FROM w GROUP BY 1, 2)"""


@query(REL + " SELECT family, round(sum(density * abs(accuracy - confidence)) / sum(density), 6) AS smooth_ece FROM rel GROUP BY 1")
def smooth_ece(spark, d):
    return M.smooth_ece(M.pairs_of(predictions(spark, d), "family"), "family").select("family", *r6("smooth_ece"))


@query(REL + ", tot AS (SELECT family, sum(density) AS all_ FROM rel GROUP BY 1) SELECT family, round(g, 6) AS g, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM rel JOIN tot USING (family) WHERE density / all_ > 0.02 / 201")
def reliability_curve(spark, d):
    rel = M.reliability(M.pairs_of(predictions(spark, d), "family"), "family")
    total = rel.groupBy("family").agg(F.sum("density").alias("all_"))
    return rel.join(total, "family").where(F.col("density") / F.col("all_") > 0.02 / 201).select("family", *r6("g", "confidence", "accuracy"))


BASE = PRED + """, base AS (SELECT family, list(m ORDER BY i) AS b FROM (SELECT family, i, avg(t[i]) AS m FROM pred CROSS JOIN range(1, 11) AS r(i) WHERE vec_id % 5 <> 0 AND family <> 'f3' GROUP BY 1, 2) GROUP BY 1)"""


@query(BASE + f" SELECT family, round(1 - avg(CASE WHEN b IS NOT NULL THEN {BRIER} END) / greatest(avg(CASE WHEN b IS NOT NULL THEN {over('(b[i] - t[i]) * (b[i] - t[i])')} END), 1e-12::DOUBLE), 6) AS skill, round(count(b) / count(*), 6) AS coverage FROM pred LEFT JOIN base USING (family) WHERE vec_id % 5 = 0 GROUP BY 1")
def base_rate_skill(spark, d):
    p = predictions(spark, d)
    base = M.base_rates(p.where("vec_id % 5 <> 0 AND family <> 'f3'"), "family")
    return M.brier_skill(p.where("vec_id % 5 = 0"), base, "family").select("family", *r6("skill", "coverage"))


@query(f"{PRED} SELECT family, round(avg(CASE WHEN vec_id % 3 = 0 THEN {BRIER} END), 6) AS known_q_l2, count(CASE WHEN vec_id % 3 = 0 THEN 1 END) AS n FROM pred GROUP BY 1")
def known_q_l2(spark, d):
    known = F.when(F.col("vec_id") % 3 == 0, vec.brier("p", "t"))
    return predictions(spark, d).groupBy("family").agg(F.round(F.avg(known), 6).alias("known_q_l2"), F.count(known).alias("n"))


CUM = "list_sum(list_transform(range(1, len(p) + 1), lambda i: pow(list_sum(p[1:i]) - list_sum(t[1:i]), 2)))"
CL = lambda x: f"greatest(least({x}, 1.0::DOUBLE), 1e-12::DOUBLE)"


@query(f"{PRED} SELECT family, round(avg({CUM}), 6) AS crps, round(avg({over(f'{CL("t[i]")} * (ln({CL("t[i]")}) - ln({CL("p[i]")}))')}), 6) AS kl, round(avg({NLL}), 6) AS ce, round(avg(-ln(greatest(p[gold + 1], 1e-12::DOUBLE))), 6) AS hard_nll FROM pred GROUP BY 1")
def crps_kl_ce(spark, d):
    p = predictions(spark, d)
    hard = -F.log(F.greatest(F.element_at("p", F.col("gold") + 1), F.lit(1e-12)))
    return p.groupBy("family").agg(*[F.round(F.avg(x), 6).alias(n) for n, x in (("crps", vec.crps("p", "t")), ("kl", vec.kl("t", "p")), ("ce", vec.soft_ce("p", "t")), ("hard_nll", hard))])


SOFT_T = "list_transform(z, lambda x: exp((x - list_max(z)) / tt))"
FIT = PRED + f""", tr AS (SELECT vec_id, family, gold, z, unnest({T}) AS tt FROM pred), ls AS (SELECT family, tt, avg(-ln({CL(f"(exp((z[gold + 1] - list_max(z)) / tt) / list_sum({SOFT_T}))")})) AS nll FROM tr GROUP BY GROUPING SETS ((family, tt), (tt))),
best AS (SELECT family, arg_min(tt, (round(nll, 12), tt)) AS tt, min(nll) AS nll FROM ls GROUP BY 1)"""


@query(FIT + " SELECT family, round(tt, 6) AS temperature, round(nll, 6) AS nll FROM best")
def temperature_fit(spark, d):
    p = predictions(spark, d)
    every = M.fit_temperature(p).select(F.lit(None).cast("string").alias("family"), "temperature", "nll")
    return M.fit_temperature(p, "family").unionByName(every).select("family", *r6("temperature", "nll"))


TEMPER = "list_transform(p, lambda x: CASE WHEN x > 0 THEN pow(greatest(least(x, 1.0::DOUBLE), 1e-12::DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END)"


@query(f"{PRED}, q AS (SELECT vec_id, p, {TEMPER} AS raised FROM pred), n AS (SELECT vec_id, p, list_transform(raised, lambda x: x / list_sum(raised)) AS q FROM q) SELECT vec_id, round(list_max(p), 6) AS before, round(list_max(q), 6) AS after, round({over('0.5::DOUBLE * abs(p[i] - q[i])')}, 6) AS tv FROM n")
def temper_before_after(spark, d):
    p = predictions(spark, d).select("vec_id", "p", vec.temper("p", 0.5).alias("q"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("before"), F.round(F.array_max("q"), 6).alias("after"), F.round(vec.total_variation("p", "q"), 6).alias("tv"))


@query(f"""{PRED}, a AS (SELECT family, gold, {ARGMAX} AS ans FROM pred), c AS (SELECT family, c, sum(tp) AS tp, sum(miss) AS miss FROM (SELECT family, gold AS c, (gold = ans)::INT AS tp, (gold <> ans)::INT AS miss FROM a UNION ALL SELECT family, ans, 0, (gold <> ans)::INT FROM a) GROUP BY 1, 2)
SELECT family, round(avg(2.0::DOUBLE * tp / greatest(1, 2 * tp + miss)), 6) AS macro_f1 FROM c GROUP BY 1""")
def macro_f1(spark, d):
    p = predictions(spark, d).withColumn("ans", vec.argmax("p"))
    return M.macro_f1(p, "gold", "ans", "family").select("family", *r6("macro_f1"))


@query(f"{PRED} SELECT family, round(avg(abs({over('p[i] * (i - 1)')} - gold)), 6) AS mae FROM pred GROUP BY 1")
def score_mae(spark, d):
    return predictions(spark, d).groupBy("family").agg(F.round(F.avg(F.abs(vec.expected_level("p") - F.col("gold"))), 6).alias("mae"))


def _times(seed: int) -> str:
    return "(" + " + ".join(f"(u{seed} >= {x})::INT" for x in SHARES) + ")"


def _drawn(sums: str, stat: str, columns: list[str], draws: int, seed: int, least: int = 5) -> str:
    """SQL of (b, stat): the statistic of each draw of the groups that ``sums`` gives as g and columns."""
    u = md5_draw("1000000", str(seed), "b", "g")
    totals = ", ".join(f"sum({c} * {_times(seed)}) AS {c}" for c in columns)
    return f"(SELECT b, {stat} AS stat FROM (SELECT b, count(*) AS groups, {totals} FROM (SELECT *, {u} AS u{seed} FROM ({sums}) CROSS JOIN range(0, {draws}) r(b)) GROUP BY b) WHERE groups >= {least})"


def _boot_sql(sums: str, stat: str, draws: int, seed: int, columns: tuple[str, ...] = ("n", "x")) -> str:
    return f"st AS (SELECT * FROM {_drawn(sums, stat, list(columns), draws, seed)}) {_ENDS}"


_ENDS = "SELECT round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi, round(avg(CASE WHEN stat <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS p_below FROM st"


@query(PRED + ", " + _boot_sql(f"SELECT grp AS g, count(*) AS n, sum({HIT}) AS x FROM pred GROUP BY 1", "x / n", 500, 1))
def group_bootstrap_ci(spark, d):
    return bootstrap(group_sums(predictions(spark, d), "grp", x=M.hit()), F.col("x") / F.col("n"), 500, 1).select(*r6("lo", "hi", "p_below"))


@query(PRED + ", " + _boot_sql(f"SELECT vec_id // 5 AS g, count(*) AS n, sum({BRIER}) AS x FROM pred GROUP BY 1", "x / n", 10_000, 4))
def case_bootstrap(spark, d):
    """Cases of five questions each, drawn whole."""
    p = predictions(spark, d).withColumn("case", F.expr("vec_id div 5"))
    return bootstrap(group_sums(p, "case", x=vec.brier("p", "t")), F.col("x") / F.col("n"), 10_000, 4).select(*r6("lo", "hi", "p_below"))


TWO = PRED + ", " + pred_sql(5.0, "other") + f", both_ AS (SELECT a.vec_id, a.family, a.grp, a.p AS p, b.p AS q, a.t AS t, a.gold AS gold FROM pred a JOIN other b USING (vec_id))"
BRIER_Q = over("(q[i] - t[i]) * (q[i] - t[i])")
NLL_Q = over("-t[i] * ln(greatest(least(q[i], 1.0::DOUBLE), 1e-12::DOUBLE))")


def _two(spark, d):
    other = predictions(spark, d, 5.0).select("vec_id", F.col("p").alias("q"))
    return predictions(spark, d).join(other, "vec_id")


@query(TWO + ", " + _boot_sql(f"SELECT grp AS g, count(*) AS n, sum({BRIER} - {BRIER_Q}) AS x FROM both_ GROUP BY 1", "x / n", 2000, 2))
def paired_bootstrap(spark, d):
    s = group_sums(_two(spark, d), "grp", x=vec.brier("p", "t") - vec.brier("q", "t"))
    return bootstrap(s, F.col("x") / F.col("n"), 2000, 2).select(*r6("lo", "hi", "p_below"))


@query(TWO + ", " + _boot_sql(f"SELECT floor(list_sum(p[1:3]) * 10)::BIGINT AS g, count(*) AS n, sum({NLL} - {NLL_Q}) AS x FROM both_ GROUP BY 1", "x / n", 10_000, 6))
def state_group_bootstrap(spark, d):
    """Rows drawn by the state that they share."""
    state = F.floor(F.aggregate(F.slice("p", 1, 3), F.lit(0.0), lambda a, x: a + x) * 10)
    s = group_sums(_two(spark, d).withColumn("state", state), "state", x=vec.nll("p", "t") - vec.nll("q", "t"))
    return bootstrap(s, F.col("x") / F.col("n"), 10_000, 6).select(*r6("lo", "hi", "p_below"))


_SIDE = lambda f: f"SELECT vec_id AS g, 1 AS n, {HIT} AS x FROM pred WHERE family = '{f}'"


@query(f"{PRED}, st AS (SELECT a.stat - b.stat AS stat FROM {_drawn(_SIDE('f0'), 'x / n', ['n', 'x'], 1000, 7, 0)} a JOIN {_drawn(_SIDE('f1'), 'x / n', ['n', 'x'], 1000, 8, 0)} b ON a.b = b.b) {_ENDS}")
def gap_bootstrap(spark, d):
    """The gap between two families, rows of each resampled by themselves."""
    p = predictions(spark, d)
    side = lambda f: group_sums(p.where(F.col("family") == f), "vec_id", x=M.hit())
    return gap(side("f0"), side("f1"), F.col("x") / F.col("n"), 1000, 7).select(*r6("lo", "hi", "p_below"))


@query(TWO + f""", f AS (SELECT family, avg({HIT}) AS acc, avg(CASE WHEN (list_position(q, list_max(q)) - 1) = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc_b, avg({NLL}) AS nll, avg({NLL_Q}) AS nll_b, count(*) AS n FROM both_ GROUP BY 1)
SELECT family, acc - acc_b >= 0.05 AS g1, nll - nll_b < 0 AS g2, CASE WHEN n < 200 THEN NULL ELSE nll < 2.5 END AS g3, round(nll - nll_b, 6) AS delta FROM f""")
def model_compare_gates(spark, d):
    hit_b = (vec.argmax("q") == F.col("gold")).cast("double")
    f = _two(spark, d).groupBy("family").agg(F.avg(M.hit()).alias("acc"), F.avg(hit_b).alias("acc_b"), F.avg(vec.nll("p", "t")).alias("nll"), F.avg(vec.nll("q", "t")).alias("nll_b"), F.count(F.lit(1)).alias("n"))
    return f.select("family", (F.col("acc") - F.col("acc_b") >= 0.05).alias("g1"), (F.col("nll") - F.col("nll_b") < 0).alias("g2"), F.when(F.col("n") >= 200, F.col("nll") < 2.5).alias("g3"), F.round(F.col("nll") - F.col("nll_b"), 6).alias("delta"))


@query(TWO + f""", a AS (SELECT family, count(*)::DOUBLE AS n, max({over('0.5::DOUBLE * abs(p[i] - q[i])')}) AS tv, sum(((list_position(p, list_max(p))) <> list_position(q, list_max(q)))::INT)::DOUBLE AS ch FROM both_ GROUP BY 1), z AS (SELECT *, (ch + 28) / (n + 6000) AS pool FROM a), zz AS (SELECT *, CASE WHEN pool > 0 THEN (ch / n - 28 / 6000.0::DOUBLE) / sqrt(pool * (1 - pool) * (1 / n + 1 / 6000.0::DOUBLE)) ELSE 0 END AS z FROM z)
SELECT family, round(tv, 6) AS tv_max, ch::BIGINT AS n_argmax_diff, round(z, 6) AS z, CASE WHEN tv > 0.07677 OR z > 1.645 THEN 'no' WHEN z < -1.645 THEN 'pass' ELSE 'at floor' END AS verdict FROM zz""")
def floor_gate(spark, d):
    a = _two(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("n_nonfinite"), F.max(vec.total_variation("p", "q")).alias("tv_max"), F.sum((vec.argmax("p") != vec.argmax("q")).cast("long")).alias("n_argmax_diff"))
    return M.floor_gate(a, 6000, 7.677e-02, 28).select("family", *r6("tv_max"), "n_argmax_diff", *r6("z"), "verdict")


@query(TWO + f" SELECT family, count(*) AS n, round(avg({HIT}), 6) AS acc, round(avg({NLL}), 6) AS nll_1, round(avg({NLL_Q}), 6) AS nll_t FROM both_ GROUP BY ROLLUP (family)")
def sealed_style_report(spark, d):
    g = _two(spark, d).select("family", M.hit().alias("h"), vec.nll("p", "t").alias("a"), vec.nll("q", "t").alias("b")).rollup("family")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("acc"), F.avg("a").alias("nll_1"), F.avg("b").alias("nll_t")).select("family", "n", *r6("acc", "nll_1", "nll_t"))


@query(TWO + f", m AS (SELECT vec_id, ({ARGMAX} = list_position(q, list_max(q)) - 1)::INT AS same, list_max(list_transform(range(1, 11), lambda i: abs(p[i] - q[i]))) AS moved FROM both_) SELECT round(avg(same), 6) AS equal_share, round(max(moved), 6) AS max_move, round(quantile_cont(moved, 0.9), 6) AS p90_move FROM m")
def order_recheck(spark, d):
    """How far answers move between two scorings of the same questions: two temperatures of one scorer stand for two orders of candidates."""
    moved = F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b)))
    m = _two(spark, d).select((vec.argmax("p") == vec.argmax("q")).cast("double").alias("same"), moved.alias("moved"))
    return m.agg(F.avg("same").alias("equal_share"), F.max("moved").alias("max_move"), F.percentile("moved", F.lit(0.9)).alias("p90_move")).select(*r6("equal_share", "max_move", "p90_move"))


@query(f"""{PRED}, r AS (SELECT vec_id, unnest(range(0, 10)) AS c, p, gold FROM pred), k AS (SELECT vec_id, c, p[c + 1] AS x, CASE WHEN c = gold THEN -1 ELSE {md5_draw('1000000007', '13', 'vec_id', 'c')} END AS h FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY h, c) AS rn FROM k)
SELECT vec_id, round(sum(x), 6) AS kept_mass, string_agg(c::VARCHAR, ',' ORDER BY c) AS kept FROM n WHERE rn <= 4 GROUP BY 1""")
def subsample_candidates(spark, d):
    r = predictions(spark, d).select("vec_id", "gold", F.posexplode("p").alias("c", "x"))
    h = F.when(F.col("c") == F.col("gold"), -1).otherwise(draw(1000000007, F.lit(13), F.col("vec_id"), F.col("c")))
    n = r.withColumn("rn", F.row_number().over(W.partitionBy("vec_id").orderBy(h, "c"))).where("rn <= 4")
    return n.groupBy("vec_id").agg(F.round(F.sum("x"), 6).alias("kept_mass"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("kept"))


@query(f"""WITH l AS (SELECT DISTINCT label FROM embeddings), x AS (SELECT e.vec_id, l.label AS c, CASE WHEN l.label = e.label THEN -1 ELSE {md5_draw('1000000007', '7', 'vec_id', 'l.label')} END AS h FROM embeddings e CROSS JOIN l), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY h, c) AS rn FROM x)
SELECT vec_id, string_agg(c::VARCHAR, ',' ORDER BY {md5_draw('1000000007', '8', 'vec_id', 'c')}, c) AS options FROM n WHERE rn <= 5 GROUP BY 1""")
def distractor_options(spark, d):
    """The gold label and four drawn ones, in drawn order; the label set is one row."""
    e = read(spark, d, "embeddings").select("vec_id", "label")
    labels = F.broadcast(few_labels(e, "label").agg(F.array_sort(F.collect_set("label")).alias("labels")))  # one row of labels
    opts = F.transform("labels", lambda c: F.struct(F.when(c == F.col("label"), F.lit(-1).cast("long")).otherwise(draw(1000000007, F.lit(7), F.col("vec_id"), c)).alias("h"), c.alias("c")))
    chosen = F.slice(F.array_sort(opts), 1, 5)
    shown = F.array_sort(F.transform(chosen, lambda s: F.struct(draw(1000000007, F.lit(8), F.col("vec_id"), s["c"]).alias("h"), s["c"].alias("c"))))
    return e.crossJoin(labels).select("vec_id", F.array_join(F.transform(shown, lambda s: s["c"].cast("string")), ",").alias("options"))


@query(f"{PRED} SELECT family, i AS label, count(*) AS n, round(sum(x), 6) AS mass, round(avg(x), 6) AS prior FROM (SELECT family, unnest(range(0, len(p))) AS i, unnest(p) AS x FROM pred) GROUP BY 1, 2")
def question_label_prior(spark, d):
    """The summed probability of each label of each question, and its share."""
    each = predictions(spark, d).select("family", F.posexplode("p").alias("label", "x"))
    return each.groupBy("family", F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("mass"), F.round(F.avg("x"), 6).alias("prior"))
