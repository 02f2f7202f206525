"""Generated records with exact truth, one for each row of a table: every choice is a hash of the row's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.functions.hashing import draw
from quillon.operators.dataset import refund_decision, urn_probs

CONDITIONS = ("unopened", "opened", "defective")
TIERS = ("standard", "standard", "gold")
COLOURS = ("red", "blue", "green", "black", "white", "yellow")


def _pick(names: tuple[str, ...], *parts):
    return F.element_at(F.array(*map(F.lit, names)), (draw(len(names), *parts) + 1).cast("int"))


def refund_cases(ids: DataFrame, seed: int = 1) -> DataFrame:
    """ids (id) to (id, source_group, policy and case columns, text, decision): drawn policies and cases with the decision that follows; the group is the policy."""
    i, s = F.col("id"), F.lit(seed)
    number = lambda name, *xs: F.element_at(F.array(*map(F.lit, xs)), (draw(len(xs), s, F.lit(name), i) + 1).cast("int")).alias(name)
    rows = ids.select(
        "id", number("window", 14, 30, 45, 60), number("defective", 90, 180, 365), number("grace", 0, 7, 14), number("fee", 0, 0, 10, 15),
        draw(121, s, F.lit("days"), i).cast("int").alias("days"), _pick(CONDITIONS, s, F.lit("cond"), i).alias("condition"), _pick(TIERS, s, F.lit("tier"), i).alias("tier"),
    )
    opened = F.col("condition") != "unopened"
    decision = refund_decision(F.col("days"), F.col("condition"), F.col("tier"), opened, F.col("window"), F.col("defective"), F.col("grace"), F.col("fee"))
    text = F.format_string("Returns within %d days, defects within %d, gold grace %d, fee %d. Bought %d days ago, %s, %s customer.", "window", "defective", "grace", "fee", "days", "condition", "tier")
    group = F.concat_ws(":", F.lit("refund"), "window", "defective", "grace", "fee")
    return rows.select("id", group.alias("source_group"), "window", "defective", "grace", "fee", "days", "condition", "tier", opened.alias("opened"), text.alias("text"), decision.alias("decision"))


def urns(ids: DataFrame, seed: int = 1) -> DataFrame:
    """ids (id) to (id, colours, counts, probs): 2 to 6 colours with 1 to 12 balls each; exact shares."""
    i, s = F.col("id"), F.lit(seed)
    k = (draw(5, s, F.lit("k"), i) + 2).cast("int")
    rows = ids.select("id", k.alias("k"))
    counts = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: draw(12, s, F.lit("c"), i, j) + 1)
    rows = rows.select("id", F.slice(F.array(*map(F.lit, COLOURS)), F.lit(1), F.col("k")).alias("colours"), counts.alias("counts"))
    return rows.withColumn("probs", urn_probs(F.col("counts")))


def urn_questions(u: DataFrame) -> DataFrame:
    """Two questions of each urn: which colour (choice), and whether it is the first one (boolean)."""
    choice = F.struct(F.lit("choice").alias("qtype"), F.lit("Which colour is drawn?").alias("instruction"), F.col("probs").alias("p"))
    first = F.struct(F.lit("boolean").alias("qtype"), F.concat(F.lit("Is it "), F.col("colours")[0], F.lit("?")).alias("instruction"), F.array(1 - F.col("probs")[0], F.col("probs")[0]).alias("p"))
    return u.select("id", F.explode(F.array(choice, first)).alias("q")).select("id", "q.*")


def learning_rate(step: Column, steps: Column, warmup: Column, peak: float, floor: float = 0.0) -> Column:
    """The rate at a step of so many: linear warm-up, then a cosine to floor."""
    t = (step - warmup) / F.greatest(F.lit(1), steps - warmup).cast("double")
    return F.when(step < warmup, F.lit(peak) * (step + 1) / warmup.cast("double")).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.pi() * t)))


#: Questions with replies that mean yes, no, or neither.
REPLIES = (
    ("Will you come to the game?", ("I bought a ticket weeks ago.", "Nothing could keep me away."), ("I am on call that night.", "My knee is in a cast."), ("If the rain stops.", "Maybe for the second half.")),
    ("Is the soup any good?", ("I am on my third bowl.", "Ask for the recipe."), ("The dog left it alone.", "I would rather have water."), ("It needs salt, but it is warm.",)),
    ("Did the parcel arrive?", ("I am wearing what was in it.",), ("The shelf in the hall is empty.", "They sent it back."), ("One of the two boxes did.",)),
)
MEANINGS = ("yes", "no", "conditional")


def implicatures(ids: DataFrame, seed: int = 1) -> DataFrame:
    """ids (id) to (id, source_group, question, reply, qtype, hard, probs): indirect replies with what they mean, as a choice and as a boolean of one group, the question."""
    i, s = F.col("id"), F.lit(seed)
    table = F.array(*[F.struct(F.lit(q).alias("q"), F.array(*[F.array(*map(F.lit, r)) for r in (a, b, c)]).alias("r")) for q, a, b, c in REPLIES])
    rows = ids.select("id", F.element_at(table, (draw(len(REPLIES), s, F.lit("q"), i) + 1).cast("int")).alias("t"), draw(3, s, F.lit("m"), i).cast("int").alias("m"))
    replies = F.element_at(F.col("t.r"), F.col("m") + 1)
    rows = rows.select("id", F.col("t.q").alias("question"), F.element_at(replies, (draw(F.size(replies), s, F.lit("r"), i) + 1).cast("int")).alias("reply"), "m")
    choice = F.struct(F.lit("choice").alias("qtype"), F.col("m").alias("hard"), vec.one_hot(3, "m").alias("probs"))
    yes = (F.col("m") == 0).cast("int")
    both = F.explode(F.array(choice, F.struct(F.lit("boolean").alias("qtype"), yes.alias("hard"), vec.one_hot(2, yes).alias("probs")))).alias("x")
    return rows.select("id", F.concat(F.lit("implicature:"), "question").alias("source_group"), "question", "reply", both).select("id", "source_group", "question", "reply", "x.*")


# What an answer about a related topic says of the topic asked about.
FLIP = {"yes": "no", "no": "yes", "probably_yes": "probably_no", "probably_no": "probably_yes", "middle": "middle", "conditional": "conditional"}
SUGGEST = {"yes": "probably_no", "probably_yes": "probably_no", "no": "probably_yes", "probably_no": "probably_yes", "middle": "middle", "conditional": "probably_no"}
PARTIAL = {"yes": "middle", "probably_yes": "middle", "middle": "middle", "conditional": "conditional", "no": "probably_no", "probably_no": "probably_no"}


def implied(level, relation):
    """The label of an answer of a level: as it is where the topics are one (null), turned by their relation, or ``other`` for unrelated topics."""
    turned = [F.when(relation == name, F.element_at(F.create_map(*[F.lit(x) for kv in rule.items() for x in kv]), level)) for name, rule in (("negate", FLIP), ("suggests_opposite", SUGGEST), ("partial", PARTIAL))]
    return F.when(relation.isNull(), level).otherwise(F.coalesce(*turned, F.when(relation == "orthogonal", "other")))


def topic_items(topics: DataFrame, contrasts: DataFrame, contexts: list[str], n: int, seed: int = 1) -> DataFrame:
    """(topic, answer_topic, relation, level, question, answer, context, label): n distinct items of all there are, by a hash; fewer raise when read.

    topics: (topic, question, level, answer). contrasts: (topic, answer_topic, relation). A
    contrast asks about one topic and answers about the other.
    """
    asked, said = topics.select("topic", "question").distinct(), topics.select(F.col("topic").alias("answer_topic"), "level", "answer").distinct()
    direct = asked.join(said, F.col("topic") == F.col("answer_topic")).withColumn("relation", F.lit(None).cast("string"))
    related = contrasts.join(asked, "topic").join(said.where(F.col("level").isin("yes", "no", "middle", "conditional")), "answer_topic")
    every = direct.unionByName(related).withColumn("context", F.explode(F.array(*map(F.lit, contexts)))).dropDuplicates(["question", "answer", "context"])
    every = every.withColumn("label", implied(F.col("level"), F.col("relation")))
    h = F.xxhash64(F.lit(seed), "question", "answer", "context")
    out = every.orderBy(h, "question", "answer", "context").limit(n)
    total = F.broadcast(every.agg(F.count(F.lit(1)).alias("__all")))  # one row
    enough = F.when(F.col("__all") < n, F.raise_error(F.concat(F.lit("only "), F.col("__all").cast("string"), F.lit(" distinct items")))).otherwise(F.lit(True)).cast("boolean")
    return out.crossJoin(total).where(enough).drop("__all")


def merged(base: DataFrame, synthetic: DataFrame, key: str = "id") -> DataFrame:
    """Training rows of both; a repeated id raises when read."""
    both = base.unionByName(synthetic)
    again = both.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    one = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")
    return both.join(again.where(one).select(key), key, "left_semi")


def receipt(rows: DataFrame, label: str, role: str) -> DataFrame:
    """(role, label, n): what a merge added, by role and label, and in all."""
    return rows.rollup(role, label).agg(F.count(F.lit(1)).alias("n"))
