"""Adapters from the column shapes of public datasets to records, and their registry.

An adapter is a projection over one split of one source. Rows come with a key column that
numbers them within the split. Groups are made so that rows on one text share a split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.functions.hashing import assign_split, pick_instruction
from quillon.functions.text import humanize
from quillon.operators.dataset import QUESTION
from quillon.sources.adapters import label_vocabulary, require

Adapter = Callable[[DataFrame, "Source", str], DataFrame]


@dataclass(frozen=True)
class Source:
    """name, family and license of a dataset; splits: of the hub, those beside train are official evaluation data."""

    name: str
    family: str
    license_class: str
    adapt: Adapter
    splits: tuple[str, ...] = ("train",)
    admitted: bool = True
    held_out: bool = False
    config: str | None = None

    def split(self, split: str, group: Column) -> Column:
        if self.held_out:
            return F.lit("heldout")
        return assign_split(group, held_out_test=len(self.splits) == 1) if split == "train" else F.lit("test")

    def build(self, spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
        """Records of all splits under root, of each the first ``most`` rows by key."""
        out = None
        for split in self.splits:
            rows = hub(spark, root, self.name, split, self.config)
            rows = self.adapt(rows.orderBy("key").limit(most) if most else rows, self, split)
            out = rows if out is None else out.unionByName(rows)
        return out


def hub(spark: SparkSession, root: str, name: str, split: str, config: str | None = None) -> DataFrame:
    """One split of a dataset that lies as Parquet under root/name/config/split."""
    return spark.read.parquet(f"{root}/{name}/{config or 'default'}/{split}")


def _question(name: str, kind: str, instruction: Column, candidates: Column | None = None, levels: Column | None = None, criteria: Column | None = None) -> Column:
    part = lambda c, x: (F.lit(None) if x is None else x).cast(QUESTION[c].dataType).alias(c)
    return F.struct(F.lit(name).alias("id"), F.lit(kind).alias("type"), instruction.alias("instruction"), part("candidates", candidates), part("levels", levels), part("criteria", criteria))


def _record(df: DataFrame, s: Source, split: str, row: Column, group: Column, state: Column, question: Column, probs: Column, hard: Column, provenance: str = "adjudicated_human_label", meta: Column | None = None) -> DataFrame:
    target = F.struct(F.lit("label_distribution").alias("semantic_kind"), F.lit(provenance).alias("provenance"), probs.alias("probs"), hard.cast("int").alias("hard"))
    none = F.lit(None).cast("map<string,string>")
    return df.select(
        F.concat_ws(":", F.lit(s.name), row).alias("id"), F.lit(s.name).alias("source"), group.alias("source_group"), F.lit(s.family).alias("family"), s.split(split, group).alias("split"),
        F.lit(s.license_class).alias("license_class"), F.to_json(state).alias("state"), question.alias("question"), target.alias("target"), (none if meta is None else meta).alias("meta"),
    )


def candidates(*each: tuple[str, str, str]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("label"), F.lit(c).alias("description")) for a, b, c in each])


def criteria(true: str, false: str) -> Column:
    return F.create_map(F.lit("true"), F.lit(true), F.lit("false"), F.lit(false))


def _key(split: str, *more: Column) -> Column:
    return F.concat_ws(":", F.lit(split), F.col("key"), *more)


def _by_text(s: Source, what: str, text: Column) -> Column:
    return F.concat(F.lit(f"{s.name}:{what}:"), F.substring(F.sha1(text), 1, 16))


def _by_row(s: Source, split: str | None = None) -> Column:
    return F.concat_ws(":", F.lit(s.name), *([F.lit(split)] if split else []), F.col("key"))


def _choice(df: DataFrame, label: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """df with label_index, without dropped labels, and the candidates of all the labels left."""
    rows = df.where(F.col(label).isNotNull() & ~F.col(label).isin(*drop) if drop else F.col(label).isNotNull())
    vocabulary = label_vocabulary(rows, label)  # 1000 labels at most
    names = F.broadcast(vocabulary.agg(F.array_sort(F.collect_list(F.struct("label_index", F.col(label).alias("label")))).alias(f"names_{label}")))  # one row
    rows = rows.join(F.broadcast(vocabulary.withColumnRenamed("label_index", f"index_{label}")), label).crossJoin(names)
    return rows, F.transform(f"names_{label}", lambda x: F.struct(x["label"].alias("id"), humanize(x["label"]).alias("label"), F.lit("").alias("description")))


def intents(text: str, label: str, instruction: str, bank: list[str] | None = None, drop: tuple[str, ...] = ()) -> Adapter:
    """A choice over all labels; dropped ones are numbered away. bank: wordings that training rows draw from."""

    def adapt(df: DataFrame, s: Source, split: str) -> DataFrame:
        rows, c = _choice(require(df, "key", text, label), label, drop)
        group = _by_row(s, split)
        said = pick_instruction(F.array(*map(F.lit, bank)), group, s.split(split, group)) if bank else F.lit(instruction)
        return _record(rows, s, split, _key(split), group, F.struct(F.col(text).alias("message")), _question("intent", "choice", said, c), vec.one_hot(F.size(c), f"index_{label}"), F.col(f"index_{label}"))

    return adapt


def two_choices(text: str, first: tuple[str, str, str], second: tuple[str, str, str]) -> Adapter:
    """Two questions (column, question id, instruction) on each row, in one group."""

    def adapt(df: DataFrame, s: Source, split: str) -> DataFrame:
        out = None
        for column, name, instruction in (first, second):
            rows, c = _choice(require(df, "key", text, column), column)
            one = _record(rows, s, split, F.concat_ws(":", F.col("key"), F.lit(name)), _by_row(s), F.struct(F.col(text).alias("message")), _question(name, "choice", F.lit(instruction), c), vec.one_hot(F.size(c), f"index_{column}"), F.col(f"index_{column}"))
            out = one if out is None else out.unionByName(one)
        return out

    return adapt


NLI = (("entailment", "entailment", "If the premise is true, so is the hypothesis."), ("neutral", "neutral", "The premise leaves it open whether the hypothesis is true."), ("contradiction", "contradiction", "If the premise is true, the hypothesis is false."))


def inference(premise: str = "premise", hypothesis: str = "hypothesis", label: str = "label", keep: str | None = None) -> Adapter:
    """Entailment, neutral or contradiction; rows without a gold label (not 0, 1 or 2) are left out; group by premise. keep: a column for meta."""

    def adapt(df: DataFrame, s: Source, split: str) -> DataFrame:
        rows = require(df, "key", premise, hypothesis, label).where(F.col(label).isin(0, 1, 2))
        q = _question("nli", "choice", F.lit("What does `premise`, taken as true, say of `hypothesis`?"), candidates(*NLI))
        meta = F.create_map(F.lit(keep), F.col(keep)) if keep and keep in df.columns else None
        return _record(rows, s, split, _key(split), _by_text(s, "premise", F.col(premise)), F.struct(F.col(premise).alias("premise"), F.col(hypothesis).alias("hypothesis")), q, vec.one_hot(3, label), F.col(label), meta=meta)

    return adapt


FACTS = {"SUPPORTS": ("supports", "supported", "By the evidence the claim is true."), "REFUTES": ("refutes", "refuted", "By the evidence the claim is false."), "NOT ENOUGH INFO": ("nei", "not enough information", "The evidence doesn't decide the claim.")}


def facts(df: DataFrame, s: Source, split: str) -> DataFrame:
    """Support, refutation or neither of a claim; group by page, or by claim where there is none."""
    rows = require(df, "key", "claim", "evidence", "label").where(F.col("label").isin(*FACTS))
    at = F.array_position(F.array(*map(F.lit, FACTS)), F.col("label")) - 1
    page = F.coalesce(F.nullif(F.col("page").cast("string"), F.lit("")), F.col("claim")) if "page" in df.columns else F.col("claim")
    q = _question("verdict", "choice", F.lit("Does `evidence` support or refute `claim`, or neither?"), candidates(*FACTS.values()))
    return _record(rows, s, split, _key(split), _by_text(s, "page", page), F.struct("claim", "evidence"), q, vec.one_hot(3, at), at)


def yes_no(name: str, columns: dict[str, str], truth: str, instruction: str, said: tuple[str, str], by: str | None = None) -> Adapter:
    """A boolean question on columns {state field: column}; truth: an SQL expression; group by the text of column ``by``, or by row."""

    def adapt(df: DataFrame, s: Source, split: str) -> DataFrame:
        rows = require(df, "key", *columns.values()).where(F.expr(truth).isNotNull())
        group = _by_text(s, by, F.col(by)) if by else _by_row(s, split)
        hard = F.expr(truth).cast("int")
        return _record(rows, s, split, _key(split), group, F.struct(*[F.col(c).alias(f) for f, c in columns.items()]), _question(name, "boolean", F.lit(instruction), criteria=criteria(*said)), vec.one_hot(2, hard), hard)

    return adapt


def grounded(df: DataFrame, s: Source, split: str) -> DataFrame:
    """Two rows of each input: its right answer and its invented one."""
    both = F.array(F.struct(F.lit("right").alias("tag"), F.col("right_answer").alias("answer"), F.lit(1).alias("hard")), F.struct(F.lit("halu").alias("tag"), F.col("hallucinated_answer").alias("answer"), F.lit(0).alias("hard")))
    rows = require(df, "key", "knowledge", "question", "right_answer", "hallucinated_answer").select("key", "knowledge", "question", F.explode(both).alias("a")).select("key", "knowledge", "question", "a.*")
    q = _question("grounded", "boolean", F.lit("Does `knowledge` bear out all of `answer` to `question`?"), criteria=criteria("The knowledge bears the answer out.", "The answer says what the knowledge doesn't."))
    return _record(rows, s, split, F.concat_ws(":", F.col("key"), "tag"), _by_row(s), F.struct("knowledge", "question", "answer"), q, vec.one_hot(2, "hard"), F.col("hard"))


ATTRIBUTES = ("toxicity", "insult", "threat", "identity_attack", "obscene")


def comments(df: DataFrame, s: Source, split: str) -> DataFrame:
    """A boolean per attribute with the annotators' share as soft target; blank texts and shares outside 0 to 1 are left out."""
    rows = require(df, "key", "text", *ATTRIBUTES).where(F.trim("text") != "").unpivot(["key", "text"], list(ATTRIBUTES), "attribute", "share").where(F.col("share").between(0, 1))
    p, name = F.col("share").cast("double"), humanize(F.col("attribute"))
    said = F.create_map(F.lit("true"), F.concat(F.lit("It is "), name, F.lit(".")), F.lit("false"), F.concat(F.lit("It isn't "), name, F.lit(".")))
    q = _question("attribute", "boolean", F.concat(F.lit("Would a reader find `comment` "), name, F.lit("?")), criteria=said)
    return _record(rows, s, split, F.concat_ws(":", F.col("key"), "attribute"), _by_row(s), F.struct(F.col("text").alias("comment")), q, F.array(1 - p, p), (p >= 0.5).cast("int"), "human_annotation_distribution")


def safety(df: DataFrame, s: Source, split: str) -> DataFrame:
    """Safe or unsafe prompts; the label is in the first of three columns that there is."""
    found = [c for c in ("prompt_label", "prompt_safety", "label") if c in df.columns]
    if "prompt" not in df.columns or not found:
        raise ValueError(f"{s.name}: no prompt or label among {', '.join(sorted(df.columns))}")
    low = F.lower(F.col(found[0]).cast("string"))
    rows = df.where((F.col("prompt") != "") & low.isin("safe", "unsafe"))
    hard = (low == "unsafe").cast("int")
    q = _question("unsafe", "boolean", F.lit("Is `prompt` unsafe to answer?"), criteria=criteria("It is unsafe.", "It is safe."))
    return _record(rows, s, split, F.col("key").cast("string"), _by_row(s), F.struct("prompt"), q, vec.one_hot(2, hard), hard)


def rated_completions(df: DataFrame, s: Source, split: str) -> DataFrame:
    """A score of 1 to 5 for each completion of a row that has one; all in the row's group."""
    rows = require(df, "key", "instruction", "completions").select("key", "instruction", F.posexplode("completions").alias("j", "c"))
    rating = F.trim(F.col("c.annotations.helpfulness.Rating").cast("string"))
    rows = rows.where(rating.isin("1", "2", "3", "4", "5"))
    levels = ["Not helpful.", "Slightly helpful.", "Moderately helpful.", "Helpful.", "Highly helpful."]
    q = _question("helpfulness", "score", F.lit("How helpful an answer to `instruction` is `response`?"), levels=F.array(*map(F.lit, levels)))
    hard = rating.cast("int") - 1
    return _record(rows, s, split, F.concat_ws(":", F.col("key"), F.col("j")), _by_row(s), F.struct("instruction", F.coalesce("c.response", F.lit("")).alias("response")), q, vec.one_hot(5, hard), hard)


def levels(name: str, columns: tuple[str, ...], label: str, steps: list[str], instruction: str, by: str | None = None) -> Adapter:
    """A score over given levels; rows without a level in range are left out; group by the text of ``by``, or by row."""

    def adapt(df: DataFrame, s: Source, split: str) -> DataFrame:
        rows = require(df, "key", *columns, label).where(F.col(label).between(0, len(steps) - 1))
        group = _by_text(s, by, F.col(by)) if by else _by_row(s, split)
        return _record(rows, s, split, _key(split), group, F.struct(*columns), _question(name, "score", F.lit(instruction), levels=F.array(*map(F.lit, steps))), vec.one_hot(len(steps), label), F.col(label))

    return adapt


def toxicity_level(df: DataFrame, s: Source, split: str) -> DataFrame:
    """The annotators' share of toxicity over five levels, in the groups, so the splits, of ``comments``."""
    rows = require(df, "key", "text", "toxicity").where((F.trim("text") != "") & F.col("toxicity").between(0, 1))
    probs = vec.ordinal_soft_target(F.col("toxicity").cast("double"), 5)
    steps = ["Not toxic.", "Slightly toxic.", "Moderately toxic.", "Very toxic.", "Severely toxic."]
    q = _question("toxicity_level", "score", F.lit("How toxic would readers find `comment`?"), levels=F.array(*map(F.lit, steps)))
    group = F.concat_ws(":", F.lit(s.name.split("#")[0]), F.col("key"))
    return _record(rows, s, split, F.concat_ws(":", F.col("key"), F.lit("score")), group, F.struct(F.col("text").alias("comment")), q, probs, vec.argmax(probs), "human_annotation_distribution")


def replies(df: DataFrame, s: Source, split: str) -> DataFrame:
    """What an indirect reply means, a choice over all labels by number; rows without a label are left out."""
    rows, c = _choice(require(df, "key", "context", "question-X", "answer-Y", "goldstandard1"), "goldstandard1")
    numbered = F.transform(c, lambda x, i: F.struct(i.cast("string").alias("id"), x["label"].alias("label"), F.lit("").alias("description")))
    state = F.struct("context", F.col("`question-X`").alias("question"), F.col("`answer-Y`").alias("answer"))
    at = F.col("index_goldstandard1")
    return _record(rows, s, split, F.col("key").cast("string"), _by_row(s), state, _question("meaning", "choice", F.lit("What does the reply in `answer` mean?"), numbered), vec.one_hot(F.size(c), at), at)


def holdings(df: DataFrame, s: Source, split: str) -> DataFrame:
    """A choice among a row's own endings."""
    c = F.transform("endings", lambda e, i: F.struct(i.cast("string").alias("id"), e.alias("label"), F.lit("").alias("description")))
    rows = require(df, "key", "context", "endings", "label").where(F.col("label").isNotNull())
    return _record(rows, s, split, _key(split), _by_row(s, split), F.struct("context"), _question("holding", "choice", F.lit("Which candidate is the holding that `context` leads to?"), c), vec.one_hot(F.size("endings"), "label"), F.col("label"))


def emotions(names: list[str], step: int = 7) -> Adapter:
    """A boolean for each emotion that a row has, and for every step-th one whether or not it has it."""

    def adapt(df: DataFrame, s: Source, split: str) -> DataFrame:
        asked = F.explode(F.array_union("labels", F.sequence(F.lit(0), F.lit(len(names) - 1), F.lit(step)))).alias("k")
        rows = require(df, "key", "text", "labels").select("key", "text", "labels", asked)
        name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
        hard = F.array_contains("labels", F.col("k")).cast("int")
        q = _question("emotion", "boolean", F.concat(F.lit("Does `text` express "), name, F.lit("?")))
        return _record(rows, s, split, F.concat_ws(":", F.col("key"), name), _by_row(s), F.struct("text"), q, vec.one_hot(2, hard), hard)

    return adapt


_ROUTE = "Which one intent does `message` have?"
_HELPFUL = ["Not helpful at all.", "Slightly helpful.", "Partly helpful.", "Mostly helpful.", "Perfectly helpful."]
_MOODS = ["Very negative.", "Negative.", "Neutral.", "Positive.", "Very positive."]
_RATED = (("prompt", "response"), "helpfulness", _HELPFUL, "How helpful an answer to `prompt` is `response`?")


def sources(emotion_names: list[str] | None = None) -> dict[str, Source]:
    """The registry: every source by name. emotion_names: the label list of go_emotions, which its rows only number."""
    every = [
        Source("banking77", "support.routing.intent.banking77", "B", intents("text", "label_text", _ROUTE), ("train", "test")),
        Source("clinc_oos", "support.routing.intent.clinc150", "B", intents("text", "intent", _ROUTE), ("train", "validation", "test"), config="plus"),
        Source("massive_intent", "support.routing.intent.massive", "B", intents("text", "label", _ROUTE), ("train", "validation", "test"), config="en"),
        Source("bitext", "support.routing.bitext", "B", two_choices("instruction", ("intent", "intent", _ROUTE), ("category", "category", "Which category does `message` belong to?"))),
        Source("multi_nli", "verification.nli.mnli", "D", inference(keep="genre"), ("train", "validation_matched", "validation_mismatched"), admitted=False),
        Source("snli", "verification.nli.snli", "B", inference(), ("train", "validation", "test"), config="plain_text"),
        Source("vitaminc", "verification.fact.vitaminc", "B", facts, ("train", "validation", "test")),
        Source("boolq", "verification.boolq", "B", yes_no("answer", {"passage": "passage", "question": "question"}, "CAST(answer AS BOOLEAN)", "Does `passage` answer `question` with yes?", ("It answers yes.", "It answers no."), by="passage"), ("train", "validation")),
        Source("halueval", "verification.grounding.halueval", "A", grounded, admitted=False, config="qa"),
        Source("paws", "verification.paraphrase.paws", "B", yes_no("paraphrase", {"sentence1": "sentence1", "sentence2": "sentence2"}, "label = 1", "Do both sentences mean the same?", ("They do.", "They don't.")), ("train", "validation", "test"), config="labeled_final"),
        Source("civil_comments", "moderation.civil_comments", "A", comments),
        Source("aegis2", "moderation.aegis2", "B", safety, admitted=False),
        Source("ultrafeedback", "quality.score.ultrafeedback_helpfulness", "A", rated_completions, admitted=False),
        Source("sst5", "sentiment.score.sst5", "D", levels("sentiment", ("text",), "label", _MOODS, "Which mood has the sentence in `text`?"), ("train", "validation", "test"), admitted=False),
        Source("civil_comments#score", "moderation.score.civil_toxicity_level", "A", toxicity_level),
        Source("helpsteer2#train", "quality.score.helpsteer2", "B", levels("helpfulness", *_RATED, by="prompt"), ("train", "validation")),
        Source("circa", "heldout.pragmatics.circa", "B", replies, held_out=True),
        Source("casehold", "heldout.legal.casehold", "B", holdings, ("validation", "test"), held_out=True, config="case_hold"),
        Source("helpsteer2", "heldout.quality.helpsteer2", "B", levels("helpfulness", *_RATED), ("validation",), held_out=True),
    ]
    if emotion_names:
        every.append(Source("go_emotions", "heldout.emotion.goemotions", "A", emotions(emotion_names), ("test",), held_out=True, config="simplified"))
    return {s.name: s for s in every}


def mixtures(found: dict[str, Source]) -> dict[str, list[str]]:
    """Names of the sources of each mixture: the first one trains on all that isn't held out, the release only on what is admitted."""
    late = {"civil_comments#score", "helpsteer2#train", "snli"}
    train = [n for n, s in found.items() if not s.held_out and n not in late]
    held = [n for n, s in found.items() if s.held_out]
    release = [n for n in train if found[n].admitted] + [n for n in ("civil_comments#score", "helpsteer2#train") if n in found]
    return {"sprint_train": train, "sprint_heldout": held, "release_train": release, "release_heldout": [n for n in held if n != "helpsteer2"], "extra": [n for n in ("snli",) if n in found]}
