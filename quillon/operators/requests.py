"""Requests: cases with questions in JSON to requests and records, teacher answers to records, prompts of two baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import vec
from quillon.functions.hashing import h100
from quillon.functions.text import render
from quillon.operators.dataset import CANDIDATE, QUESTION

#: A question as cases give it: type (choice, noul for boolean, score), instructions, criteria as JSON text of an object or a list.
_ASKED = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("instructions", T.StringType()), T.StructField("criteria", T.StringType())]))
_GOLD = T.MapType(T.StringType(), T.StructType([T.StructField("label", T.StringType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))]))
_TEXTS = T.MapType(T.StringType(), T.StringType())


def candidates_of(criteria: Column) -> Column:
    """Candidates of a map key to description, by key: no description where it is null or the key's own shown form."""
    entry = lambda e: F.struct(e["key"].alias("id"), e["key"].alias("label"), F.when(e["value"].isNull() | (e["value"] == render(e["key"])), "").otherwise(e["value"]).alias("description"))
    return F.transform(F.array_sort(F.map_entries(criteria)), entry)


def option_candidates(options: Column) -> Column:
    """Candidates of a list of options, numbered from 0."""
    return F.transform(options, lambda o, i: F.struct(i.cast("string").alias("id"), o.alias("label"), F.lit("").alias("description")))


def questions_of(asked: Column) -> Column:
    """Questions of JSON {id: {type, instructions, criteria}}, in the order of the text."""

    def one(e: Column) -> Column:
        kind = F.when(e["value"]["type"] == "noul", "boolean").otherwise(e["value"]["type"])
        crit = e["value"]["criteria"]
        choice = F.when(kind == "choice", candidates_of(F.from_json(crit, _TEXTS)))
        levels = F.when(kind == "score", F.from_json(crit, T.ArrayType(T.StringType())))
        both = F.when(kind == "boolean", F.map_filter(F.from_json(crit, _TEXTS), lambda k, v: k.isin("true", "false") & v.isNotNull()))
        return F.struct(e["key"].alias("id"), kind.alias("type"), e["value"]["instructions"].alias("instruction"), choice.cast(T.ArrayType(CANDIDATE)).alias("candidates"), levels.alias("levels"), both.alias("criteria"))

    return F.transform(F.map_entries(F.from_json(asked, _ASKED)), one)


def case_requests(cases: DataFrame) -> DataFrame:
    """(id, state, questions) of cases (id, state, questions as JSON)."""
    return cases.select("id", "state", questions_of(F.col("questions")).alias("questions"))


def answer_keys(q: Column) -> Column:
    """The keys that an answer's probabilities have, in order."""
    return F.when(q["type"] == "choice", F.transform(q["candidates"], lambda c: c["id"])).when(q["type"] == "boolean", F.array(F.lit("false"), F.lit("true"))).otherwise(F.transform(q["levels"], lambda _, i: i.cast("string")))


def case_records(cases: DataFrame, prefix: str = "case", share: int = 15) -> DataFrame:
    """Records of cases (id, workflow, state, questions, gold), one per question: golden probabilities made to sum to 1.

    share per cent of cases, by a hash of the id, are dev. A question without any golden probability raises.
    """
    rows = cases.select("id", "workflow", "state", F.explode(questions_of(F.col("questions"))).alias("q"), F.from_json("gold", _GOLD).alias("gold"))
    keys = answer_keys(F.col("q"))
    raw = F.transform(keys, lambda k: F.coalesce(F.element_at(F.element_at(F.col("gold"), F.col("q.id"))["probabilities"], k), F.lit(0.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    probs = F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(F.raise_error(F.concat_ws(":", F.lit("no gold for"), "id", "q.id")))
    group = F.concat_ws(":", F.lit(prefix), "id")
    rows = rows.withColumn("probs", probs)
    target = F.struct(F.lit("label_distribution").alias("semantic_kind"), F.lit("teacher_distribution").alias("provenance"), F.col("probs"), vec.argmax("probs").alias("hard"))
    return rows.select(F.concat_ws(":", group, "q.id").alias("id"), F.lit(prefix).alias("source"), group.alias("source_group"), F.concat_ws(".", F.lit("fitted"), "workflow", "q.type").alias("family"), F.when(h100(F.col("id")) < share, "dev").otherwise("train").alias("split"), F.lit("B").alias("license_class"), "state", F.col("q").alias("question"), target.alias("target"), F.create_map(F.lit("workflow"), "workflow").alias("meta"), keys.alias("keys"))


def reject_reason() -> Column:
    """Of teacher rows (state, type, keys, answer, teacher_ok): the first reason to reject one, or null."""
    t, a, k = F.col("type"), F.col("answer"), F.size("keys")
    number = F.rlike(a, F.lit("^[0-9]+$"))
    reasons = [("teacher_disagreed", ~F.coalesce(F.col("teacher_ok"), F.lit(True))), ("empty_state", F.trim("state") == ""), ("bad_choice", (t == "choice") & ~F.array_contains("keys", a)), ("bad_noul", (t == "noul") & ~a.isin("true", "false")), ("bad_score", (t == "score") & ~(number & (F.when(number, a.cast("int")).otherwise(0) < k)))]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, holds in reasons:
        out = out.when(F.coalesce(holds, F.lit(True)), name)
    return out.when(~t.isin("choice", "noul", "score"), F.concat(F.lit("type_"), t)).when(t.isin("choice", "score") & (k < 2), "k<2")


def request_of(records: DataFrame) -> DataFrame:
    """(state_id, state, questions): each record as a request of one question."""
    return records.select(F.col("id").alias("state_id"), "state", F.array("question").alias("questions"))


def letter_prompt(state: Column, instruction: Column, labels: Column) -> Column:
    """A prompt whose answer is the letter of an option."""
    option = lambda x, i: F.concat(F.chr(i + 65), F.lit(") "), x)
    return F.concat_ws("\n", state, instruction, F.array_join(F.transform(labels, option), "\n"), F.lit("Answer:"))


def cloze_prompts(state: Column, instruction: Column, labels: Column) -> Column:
    """[(prompt, continuation)]: a prompt whose likeliest continuation is the answer."""
    return F.transform(labels, lambda x: F.struct(F.concat_ws("\n", state, instruction, F.lit("Answer:")).alias("prompt"), F.concat(F.lit(" "), x).alias("continuation")))


def with_split(records: DataFrame, split_fn) -> DataFrame:
    """records with the split that a function of their group gives."""
    return records.withColumn("split", split_fn(F.col("source_group")))


def taught_records(rows: DataFrame, guard: DataFrame, file: str = "taught", share: int = 5) -> DataFrame:
    """Records of teacher rows (i, j, state, type, instruction, keys, answer, teacher_p, teacher_ok) that nothing rejects.

    guard: (norm), normal texts of states that training must not see. The target is the
    answer, or the teacher's probability on it with the rest spread evenly. share per cent,
    by a hash of file and state, are dev. Keys are options of a choice or levels of a score.
    """
    from quillon.functions.text import normalise_ascii

    kept = rows.where(reject_reason().isNull()).withColumn("norm", normalise_ascii(F.col("state"))).join(guard.select("norm").distinct(), "norm", "left_anti")
    k = F.when(F.col("type") == "noul", 2).otherwise(F.size("keys"))
    at = F.when(F.col("type") == "choice", F.array_position("keys", F.col("answer")) - 1).when(F.col("type") == "noul", (F.col("answer") == "true").cast("int")).otherwise(F.expr("try_cast(answer AS INT)")).cast("int")
    kept = kept.withColumn("k", k).withColumn("at", at)
    probs = F.when(F.col("teacher_p").isNull(), vec.one_hot(F.col("k"), "at")).otherwise(vec.teacher_target(F.col("k"), "at", "teacher_p"))
    target = F.struct(F.lit("label_distribution").alias("semantic_kind"), F.when(F.col("teacher_p").isNull(), "hard_pseudo_label").otherwise("teacher_distribution").alias("provenance"), probs.alias("probs"), F.col("at").alias("hard"))
    none = lambda c: F.lit(None).cast(QUESTION[c].dataType)
    options = F.transform("keys", lambda x: F.struct(x.alias("id"), x.alias("label"), F.lit("").alias("description")))
    question = F.struct(F.concat(F.lit("q"), F.col("j").cast("string")).alias("id"), F.when(F.col("type") == "noul", "boolean").otherwise(F.col("type")).alias("type"), F.col("instruction"), F.when(F.col("type") == "choice", options).otherwise(none("candidates")).alias("candidates"), F.when(F.col("type") == "score", F.col("keys")).otherwise(none("levels")).alias("levels"), none("criteria").alias("criteria"))
    group = F.concat_ws(":", F.lit("taught"), F.lit(file), F.col("i").cast("string"))
    return kept.select(F.concat_ws(":", group, F.col("j").cast("string")).alias("id"), F.lit(file).alias("source"), group.alias("source_group"), F.concat(F.lit("taught."), F.col("type")).alias("family"), F.when(h100(F.concat_ws("|", F.lit(file), "norm")) < share, "dev").otherwise("train").alias("split"), F.lit("B").alias("license_class"), "state", question.alias("question"), target.alias("target"), F.lit(None).cast("map<string,string>").alias("meta"))
