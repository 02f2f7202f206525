"""Numbered lines, nested strings, paths from columns and token ids against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as TX
from quillon.functions import tokens as TK
from quillon.sources.lines import numbered_lines, read_json_lines


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    files = {}
    for name, n in (("a", 500), ("b", 1), ("c", 0), ("d", 300)):
        lines = [rng.choice(["", "x" * rng.randint(1, 80), "  ", f"é{rng.random()}"]) for _ in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
        files[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("256b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = numbered_lines(spark, str(tmp_path))
            got = {}
            for r in df.collect():
                got.setdefault(r.file[-5:-4], {})[r.line] = r.value
            assert got == {k: dict(enumerate(v, 1)) for k, v in files.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_json_lines_are_rows_with_a_reason(spark, tmp_path):
    lines = ['{"k": 1, "t": "a"}', "", '{"k": 2', '{"k": "x", "t": "b"}', "[1]", "7", '{"t": "only"}', "   ", '{"k": 3, "t": null, "more": []}', "nonsense"]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    got = {r.line: (tuple(r.record) if r.record else None, r.problem) for r in read_json_lines(spark, str(tmp_path / "l.jsonl"), "k long, t string").collect()}
    assert got == {1: ((1, "a"), None), 3: (None, "no JSON"), 4: (None, "a field has another type"), 5: (None, "no object"), 6: (None, "no object"), 7: ((None, "only"), None), 9: ((3, None), None), 10: (None, "no JSON")}


def test_strings_and_paths_of_nested_json(spark):
    rng = random.Random(4)

    def make(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 0:
            return rng.choice(["", "s", "é", "{", "a b"])
        if kind == 1:
            return rng.choice([None, 1, 2.5, True])
        return {rng.choice("abcd") * rng.randint(1, 2): make(depth - 1) for _ in range(3)} if kind == 2 else [make(depth - 1) for _ in range(rng.randint(0, 3))]

    def walk(v, path):
        if isinstance(v, str):
            return [(path or "$", v)] if v else []
        if isinstance(v, dict):
            return [x for k in sorted(v) for x in walk(v[k], f"{path}.{k}" if path else k)]
        return [x for i, y in enumerate(v) for x in walk(y, f"{path}[{i}]")] if isinstance(v, list) else []

    values = [make(5) for _ in range(80)]
    rows = spark.createDataFrame([*((i, json.dumps(v)) for i, v in enumerate(values)), (900, None), (901, "no json")], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", TX.iter_strings("t").alias("s")).collect()}
    for i, v in enumerate(values):
        assert [(x.path, x.value) for x in got[i]] == walk(v, "")
    assert got[900] is None and [(x.path, x.value) for x in got[901]] == [("$", "no json")]
    at = [('{"a": [1, {"b": "x"}]}', ["a", "1", "b"], "x"), ('{"a.b": {"0": 5}}', ["a.b", "0"], "5"), ("[3, 4]", ["1"], "4"), ("[3]", ["1"], None), ("[3]", ["a"], None), ('{"a": null}', ["a"], None), ('{"a": {"c": [1]}}', ["a"], '{"c": [1]}'), (None, ["a"], None), ("{", ["a"], None), ("{}", None, None)]
    df = spark.createDataFrame(at, "t string, p array<string>, want string").select(TX.dig("t", "p").alias("got"), "want").collect()
    assert [r.got for r in df] == [w for *_, w in at]


def test_token_ids_by_segment(spark):
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["State:\nhello there", "", None, "Straße 日本 " * 200]
    got = [r.ids for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(TK.token_ids("t", path).alias("ids")).collect()]
    assert got == [None if t is None else tok.encode(t, add_special_tokens=False).ids for t in texts]
    state, question = "State:\nIt rains", "\nQuestion:\nIs it wet?"
    paths = spark.createDataFrame([("yes",), ("no",)], "c string").select(TK.segment_token_ids(F.array(F.lit(state), F.lit(question), F.concat(F.lit("\nCandidate:\n"), "c"), F.lit(None)), path).alias("ids")).collect()
    shared = tok.encode(state, add_special_tokens=False).ids + tok.encode(question, add_special_tokens=False).ids
    assert all(p.ids[: len(shared)] == shared for p in paths) and paths[0].ids != paths[1].ids


def test_prefix_trees_compute_shared_tokens_once(spark):
    from quillon.operators import prefixes as PX

    rng = random.Random(3)
    rows = []
    for key in range(12):
        state = [rng.randrange(4) for _ in range(rng.randint(0, 5))]
        rows += [(key, state + [rng.randrange(3) for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(1, 9))]
    rows += [(50, None), (51, []), (None, [1, 2]), (None, [1, 3])]
    paths = spark.createDataFrame(rows, "k long, ids array<int>")
    tree = PX.prefix_tree(paths, "k", "ids")
    got = {}
    for r in tree.collect():
        got.setdefault(r.k, []).append(r)
    pairs = tree.alias("a").join(tree.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & PX.sees(F.col("a.enter"), F.col("b.enter"), F.col("b.leave"))).groupBy("a.k").count().collect()
    seen = {r.k: r["count"] for r in pairs}
    for key in {k for k, _ in rows}:
        own = [tuple(p) for k, p in rows if k == key and p is not None]
        nodes = {p[: i + 1] for p in own for i in range(len(p))}
        assert len(got.get(key, [])) == len(nodes) and sum(r.paths for r in got.get(key, [])) == sum(map(len, own))
        # a node sees the prefixes of itself and no other
        assert seen.get(key, 0) == sum(a[: len(b)] == b for a in nodes for b in nodes)
    totals = {r.k: (r.tokens, r.distinct_tokens, r.visible) for r in PX.shared(tree, "k").collect()}
    assert totals[None] == (4, 3, 1 + 2 + 2) and all(totals[k][2] == seen[k] for k in totals)
