"""Prefix-tree join of documents on the Jaccard similarity of their word shingles.

1. Documents with one and the same set are one class; only classes are joined.
2. One global order of shingles: those not seen often first, then by how often (powers of
   two), then by hash. Any order that all share is right; this one keeps common passages
   out of the short prefixes. Two sets can only link if their prefixes of
   ``n - ceil(t n) + 1`` shingles meet, so only prefixes are shuffled.
3. The classes whose prefixes hold a shingle go to that shingle's leader, the class with
   the most often seen shingles; the centre of a group of near copies leads its lists.
   The rows are one for each (leader, class), never one for each pair.
4. A leader's classes are one block, or several of bounded size that all hold the leader,
   by size classes. Those that can't link with any other in their block go: counts of
   shingles by the low bits of their hash bound the overlap of two sets from above. What is
   left is put in a prefix tree of ordered whole sets. Each set walks the tree with its
   partial overlap and leaves a subtree when what remains of both can't reach the threshold.
5. Blocks of one leader are then joined with each other, but for the classes that are
   already in the leader's largest component, whose links add nothing, and for size classes
   out of reach. Only counts meet first; whole sets follow for what may link.
6. Links are verified on whole sets as the walk ends at them. Components of links, then
   the smallest doc_id of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, components, done_with, heavy_of, in_bit_map, joined_by, lean, shards_for, stage
from .shingles import WordHashes, shingle_sets, text_blocks

#: A shingle is common if tasks that saw it often (LOCAL times or more) saw it COMMON times together.
LOCAL, COMMON = 2, 4
#: Common shingles whose rank is told to all tasks, at most (9 bytes each): the most frequent ones. It bounds a broadcast; others rank with the rare.
TOLD = 1_000_000
#: Classes in one prefix tree, at most, beside the leader.
BLOCK = 128
#: Classes that are compared with a block in one task, at most.
PROBES = 4096
#: Bits of the map of documents whose whole sets are wanted, at most (16 MB): it bounds a broadcast; beyond it more sets are made than are asked for, and a join drops them.
FILTER = 1 << 27
#: Numbers of blocks: size class (of a few hundred at most) and place within.
_STEPS, _SPAN = 1 << 10, 1 << 20


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def common_shingles(docs: DataFrame, text: str, k: int, least: int = LOCAL, common: int = COMMON, told: int = TOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks of shingles that tasks see often."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= least
            return pa.RecordBatch.from_arrays([pa.array(_signed(h[keep])), pa.array(c[keep].astype(np.int64))], ["token", "n"])

        for b in text_blocks(batches, 0):
            sets = shingle_sets(b.column(0).to_pylist(), k, known)
            held += sets
            n += sum(map(len, sets))
            if n >= 6_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    seen = docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= common)
    top = seen.orderBy(F.desc("n"), "token").limit(told).toArrow()
    h = np.asarray(top.column("token").to_numpy(), np.int64).view(np.uint64)
    rank = np.floor(np.log2(np.maximum(top.column("n").to_numpy(), 1))).astype(np.uint8)
    at = np.argsort(h)
    return h[at], rank[at]


def _ranks(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, rank = common
    if not len(keys):
        return np.zeros(len(h), np.uint8)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, rank[at], 0)


def _prefixes(k: int, num: int, den: int, common, types: list[str]):
    """Rows of a document: its class, set size, heat (mean rank of its shingles in 1/1000), and its class's prefix where the task meets the class first."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), set()
        for b in text_blocks(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), k, known)
            size = np.array([len(s) for s in sets], np.int64)
            ranks = _ranks(np.concatenate(sets) if sets else np.zeros(0, np.uint64), common.value)
            to = np.cumsum(size)
            cls, heat, rare, often, marks = [], [], [], [], []
            for s, e in zip(sets, to.tolist(), strict=True):
                n = len(s)
                if not n:
                    cls.append(None), heat.append(0), rare.append(None), often.append(None), marks.append(None)
                    continue
                c = _class(s)
                r = ranks[e - n : e]
                cls.append(c)
                heat.append(int(r.sum(dtype=np.int64)) * 1000 // n)
                if c in met:
                    rare.append(None), often.append(None), marks.append(None)
                    continue
                marks.append(sketch(s))
                if len(met) < 200_000:  # beyond this a class's prefix may be told twice, which does no harm
                    met.add(c)
                p = n - -(-num * n // den) + 1
                if r.any():
                    at = np.lexsort((s, r))[:p]
                    rare.append(_signed(s[at][r[at] == 0])), often.append(_signed(s[at][r[at] > 0]))
                else:
                    rare.append(_signed(s[:p])), often.append(None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(cls, pa.int64()), pa.array(heat, pa.int32()), pa.array(rare, lists), pa.array(often, lists), pa.array(marks, pa.binary())], types)

    return f


@lean
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of (token, cls, heat), whole tokens in each: the distinct (leader, cls) of tokens with two classes."""
    parts = [tuple(np.asarray(b.column(i)) for i in range(3)) for b in batches]
    if not parts:
        return
    token, cls, heat = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    at = np.lexsort((cls, heat, token))
    token, cls = token[at], cls[at]
    last = np.flatnonzero(np.append(token[1:] != token[:-1], True))
    lead = np.repeat(cls[last], np.diff(np.append(-1, last)))
    keep = lead != cls
    pair = np.unique(np.stack([lead[keep], cls[keep]], 1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["leader", "cls"])


def sketch(s: np.ndarray) -> bytes:
    """Counts of shingles by the low bits of their hash, at most 255 each: 2 to 4 shingles a count, so 16 times less than the set."""
    width = max(64, 1 << max(0, (len(s) - 1) // 4).bit_length())
    return np.minimum(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def may_link(num: int, den: int, size: np.ndarray, sketches: list[bytes], asks: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Groups of sets that may link: a number for each set, -1 where it can't link. From upper bounds on overlaps, so no link is lost.

    asks: the sets that are compared with all. apart: labels; sets of one label needn't link.
    The wider of two sketches is folded to the width of the other. Shingles beyond a count's
    255 may be anything.
    """
    group, width = np.arange(len(size)), np.array([len(x) for x in sketches])
    keep = np.zeros(len(size), bool)
    for w in np.unique(width):
        rows = np.flatnonzero(width >= w)
        # the widths of sizes in reach: a set of Jaccard num / den is den / num times as large at most
        rows = rows[width[rows] <= 4 * w * -(-den // num)]
        folded = [np.frombuffer(sketches[i], np.uint8).reshape(-1, w).sum(axis=0, dtype=np.int64) for i in rows]
        table = np.stack(folded).astype(np.int32)
        over, n = size[rows] - table.sum(axis=1), size[rows]
        own, asking = width[rows] == w, asks[rows]
        for i in np.flatnonzero(asking):
            # a pair is compared once: at the narrower width, and from the first one that asks
            other = (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & (own | own[i])
            other[: i + 1] &= ~asking[: i + 1]
            if apart is not None:
                other &= apart[rows] != apart[rows[i]]
            near = np.flatnonzero(other)
            if len(near):
                both = np.minimum(table[i], table[near]).sum(axis=1) + np.minimum(over[i], over[near])
                hit = rows[near[(num + den) * both >= num * (n[i] + n[near])]]
                if len(hit):
                    hit = np.append(hit, rows[i])
                    keep[hit] = True
                    group[np.isin(group, group[hit])] = group[hit].min()
    return np.where(keep, group, -1)


def _groups(columns: int, key: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """(key, the other columns as lists) of each run of rows with equal first ``key`` columns."""
    now, held = None, [[] for _ in range(columns - key)]
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True):
            if row[:key] != now:
                if now is not None:
                    yield now, held
                now, held = row[:key], [[] for _ in range(columns - key)]
            for h, v in zip(held, row[key:], strict=True):
                h.append(v)
    if now is not None:
        yield now, held


def _of_like_size(num: int, den: int):
    """Of rows (leader, block, cls, label, probe, n), sorted by leader and block: those with another one of a size in reach."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(i)) if i != 4 else np.asarray(b.column(i).cast(pa.int8())) for i in range(6)] for b in batches]
        if not parts:
            return
        leader, block, cls, label, probe, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        at = np.lexsort((n, block, leader))
        l, b, n = leader[at], block[at], n[at]  # noqa: E741
        near = (l[1:] == l[:-1]) & (b[1:] == b[:-1]) & (num * n[1:] <= den * n[:-1])
        at = at[np.append(near, False) | np.append(False, near)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (leader, block, cls, label)), pa.array(probe[at] == 1)], ["leader", "block", "cls", "label", "probe"])

    return f


def _sift(num: int, den: int):
    """Of rows (leader, block, cls, label, probe, n, sketch), sorted by leader and block: groups (leader, block, cls, label, probe) within that may link.

    A group is named by its members alone, so one that several leaders have is one.
    """

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (cls, label, probe, size, sketches) in _groups(7, 2, batches):
            first: dict[int, int] = {}
            for i, (c, p) in enumerate(zip(cls, probe, strict=True)):
                if c not in first or (p and not probe[first[c]]):
                    first[c] = i
            at = np.array(list(first.values()))
            cls, label, probe = np.array(cls, np.int64)[at], np.array(label, np.int64)[at], np.array(probe, bool)[at]
            group = may_link(num, den, np.array(size, np.int64)[at], [sketches[i] for i in at], probe, label)
            names = np.zeros(len(at), np.int64)
            for g in np.unique(group[group >= 0]):
                own = group == g
                names[own] = _class(np.sort(cls[own]).view(np.uint64))
            k = group >= 0
            yield pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(np.zeros(int(k.sum()), np.int64)), pa.array(cls[k]), pa.array(label[k]), pa.array(probe[k])], ["leader", "block", "cls", "label", "probe"])

    return f


class _Tree:
    """Prefix tree of rank sequences; edges hold runs of ranks."""

    __slots__ = ("run", "below", "sets", "least", "rest")

    def __init__(self, run):
        self.run, self.below, self.sets = run, [], []
        self.least, self.rest = 1 << 60, 0  # smallest set size and most ranks left after the run in this subtree


def _tree(seqs: list[np.ndarray], sizes: list[int]) -> _Tree:
    order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())

    def grow(lo: int, hi: int, depth: int) -> _Tree:
        a, z = seqs[order[lo]], seqs[order[hi - 1]]
        m = min(len(a), len(z))
        differ = np.flatnonzero(a[depth:m] != z[depth:m])
        to = depth + int(differ[0]) if len(differ) else m
        node = _Tree(a[depth:to])
        while lo < hi and len(seqs[order[lo]]) == to:
            node.sets.append(order[lo])
            lo += 1
        node.least = min((sizes[i] for i in node.sets), default=1 << 60)
        while lo < hi:
            head = seqs[order[lo]][to]
            end = lo + 1
            while end < hi and seqs[order[end]][to] == head:
                end += 1
            child = grow(lo, end, to)
            node.below.append(child)
            node.least = min(node.least, child.least)
            node.rest = max(node.rest, len(child.run) + child.rest)
            lo = end
        return node

    # all start at an empty root, so the first run may be empty
    root = _Tree(np.zeros(0, np.uint32))
    top = grow(0, len(order), 0)
    root.below, root.least, root.rest = [top], top.least, len(top.run) + top.rest
    return root


def tree_join(tokens: list[np.ndarray], num: int, den: int, same: list, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among sets (distinct hashes each) that join what isn't yet joined.

    same: a label of each set; sets of one label count as joined. probes: the sets that walk
    the tree (all, by default). The links returned span the same components as all links.
    """
    sizes = [len(t) for t in tokens]
    flat = np.concatenate(tokens)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    # within the tree the most shared come first; what one set has alone overlaps nothing
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
    shared = int((count > 1).sum())
    seqs, at = [], 0
    for n in sizes:
        r = np.sort(rank[inverse[at : at + n]])
        seqs.append(r[: np.searchsorted(r, shared)].astype(np.uint32))
        at += n
    root = _tree(seqs, sizes)
    parent = list(range(len(tokens)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, s in enumerate(same):
        parent[find(i)] = find(first.setdefault(s, i))
    links, mask = [], np.zeros(shared + 1, bool)
    for x in range(len(tokens)) if probes is None else probes:
        seq, n = seqs[x], sizes[x]
        mask[seq] = True
        stack = [(root, 0, 0)]
        while stack:
            node, over, used = stack.pop()
            if len(node.run):
                over += int(np.count_nonzero(mask[node.run]))
                used = int(np.searchsorted(seq, node.run[-1], side="right"))
            # the least overlap that a set of the subtree's smallest possible size needs
            need = -(-num * (n + max(node.least, -(-num * n // den))) // (num + den))
            if over + min(len(seq) - used, node.rest) < need:
                continue
            for y in node.sets:
                if y != x and find(x) != find(y) and den * over >= num * (n + sizes[y] - over):
                    parent[find(x)] = find(y)
                    links.append((x, y))
            stack += [(c, over, used) for c in node.below]
        mask[seq] = False
    return links


def _join_groups(num: int, den: int):
    """Rows (leader, block, cls, label, probe, tokens), sorted by leader and block: links (a, b) of each group."""

    def solve(cls: list, label: list, probe: list, tokens: list) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        for i, (c, p) in enumerate(zip(cls, probe, strict=True)):
            if c not in seen or (p and not probe[seen[c]]):
                seen[c] = i
        rows = list(seen.values())
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(tokens[i], np.uint64) for i in rows]
        probes = [j for j, i in enumerate(rows) if probe[i]]
        return [(cls[rows[a]], cls[rows[b]]) for a, b in tree_join(sets, num, den, [label[i] for i in rows], probes)]

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(6, 2, batches):
            out = solve(*held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return f


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "leader", "block").sortWithinPartitions("leader", "block")


_MEMBERS = "leader long, block long, cls long, label long, probe boolean"


def _sifted(rows: DataFrame, marks: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Groups of rows (leader, block, cls, label, probe) that may link by their sizes and sketches."""
    sized = _dealt(rows.join(marks.select("cls", "n"), "cls").select("leader", "block", "cls", "label", "probe", "n"), parts).mapInArrow(_of_like_size(num, den), _MEMBERS)
    sketched = _dealt(sized.join(marks, "cls").select("leader", "block", "cls", "label", "probe", "n", "sketch"), parts)
    return sketched.mapInArrow(_sift(num, den), _MEMBERS).distinct()


def _linked(rows: DataFrame, marks: DataFrame, tokens: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Links (a, b) within the blocks of rows (leader, block, cls, label, probe): sizes first, then sketches, then the whole sets of what may link."""
    sets = _dealt(_sifted(rows, marks, num, den, parts).join(tokens, "cls").select("leader", "block", "cls", "label", "probe", "tokens"), parts)
    return sets.mapInArrow(_join_groups(num, den), "a long, b long")


def _whole(words: int, told) -> object:
    """Of rows (hash of the key, text): (cls, tokens) of the texts whose key may be one of those in told's bit map."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), told.value
        for b in text_blocks(batches, 1):
            h = np.asarray(b.column(0), np.int64).view(np.uint64)
            b = b.filter(pa.array(in_bit_map(bits, h)))
            found = [s for s in shingle_sets(b.column(1).to_pylist(), words, known) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["cls", "tokens"])

    return f


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(key, n_shingles long, component_id): documents linked when ``den * both >= num * either`` of their shingle sets.

    A set is a text's distinct shingles of ``words`` lower-cased words; with fewer words the
    whole sequence is one shingle. A document without words or text has size 0, links with
    none and is its own component. component_id is the smallest key of the component.
    Repeated rows give a row each; rows with a null key take part, and a component of such
    rows alone has a null id. An empty table gives an empty table. Any threshold with
    0 < num <= den will do; others raise ValueError.

    One task sees a whole list only of shingles that aren't told as common. Such a one is in
    LOCAL - 1 texts of each 6,000,000 shingles that a task counts together at most, or rarer
    than the TOLD most frequent ones.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    common = spark.sparkContext.broadcast(common_shingles(docs, "text", words))  # TOLD rows of 9 bytes at most
    names = ["key", "n_shingles", "cls", "heat", "rare", "often", "sketch"]
    sets = stage(docs.mapInArrow(_prefixes(words, num, den, common, names), f"key {kind}, n_shingles long, cls long, heat int, rare array<long>, often array<long>, sketch binary"), "sets")
    parts = max(shards_for(docs, 8), shards_for(sets, 16))
    rare = sets.select(F.explode("rare").alias("token"), "cls", "heat").repartition(parts, "token")
    rare_stars = rare.mapInArrow(_stars, "leader long, cls long")
    often = stage(sets.select(F.explode("often").alias("token"), "cls", "heat").distinct(), "often")
    lead = stage(often.groupBy("token").agg(F.max(F.struct("heat", "cls")).alias("top"), F.count(F.lit(1)).alias("n")).select("token", F.col("top.cls").alias("leader"), "n"), "lead")
    often_stars = joined_by(often, lead.drop("n"), "token", heavy_of(lead.select("token", "n")), "inner").where("leader <> cls").select("leader", "cls")
    stars = stage(rare_stars.unionAll(often_stars).distinct(), "stars")
    done_with(common, often, lead)

    # groups by leader: a small one is one block, its leader included; of large ones each class goes to a block of its size class, the leader to all
    marks = stage(sets.where("sketch is not null").select("cls", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["cls"]), "marks")
    grown = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") > BLOCK)
    size = stage(grown, "leaders")
    led = heavy_of(size.select("leader", "n"))
    small = stars.join(size.where("not large"), "leader").select("leader", "cls") if led is None else joined_by(stars, size.select("leader", "large"), "leader", led).where("not large").select("leader", "cls")
    small = small.unionAll(size.where("not large").select("leader", F.col("leader").alias("cls")))
    groups = small.select("leader", F.lit(0).cast("long").alias("block"), "cls", F.col("cls").alias("label"), F.lit(True).alias("probe"))
    large = size.where("large").select("leader")
    some = bool(large.limit(1).count())
    if some:
        # Jaccard at the threshold needs sizes of the same or neighbouring classes
        step = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / min(num, 0.999 * den)) * (1 + 1e-6))).cast("int")
        held = joined_by(stars, large, "leader", led, "inner").join(marks.select("cls", "n"), "cls").select("leader", "cls", step.alias("step"))
        many = held.groupBy("leader", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        many = stage(many, "blocks")
        number = lambda at: (F.pmod("step", F.lit(_STEPS)) * _SPAN + at).cast("long").alias("block")
        held = stage(held.join(many, ["leader", "step"]).select("leader", "cls", "step", number(F.pmod(F.xxhash64("cls"), "blocks"))), "members")
        every = many.select("leader", "step", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")).select("leader", "step", number(F.col("at")))
        member = lambda df, probe: df.select("leader", "block", "cls", F.col("cls").alias("label"), F.lit(probe).alias("probe"))
        groups = groups.unionAll(member(held, True)).unionAll(member(every.select("leader", "block", F.col("leader").alias("cls")), True))

    # whole sets are made anew from the text of each class's first document, for classes that may be asked for
    first = sets.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("key").isNull().alias("none"), F.xxhash64("key").alias("hash"))).alias("first"))
    asked = stage(_sifted(groups, marks, num, den, parts), "asked")
    wanted = asked.select("cls").unionAll(held.select("cls")).unionAll(large.select(F.col("leader").alias("cls"))).distinct() if some else asked.select("cls").distinct()
    told = spark.sparkContext.broadcast(bit_map(first.join(wanted, "cls").select(F.col("first.hash").alias("hash")), "hash", FILTER))
    texts = docs.select(F.xxhash64(F.xxhash64("key")).alias("hash"), "text")
    tokens = stage(texts.mapInArrow(_whole(words, told), "cls long, tokens binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "tokens")
    done_with(told)
    parts = max(parts, shards_for(tokens, 8))
    links = stage(_dealt(asked.join(tokens, "cls").select("leader", "block", "cls", "label", "probe", "tokens"), parts).mapInArrow(_join_groups(num, den), "a long, b long"), "links")
    done_with(asked)

    # large groups: what isn't in the leader's largest component meets the blocks of its own and neighbouring size classes
    if some:
        label = stage(components(links), "labels")
        named = held.select("leader", "cls", "step", "block").join(label, held["cls"] == label["node"], "left").select("leader", "block", "step", "cls", F.coalesce("component", "cls").alias("label"))
        named = stage(named, "named")
        most = named.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("leader").agg(F.max(F.struct("n", "label")).alias("top")).select("leader", F.col("top.label").alias("main"))
        apart = named.join(most, "leader").where("label <> main").select("leader", "cls", "label", "step")
        near = apart.select("leader", "cls", "label", F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])).alias("step"))
        lots = stage(near.groupBy("leader", "step").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("lots")), "lots")
        within = lambda lot: (F.col("block") + lot.cast("long") * F.lit(_STEPS * _SPAN)).alias("block")
        probes = near.join(lots, ["leader", "step"]).join(every, ["leader", "step"])
        probes = probes.select("leader", within(F.pmod(F.xxhash64("cls", F.lit(7)), "lots")), "cls", "label", F.lit(True).alias("probe"))
        met = named.join(lots, ["leader", "step"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        met = met.select("leader", within(F.col("lot")), "cls", "label", F.lit(False).alias("probe"))
        more = _linked(met.unionAll(probes), marks, tokens, num, den, parts)
        links = stage(links.unionAll(more), "links")
        done_with(label, named, held, many, lots)
    group = components(links)
    least = sets.where("cls is not null").groupBy("cls").agg(F.min("key").alias("least"))
    class_group = least.join(group, least["cls"] == group["node"], "left").select("cls", "least", F.coalesce("component", "cls").alias("component"))
    ids = class_group.groupBy("component").agg(F.min("least").alias("component_id"))
    final = stage(class_group.join(ids, "component").select("cls", "component_id"), "classes")
    done_with(tokens, stars, size, marks, links)
    out = sets.select("key", "n_shingles", "cls").join(final, "cls", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
