"""Approximate nearest neighbours by inner product with balanced posting lists.

Vectors are lifted by one component so that inner product orders like distance: a vector x
becomes (x, sqrt(R^2 - |x|^2)) with R the longest norm, a query (q, 0). Centroids are fit
by balanced k-means on a bounded sample, clusters over twice the mean are split and tiny
ones go; there are at most ``max_lists``, so they and the neighbour graph over them are a
bounded broadcast. Every vector goes to its nearest list and, near a boundary, to the next
ones whose distance is within a ratio of the nearest's. A query reads the lists whose
distance is within another ratio of its near lists'. That ratio is measured, not given: it is
the least one that covers the share ``aim`` of the true neighbours of sampled vectors.
Where neighbours are close by, it lets a few lists in; where directions are all alike (as
random ones are), no split of space separates near from far, and it lets many in. The
distance that counts as nearest is that of the NEAR-th list: the very nearest may hold the
query and little else, and says nothing on how far its neighbours are.

The graph is walked for the nearest centroids; where the ratio lets in so many lists that
a walk would meet most centroids, all distances are computed instead. Scores are exact, in
double precision, on the original vectors.

Lists lie in shelves of neighbouring lists. A query goes once to each shelf that it reads
from, with the numbers of its lists there; large shelves and many queries are dealt in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import done_with, lean, shards_for, stage

#: Lists at most, vectors a list about, sampled vectors a list: the sample is MAX_LISTS * PER_CENTROID vectors at most.
MAX_LISTS, LIST, PER_CENTROID = 4_096, 32, 16
#: Rows that meet the centroids at once: it bounds the driver's memory while it fits them.
AT_ONCE = 256
#: Vectors and queries that one block meets, at most about.
BLOCK, LOT = 32_768, 16_384
#: The list whose distance counts as near.
NEAR = 8
#: Share of true neighbours that the measured ratio covers.
AIM = 0.972


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _nearest(x: np.ndarray, c: np.ndarray, price: np.ndarray | float = 0.0) -> np.ndarray:
    return np.concatenate([np.argmin(_d2(x[i : i + AT_ONCE], c) + price, axis=1) for i in range(0, len(x), AT_ONCE)])


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 6, slack: float = 1.3, most: float = 2.0, least: float = 0.2) -> np.ndarray:
    """k-means whose steps charge full clusters; then clusters over ``most`` times the mean are split in two and those under ``least`` times go."""
    rng = np.random.default_rng(7)
    x = x.astype(np.float32)
    c = x[rng.permutation(len(x))[:lists]].copy()
    price, fair = np.zeros(len(c), np.float32), len(x) / len(c)
    for _ in range(rounds):
        near = _nearest(x, c, price)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        spread = float(((x - c[near]) ** 2).sum(1).mean())
        price = np.maximum(price + 0.5 * spread * (n / (slack * fair) - 1), 0).astype(np.float32)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[rng.permutation(len(x))[: len(empty)]]
            price[empty] = 0
    for _ in range(6):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        large, small = np.flatnonzero(n > most * fair), n < least * fair
        if not len(large) and not small.any():
            break
        halves = []
        for i in large:
            own = x[near == i]
            # two ends of the widest direction, then a few steps of 2-means
            two = own[[np.argmin(p := (own - own.mean(0)) @ (own[np.argmax(((own - own.mean(0)) ** 2).sum(1))] - own.mean(0))), np.argmax(p)]]
            for _ in range(4):
                side = np.argmin(_d2(own, two), axis=1)
                two = np.stack([own[side == j].mean(0) if (side == j).any() else two[j] for j in (0, 1)])
            halves.append(two)
        keep = ~small
        keep[large] = False
        c = np.concatenate([c[keep], *halves]) if keep.any() or halves else c
    return c


class Graph:
    """Neighbour graph over centroids, searched by many queries side by side."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, beam: int = 32, entries: int = 16):
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        degree = min(degree, n - 1)
        near = [np.argsort(_d2(self.c[i : i + 512], self.c), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 512)] if degree else [np.zeros((n, 0), np.int64)]
        rng = np.random.default_rng(11)
        far = rng.integers(0, n, (n, min(4, n)))  # a few long edges keep the graph in one piece
        self.next = np.concatenate([np.concatenate(near), far], axis=1).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, entries)).astype(np.int32))
        self.beam = max(beam, len(self.entries))

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, squared distances) of the k nearest centroids found, nearest first."""
        q = q.astype(np.float32)
        m, n = len(q), len(self.c)
        k = min(k, n)
        beam = max(self.beam, k)
        if beam * 8 >= n:  # a walk of this width would meet most centroids, each by itself
            dist = _d2(q, self.c)
            ids = np.argpartition(dist, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (m, 1))
            dist = np.take_along_axis(dist, ids, 1)
            order = np.argsort(dist, axis=1, kind="stable")
            return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        seen = np.zeros((m, n), bool)
        ids = np.tile(self.entries, (m, 1))
        dist = ((q[:, None] - self.c[ids]) ** 2).sum(2)
        seen[:, self.entries] = True
        done = np.zeros(ids.shape, bool)
        while True:
            open_ = np.where(done, np.inf, dist)
            at = np.argmin(open_, axis=1)
            rows = np.flatnonzero(np.isfinite(open_[np.arange(m), at]))
            if not len(rows):
                break
            done[rows, at[rows]] = True
            more = self.next[ids[rows, at[rows]]]
            fresh = ~seen[rows[:, None], more]
            seen[rows[:, None], more] = True
            d = np.where(fresh, ((q[rows, None] - self.c[more]) ** 2).sum(2), np.inf)
            new_ids, new_dist = np.zeros((m, more.shape[1]), np.int32), np.full((m, more.shape[1]), np.inf, np.float32)
            new_ids[rows], new_dist[rows] = more, d
            ids, dist = np.concatenate([ids, new_ids], 1), np.concatenate([dist, new_dist], 1)
            done = np.concatenate([done, np.zeros(new_ids.shape, bool) | ~np.isfinite(new_dist)], 1)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, keep, 1) for a in (ids, dist, done))
            done |= ~np.isfinite(dist)
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _within(ids: np.ndarray, d2: np.ndarray, ratio: float, near: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the nearest list and those whose distance is within a ratio of the near-th nearest one's."""
    d = np.sqrt(d2)
    near = min(near, d.shape[1])
    ok = (d <= ratio * d[:, near - 1 : near] + 1e-6) & np.isfinite(d)
    ok[:, 0] = True
    row, col = np.nonzero(ok)
    return row, ids[row, col]


@dataclass
class Index:
    """What routes vectors and queries to lists; bounded by the number of lists."""

    graph: Graph
    radius: float
    copies: int
    edge: float
    ratio: float
    probes: int
    shelf: np.ndarray  # of each list
    size: np.ndarray | None = None  # vectors posted to each list, once they are
    need: int = 0  # vectors that a query is to read at least

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0))[:, None]], 1)

    def post(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that vectors go to."""
        return _within(*self.graph.search(self.lift(x), self.copies), self.edge)

    def posted(self, size: np.ndarray, k: int) -> Index:
        """The index that knows its lists' sizes: a query then reads on until they hold k vectors besides itself, copies allowed for."""
        need = self.copies * (k + 1)
        lists = int(np.searchsorted(np.cumsum(np.sort(size)), need)) + 1
        return replace(self, size=size, need=need, probes=min(len(size), max(self.probes, lists)))

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that queries read."""
        ids, d2 = self.graph.search(np.concatenate([q, np.zeros((len(q), 1))], 1), self.probes)
        row, lst = _within(ids, d2, self.ratio, NEAR)
        if self.size is None:
            return row, lst
        held = self.size[ids]
        more = (np.cumsum(held, axis=1) - held < self.need) & np.isfinite(d2)
        i, j = np.nonzero(more)
        both = np.unique(np.stack([np.append(row, i), np.append(lst, ids[i, j])], 1), axis=0)
        return both[:, 0], both[:, 1]


def fit_index(x: np.ndarray, total: int, radius: float, lists: int, k: int, copies: int = 2, edge: float = 1.015, aim: float = AIM, asked: int = 400) -> Index:
    """An index fit on sampled vectors x of ``total``.

    The ratio of queries is measured on ``asked`` of them that the centroids aren't fit on:
    of each, as many true neighbours in the sample as k of all vectors are, at least one.
    """
    lift = np.concatenate([x, np.sqrt(np.maximum(radius**2 - (x * x).sum(1), 0))[:, None]], 1)
    some = np.random.default_rng(3).permutation(len(x))[: min(asked, len(x) // 4)]
    graph = Graph(balanced_centroids(np.delete(lift, some, axis=0), min(lists, len(x) - len(some))))
    n = len(graph.c)
    ix = Index(graph, radius, copies, edge, np.inf, n, _shelves(graph.c, max(8, -(-total * copies // BLOCK))))
    near = max(1, min(k, round(k * len(x) / max(1, total)), len(x) - 1))
    if not len(some) or n < 3:
        return ix
    posts = [ix.post(x[at : at + AT_ONCE]) for at in range(0, len(x), AT_ONCE)]  # a walk holds many vectors and flags a row
    row, lst = np.concatenate([r + i * AT_ONCE for i, (r, _) in enumerate(posts)]), np.concatenate([p for _, p in posts])
    first = np.searchsorted(row, np.arange(len(x) + 1))
    true = []
    for at in range(0, len(some), 32):  # a few rows of the sample's length at a time
        part = some[at : at + 32]
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -np.inf
        true += list(np.argpartition(s, len(x) - near, axis=1)[:, len(x) - near :])
    d = np.sqrt(_d2(np.concatenate([x[some], np.zeros((len(some), 1))], 1).astype(np.float32), graph.c))
    least = np.sort(d, axis=1)[:, min(NEAR, n) - 1]
    want = np.array([[min(d[i, lst[first[t] : first[t + 1]]]) / max(least[i], 1e-12) for t in true[i]] for i in range(len(some))])
    ix.ratio = float(np.quantile(want, aim)) * (1 + 1e-6)
    ix.probes = min(n, int(1.25 * (d <= ix.ratio * least[:, None] + 1e-6).sum(axis=1).max()) + 8)
    return ix


def _shelves(c: np.ndarray, shelves: int) -> np.ndarray:
    """Numbers of shelves of neighbouring lists, by halving along the widest component."""
    out, parts = np.zeros(len(c), np.int32), [np.arange(len(c))]
    while len(parts) < min(shelves, len(c)):
        parts.sort(key=len)
        part = parts.pop()
        at = part[np.argsort(c[part][:, np.argmax(c[part].var(axis=0))], kind="stable")]
        parts += [at[: len(at) // 2], at[len(at) // 2 :]]
    for i, part in enumerate(parts):
        out[part] = i
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _posted(index, dim: int):
    """Rows (vid, vector) to (list, vid, vector) for each list that a vector goes to."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, lst = ix.post(_matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([pa.array(lst.astype(np.int32)), *(c.take(pa.array(row)) for c in b.columns)], ["list", "vid", "vector"])

    return f


def _asked_of(index, dim: int):
    """Rows (vid, vector) to (shelf, vid, vector, lists) for each shelf that a query reads from."""

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, lst = ix.ask(_matrix(b.column(1), dim))
                shelf = ix.shelf[lst]
                order = np.lexsort((lst, shelf, row))
                row, lst, shelf = row[order], lst[order], shelf[order]
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1]))) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(lst.astype(np.int32)))
                take = pa.array(row[head])
                yield pa.RecordBatch.from_arrays([pa.array(shelf[head].astype(np.int32)), *(c.take(take) for c in b.columns), lists], ["shelf", "vid", "vector", "lists"])

    return f


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x, summed in component order in double precision."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _scan(k: int, dim: int):
    names = ["qid", "vid", "score"]

    def best(q: np.ndarray, x: np.ndarray, qid: np.ndarray, vid: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs (query i, vector j) each query's k best different ids, with exact scores."""
        keep = qid[i] != vid[j]
        i, j = i[keep], j[keep]
        score = exact_scores(q[i], x[j])
        order = np.lexsort((vid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        # copies of a vector in several lists lie side by side
        keep = np.append(True, (i[1:] != i[:-1]) | (vid[j[1:]] != vid[j[:-1]]) | (score[1:] != score[:-1])) if len(i) else np.zeros(0, bool)
        i, j, score = i[keep], j[keep], score[keep]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return i[rank < k], j[rank < k], score[rank < k]

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one block of a shelf and the queries that read it: each query's k best vectors."""
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        left, right = left.combine_chunks(), right.combine_chunks()
        col = lambda t, c: t.column(c).combine_chunks()
        order = np.argsort(np.asarray(col(left, "list")), kind="stable")
        lst, vid, x = np.asarray(col(left, "list"))[order], np.asarray(col(left, "vid"))[order], _matrix(col(left, "vector"), dim)[order]
        qid, q = np.asarray(col(right, "vid")), _matrix(col(right, "vector"), dim)
        asked = col(right, "lists")
        reader = np.repeat(np.arange(len(qid)), np.diff(np.asarray(asked.offsets)))
        of = np.asarray(asked.flatten())
        by = np.argsort(of, kind="stable")
        reader, of = reader[by], of[by]
        kept_i, kept_j, kept_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        new_i, new_j, n, floor = [], [], 0, np.full(len(qid), -np.inf)

        def fold() -> None:
            nonlocal kept_i, kept_j, kept_s, new_i, new_j, n
            kept_i, kept_j, kept_s = best(q, x, qid, vid, np.concatenate([kept_i, *new_i]), np.concatenate([kept_j, *new_j]))
            last = np.flatnonzero(np.append(kept_i[1:] != kept_i[:-1], True)) if len(kept_i) else np.zeros(0, np.int64)
            full = last[(last - np.searchsorted(kept_i, kept_i[last])) == k - 1]
            # what rounding can move a rough score by lets every true one through
            floor[kept_i[full]] = kept_s[full] - 1e-9 * (1 + np.abs(kept_s[full]))
            new_i, new_j, n = [], [], 0

        for at in np.unique(lst):
            a, b = np.searchsorted(lst, at), np.searchsorted(lst, at, "right")
            who = reader[np.searchsorted(of, at) : np.searchsorted(of, at, "right")]
            for part in range(0, len(who), 4096):
                some = who[part : part + 4096]
                for lo in range(a, b, 1024):
                    hi = min(b, lo + 1024)
                    i, j = np.nonzero(q[some] @ x[lo:hi].T >= floor[some][:, None])
                    new_i.append(some[i]), new_j.append(j + lo)
                    n += len(i)
                    if n > 300_000:
                        fold()
        fold()
        return pa.table([pa.array(qid[kept_i]), pa.array(vid[kept_j]), pa.array(kept_s)], names)

    return f


def nearest(table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, per_list: int = LIST, max_lists: int = MAX_LISTS, copies: int = 2, edge: float = 1.015, aim: float = AIM) -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score double): each query row's k nearest other rows by inner product.

    queries: which rows ask; all rows can be found but the query's own. Ties go to smaller
    ids. Vectors that are null, zero or hold null or non-finite components take no part, nor
    do null ids and vectors not of the commonest length, which have no inner product with
    the others. Fewer candidates than k: all found. A repeated row (same id and vector)
    counts once. The index is fit on about PER_CENTROID vectors a list (``max_lists`` lists at
    most), holds all, and finds approximately; scores are exact. An empty table gives an
    empty table.
    """
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = stage(_asked(table, queries, key, vector), "vectors")
    shape = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not shape:
        return spark.createDataFrame([], out)
    dim, radius = shape[0].dim, float(np.sqrt(shape[0].norm2))
    rows = rows.where(F.size("vector") == dim)
    use = _without_repeats(rows, k)
    total = use.count()
    lists = max(1, min(max_lists, total // per_list))
    part = min(1.0, max(2_000, PER_CENTROID * lists) / max(1, total))
    fit = use.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))).select("vector").toArrow()  # about the sample's size
    if not fit.num_rows:
        fit = use.select("vector").limit(1).toArrow()
    x = _matrix(fit.column("vector").combine_chunks(), dim)
    ix = fit_index(x, total, radius, min(lists, len(x)), k, copies, edge, aim)
    index = spark.sparkContext.broadcast(ix)  # max_lists centroids at most
    kind = rows.schema["vector"].dataType.simpleString()
    posted = stage(use.select(F.col("id").alias("vid"), "vector").mapInArrow(_posted(index, dim), f"list int, vid long, vector {kind}"), "lists")
    done_with(index)
    size = np.zeros(len(ix.graph.c), np.int64)
    for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # max_lists rows at most
        size[r["list"]] = r.n
    index = spark.sparkContext.broadcast(ix.posted(size, k))  # as above
    asks = rows.where("asks").select(F.col("id").alias("vid"), "vector").dropDuplicates()
    asked = stage(asks.mapInArrow(_asked_of(index, dim), f"shelf int, vid long, vector {kind}, lists array<int>"), "asked")
    done_with(index)
    # blocks of a shelf's vectors, lots of its queries: one row a shelf
    shelves = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(ix.shelf)], "list int, shelf int"))  # one row a list, max_lists at most
    placed = posted.join(shelves, "list")
    blocks = placed.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    lots = asked.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    deal = F.broadcast(stage(blocks.join(lots, "shelf"), "deal"))  # as above
    left = placed.join(deal, "shelf").select("shelf", F.pmod(F.xxhash64("vid"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "list", "vid", "vector")
    right = asked.join(deal, "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vid", F.lit(5)), "lots").cast("int").alias("lot"), "vid", "vector", "lists")
    parts = min(max(shards_for(posted, 4), int(spark.conf.get("spark.sql.shuffle.partitions"))), 20_000)
    by = ["shelf", "block", "lot"]
    found = left.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *by).groupBy(*by)).applyInArrow(_scan(k, dim), "qid long, vid long, score double")
    each = found.dropDuplicates(["qid", "vid", "score"]).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vid"))).where(F.col("rank") <= k)
    return each.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vid").alias("vec_id"), "score")


def _without_repeats(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, vector, ...) without repeated rows and, of equal vectors, beyond the k + 1 smallest ids that a result can need.

    Both are looked for in 24 bytes a row; vectors are only dealt anew where there are any.
    """
    slim = stage(rows.select("id", F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit(1)).alias("b")), "hashes")
    same = slim.groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    if same.where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "vector"])
    often = slim.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("a", "b")
    if often.limit(1).count():
        salted = W.partitionBy("a", "b", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
        few = same.join(often, ["a", "b"]).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
        few = few.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "a", "b")
        keyed = rows.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64("vector", F.lit(1)))
        few = stage(few.unionAll(same.join(often, ["a", "b"], "left_anti").select("id", "a", "b")), "few")
        rows = stage(keyed.join(few, ["id", "a", "b"], "left_semi").drop("a", "b"), "distinct")
        done_with(few)
    done_with(slim)
    return rows


def _asked(table: DataFrame, queries: Column, key: str, vector: str) -> DataFrame:
    flagged = table.select(F.struct(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks")).alias("who"), F.col(vector).alias("v"))
    v = F.col("v")
    ok = F.col("who.id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "float" if table.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    # adding zero makes -0.0 and 0.0 one
    rows = flagged.where(ok).select("who.id", "who.asks", F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("vector"))
    return rows.withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
