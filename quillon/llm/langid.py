"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language over letter runs of lower-cased text; a run begins and
ends with a boundary, and a context never crosses one, so a text's score is the sum of its
tokens' scores and a worker scores each distinct token once. Probabilities of all
languages lie beside each other in sorted arrays of gram hashes.

The models are fit on a bounded sample of the labelled rows: about ``max_docs`` documents
and ``max_chars`` characters of each language. Predictions read whole texts.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import done_with, lean, quoted, stage
from .shingles import mixed, text_blocks

ORDER = 4
MAX_DOCS, MAX_CHARS, MAX_LANGS = 4_000, 6_000_000, 1_000
UNKNOWN = "und"
CACHE = 100_000
_BOUNDARY = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def windows(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token number, gram) of each predicted character: four 16-bit codes, the predicted one lowest, 0 where the context ends."""
    raw = np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    # letters beyond 16 bits share the codes of the private area, by a hash
    folded = np.where(raw > 0xFFFF, 0xE000 + (raw * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(6400), raw)
    code = np.where(letter, folded, _BOUNDARY).astype(np.uint64)
    line = raw == 10
    token = np.cumsum(line) - line - 1
    asked = np.flatnonzero(letter[1:] | letter[:-1]) + 1
    edge = np.maximum.accumulate(np.where(letter, 0, np.arange(len(raw))))
    context = np.minimum(asked - edge[asked - 1], ORDER - 1)
    gram = code[asked].copy()
    for j in range(1, ORDER):
        has = context >= j
        gram[has] |= code[asked[has] - j] << np.uint64(16 * j)
    return token[asked], gram


def _order(gram: np.ndarray) -> np.ndarray:
    return 1 + sum((gram >> np.uint64(16 * j) != 0).astype(np.int64) for j in range(1, ORDER))


def _low(gram: np.ndarray, k: int) -> np.ndarray:
    """The last k characters of grams."""
    return gram & np.uint64((1 << (16 * k)) - 1 if k < 4 else 0xFFFFFFFFFFFFFFFF)


@dataclass
class Models:
    """All languages' models. rows of alpha: hashes in grams; of gamma: hashes in contexts."""

    langs: list[str] = field(default_factory=list)
    grams: np.ndarray = None
    alpha: np.ndarray = None
    contexts: np.ndarray = None
    gamma: np.ndarray = None
    base: float = 1.0
    limits: dict[str, float] = field(default_factory=dict)

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        """ln p of grams (full windows), a column for each language."""
        p = np.full((len(gram), len(self.langs)), self.base)
        have = _order(gram)
        for k in range(1, ORDER + 1):
            part = _low(gram, k)
            at = _find(self.contexts, mixed((part >> np.uint64(16)) + np.uint64(1) if k > 1 else np.zeros_like(part)))
            g = np.where(at[:, None] >= 0, self.gamma[at], 1.0)
            at = _find(self.grams, mixed(part))
            a = np.where(at[:, None] >= 0, self.alpha[at], 0.0)
            p = np.where((have >= k)[:, None], a + g * p, p)
        return np.log(p)


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from {language: (distinct full windows, how often)}.

    The highest order and grams that begin at a boundary use their counts, the rest the number
    of distinct characters seen before them; one discount per order, n1 / (n1 + 2 n2).
    """
    langs = sorted(counts)
    alphas, gammas, letters = [], [], set()
    for lang in langs:
        gram, n = counts[lang]
        order = _order(gram)
        above = None
        a_keys, a_vals, g_keys, g_vals = [], [], [], []
        for k in range(ORDER, 0, -1):
            own = order == k
            keys, num = gram[own], n[own].astype(float)
            if above is not None and len(above):
                low = _low(above, k)
                keys, num = np.concatenate([keys, low]), np.concatenate([num, np.ones(len(low))])
            keys, inv = np.unique(keys, return_inverse=True)
            num = np.bincount(inv, num, len(keys))
            above = keys
            if not len(keys):
                continue
            once, twice = (num == 1).sum(), (num == 2).sum()
            d = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
            ctx, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(at, num, len(ctx)), np.bincount(at, minlength=len(ctx))
            a_keys.append(mixed(keys)), a_vals.append(np.maximum(num - d, 0) / total[at])
            g_keys.append(mixed(ctx + np.uint64(1)) if k > 1 else mixed(np.zeros_like(ctx))), g_vals.append(d * kinds / total)
            if k == 1:
                letters |= set(keys.tolist())
        alphas.append((np.concatenate(a_keys), np.concatenate(a_vals)))
        gammas.append((np.concatenate(g_keys), np.concatenate(g_vals)))

    def table(parts: list, none: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        out = np.full((len(keys), len(parts)), none)
        for i, (k, v) in enumerate(parts):
            out[np.searchsorted(keys, k), i] = v
        return keys, out

    grams, alpha = table(alphas, 0.0)
    contexts, gamma = table(gammas, 1.0)
    return Models(langs, grams, alpha, contexts, gamma, 1.0 / (len(letters) + 1))


class _Tokens(dict):
    """Token to its number; new ones are scored together."""

    def __init__(self, models: Models):
        self.models, self.new = models, []
        self.scores = np.zeros((0, len(models.langs) + 1))

    def __missing__(self, token: str) -> int:
        self[token] = i = len(self)
        self.new.append(token)
        return i

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ln p by language, and numbers of predicted characters, for each text."""
        if len(self) > CACHE:
            self.clear()
            self.scores = self.scores[:0]
        split = [t.lower().split() if t else [] for t in texts]
        size = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter((i for s in split for i in map(self.__getitem__, s)), np.int64, int(size.sum()))
        if self.new:
            token, gram = windows(self.new)
            keys, inv = np.unique(gram, return_inverse=True)
            lp = self.models.log_p(keys)
            cols = [np.bincount(token, lp[inv, j], len(self.new)) for j in range(lp.shape[1])]
            self.scores = np.concatenate([self.scores, np.stack([*cols, np.bincount(token, minlength=len(self.new))], 1)])
            self.new = []
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros((len(texts), self.scores.shape[1]))
        full = size > 0
        if full.any():
            out[full] = np.add.reduceat(self.scores[ids], ends[:-1][full], axis=0)
        return out[:, :-1], out[:, -1]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, max_langs: int = MAX_LANGS, quantile: float = 0.999, margin: float = 1.0) -> Models:
    """Models of the labels in docs. Rows with null label or text don't count; without any row the models are empty.

    The sample takes rows whose hash of key lies below a share per language that gives about
    max_docs rows and max_chars characters, or all, and always the row of the smallest hash,
    so that no language goes without. A language's rejection limit is the quantile of
    cross-entropy over a fifth of its sample's rows, which the models aren't fit on, plus
    margin (nats a character); over all of them where that fifth or the rest is under 20
    rows. Over max_langs languages raise ValueError: it bounds the models.
    """
    use = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    sizes = use.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min(draw).alias("least")).limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    share = {r.lang: min(1.0, max_docs / max(1, r.n), max_chars / max(1, r.chars)) for r in sizes}
    if not share:
        return Models()
    table = lambda what: F.element_at(F.create_map(*[x for k, v in what.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    sample = use.where((draw < table(share)) | (draw == table({r.lang: r.least for r in sizes})))
    aside = F.pmod(F.xxhash64("key", F.lit("aside")), F.lit(5)) == 0
    sample = stage(sample.select("lang", "text", aside.alias("aside")), "sample")  # bounded as said
    few = {r.lang for r in sample.groupBy("lang").agg(F.count_if("aside").alias("a"), F.count_if(~F.col("aside")).alias("b")).collect() if min(r.a, r.b) < 20}
    every = F.col("lang").isin(*few) if few else F.lit(False)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, 1):
            words: dict[str, Counter] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(t.lower().split())
            for name, c in words.items():
                tokens = list(c)
                token, gram = windows(tokens)
                keys, inv = np.unique(gram, return_inverse=True)
                n = np.bincount(inv, np.fromiter(c.values(), float, len(c))[token], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    got = sample.where(~F.col("aside") | every).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    names, gram, n = got.column("lang").to_numpy(), got.column("gram").to_numpy(), got.column("n").to_numpy()
    counts = {}
    for name in set(names):
        here = names == name
        counts[name] = gram[here].astype(np.int64).view(np.uint64), n[here]
    if not counts:
        return Models()
    models = kneser_ney(counts)
    told = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    @lean
    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(told.value)
        at = {name: i for i, name in enumerate(told.value.langs)}
        for b in text_blocks(batches, 1):
            lp, chars = tokens.score(b.column(1).to_pylist())
            i = np.array([at.get(x, -1) for x in b.column(0).to_pylist()])
            ok = np.flatnonzero((chars > 0) & (i >= 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(-lp[ok, i[ok]] / chars[ok])], ["lang", "h"])

    limits = sample.where(F.col("aside") | every).select("lang", "text").mapInArrow(entropies, "lang string, h double").groupBy("lang").agg(F.percentile_approx("h", quantile, 10_000).alias("q")).collect()
    models.limits = {r.lang: r.q + margin for r in limits}
    done_with(told, sample)
    return models


def identify(docs: DataFrame, models: Models, text: str = "text", most: int = 64) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy (nats a character), rejected.

    lang_pred is the language of lowest cross-entropy over the whole text (ties: first by
    name), ``und`` if the text is null or has no letter or no model was learned. score is
    the posterior over the languages, tempered to at most ``most`` characters. rejected:
    ``und``, or a cross-entropy over the language's limit plus 20 nats over the number of
    predicted characters (short texts vary more). Columns of docs with the new
    names are replaced; other columns and repeated rows pass through.
    """
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    keep = [c for c in docs.columns if c.lower() not in new]
    told = docs.sparkSession.sparkContext.broadcast(models)
    at = keep.index(text)

    @lean
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        tokens = _Tokens(m) if m.langs else None
        limit = np.array([m.limits.get(x, np.inf) for x in m.langs])
        for b in text_blocks(batches, at):
            n = b.num_rows
            if tokens is None:
                pred, score, h, gone = [UNKNOWN] * n, np.zeros(n), [None] * n, np.ones(n, bool)
            else:
                lp, chars = tokens.score(b.column(at).to_pylist())
                some = chars > 0
                each = lp / np.maximum(chars, 1)[:, None]
                best = np.argmax(each, axis=1)
                z = (each - each.max(axis=1, keepdims=True)) * np.minimum(chars, most)[:, None]
                score = np.where(some, 1 / np.exp(z).sum(axis=1), 0.0)
                ent = -each[np.arange(n), best]
                gone = ~some | (ent > limit[best] + 20.0 / np.maximum(chars, 1))
                pred = [m.langs[i] if s else UNKNOWN for i, s in zip(best.tolist(), some.tolist(), strict=True)]
                h = pa.array(ent, mask=~some)
            cols = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), h if isinstance(h, pa.Array) else pa.array(h, pa.float64()), pa.array(gone)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*keep, *new])

    kinds = [f"{q} {docs.schema[c].dataType.simpleString()}" for c, q in zip(keep, quoted(keep), strict=True)]
    return docs.select(*quoted(keep)).mapInArrow(f, ", ".join([*kinds, "lang_pred string, score double, cross_entropy double, rejected boolean"]))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text (null: empty) modulo divisor."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor
