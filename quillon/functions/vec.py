"""Probability vectors as array columns: every function is a Column expression, so rows stay where they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def relative_l2(a, b) -> Column:
    """|a - b| / max(|b|, eps)."""
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))) / F.greatest(norm(b), F.lit(EPS))


def _share(a: Column) -> Column:
    return let(_sum(a), lambda s: F.transform(a, lambda x: x / s))


def normalise(a) -> Column:
    """Divided by the sum where that is over 0; as it is elsewhere."""
    return let(_c(a), lambda v: F.when(_sum(v) > 0, _share(v)).otherwise(v))


def softmax(z, temperature: float | Column = 1.0) -> Column:
    raised = lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp((x - m) / temperature)))
    return let(_c(z), lambda v: let(raised(v), _share))


def argmax(p) -> Column:
    """Place of the largest, from 0; the first on ties."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


def one_hot(k: int | Column, i) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(j == _c(i), 1.0).otherwise(0.0))


def clip(x: Column, lo: float = EPS, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def nll(p, t) -> Column:
    """Cross-entropy of soft targets, p clipped to [1e-12, 1]."""
    return _sum(F.zip_with(_c(p), _c(t), lambda x, y: -y * F.log(clip(x))))


soft_ce = nll


def brier(p, t) -> Column:
    return _sum(F.zip_with(_c(p), _c(t), lambda x, y: (x - y) * (x - y)))


def entropy(p) -> Column:
    return _sum(F.transform(_c(p), lambda x: -x * F.log(clip(x))))


def kl(gold, p) -> Column:
    return _sum(F.zip_with(_c(gold), _c(p), lambda g, x: clip(g) * (F.log(clip(g)) - F.log(clip(x)))))


def forward_kl(t, p) -> Column:
    """Soft cross-entropy less the target's entropy."""
    return nll(p, t) - entropy(t)


def total_variation(a, b) -> Column:
    return 0.5 * _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def cumulative(p) -> Column:
    p = _c(p)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: _sum(F.slice(p, F.lit(1), n)))


def crps(p, t) -> Column:
    """Ordinal: sum of squared differences of the distribution functions."""
    return brier(cumulative(p), cumulative(t))


def expected_level(p) -> Column:
    return F.aggregate(F.transform(_c(p), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def choice_confidence(p) -> Column:
    k = F.size(_c(p))
    return F.greatest(F.lit(0.0), (F.array_max(_c(p)) - 1.0 / k) / (1.0 - 1.0 / k))


def score_confidence(p) -> Column:
    """1 less the mean distance from the mode over that of a uniform answer, not below 0."""
    p = _c(p)
    m, k = argmax(p), F.size(p)
    spread = _sum(F.transform(p, lambda x, i: x * F.abs(i - m)))
    even = _sum(F.transform(p, lambda x, i: F.abs(i - m).cast("double"))) / k
    return F.greatest(F.lit(0.0), 1.0 - spread / F.greatest(even, F.lit(EPS)))


def temper(p, temperature: float | Column, keep_zeros: bool = True) -> Column:
    """p to the power 1 / T, made to sum to 1; zeros stay zeros if asked."""
    p = _c(p)
    raised = F.transform(p, lambda x: (F.when(x > 0, F.pow(clip(x), 1.0 / temperature)).otherwise(0.0) if keep_zeros else F.pow(clip(x), 1.0 / temperature)))
    return let(raised, _share)


def ordinal_soft_target(x, k: int) -> Column:
    """Mass on the two levels beside x (clamped to 0..1, spread over k levels)."""
    at = F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0)) * (k - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(F.lit(0.0), 1.0 - F.abs(at - i)))


def teacher_target(k: int | Column, i, p) -> Column:
    """p clamped to [1/k, 1] on i, the rest spread evenly."""
    k = F.lit(k) if isinstance(k, int) else k
    top = F.least(F.greatest(_c(p), 1.0 / k), F.lit(1.0))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(j == _c(i), top).otherwise((1.0 - top) / (k - 1)))


def align(scores: Column, order: Column) -> Column:
    """Values of a map in a label order, 0 where missing, made to sum to 1."""
    return normalise(F.transform(order, lambda k: F.coalesce(F.element_at(scores, k), F.lit(0.0))))


def calibration_pair(p, t, boolean: Column | bool = False) -> tuple[Column, Column]:
    """(confidence, outcome): boolean questions give the true side, others the top answer and its target mass."""
    p, t = _c(p), _c(t)
    b = F.lit(boolean) if isinstance(boolean, bool) else boolean
    return F.when(b, p[1]).otherwise(F.array_max(p)), F.when(b, t[1]).otherwise(F.element_at(t, argmax(p) + 1))
