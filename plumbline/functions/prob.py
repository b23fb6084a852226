"""Probabilities over arrays: softmax, rounding to a sum of exactly 1, confidence, blending. Column expressions.

Ties go to the first index everywhere. Null arrays give null; an empty array has no distribution and stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMALS = 4
TINY = 1e-9


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax(xs: Column, temperature=1.0) -> Column:
    t = F.greatest(F.lit(TINY), temperature if isinstance(temperature, Column) else F.lit(float(temperature)))
    top = F.array_max(xs)
    powers = F.transform(xs, lambda x: F.exp((x - top) / t))
    return F.transform(powers, lambda e: e / total(powers))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    clipped = F.least(F.lit(1 - TINY), F.greatest(F.lit(TINY), p))
    return F.log(clipped / (1 - clipped))


def first_top(xs: Column) -> Column:
    """The first index, from 0, of the largest entry."""
    return F.array_position(xs, F.array_max(xs)).cast("int") - 1


def _replaced(xs: Column, at: Column, value) -> Column:
    return F.transform(xs, lambda x, i: F.when(i == at, value(x)).otherwise(x))


def rounded(probs: Column) -> Column:
    """Rounded to DECIMALS; what is missing to 1 goes to the largest entry, so the decimal sum is 1."""
    k = first_top(probs)
    r = F.transform(probs, lambda p: F.round(p, DECIMALS))
    r = _replaced(r, k, lambda x: F.round(x + (1.0 - total(r)), DECIMALS))
    r = F.transform(r, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    again = _replaced(r, k, lambda x: F.round(1.0 - (total(r) - x), DECIMALS))
    return F.when(F.abs(total(r) - 1.0) > TINY, again).otherwise(r)


def confidence(probs: Column) -> Column:
    """1 - entropy / ln K, at least 0; 1 for a single entry."""
    h = F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.when(F.size(probs) <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.round(1.0 - h / F.log(F.size(probs).cast("double")), DECIMALS)))


def expectation(probs: Column) -> Column:
    """The mean index."""
    return total(F.transform(probs, lambda p, i: p * i))


def blend(head: Column, verbal: Column, weight: float, tau: float, bias: float = 0.0) -> Column:
    """weight * head + (1 - weight) * (verbal + bias) / tau, entry by entry."""
    return F.zip_with(head, verbal, lambda h, v: h * weight + (v + bias) / tau * (1.0 - weight))


def mean_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def distance_tv(a: Column, b: Column) -> Column:
    """Half the sum of absolute differences."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2


def brier_multi(probs: Column, gold: Column) -> Column:
    return total(F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))))


def group_ce(scores: Column, targets: Column) -> Column:
    """Cross entropy of targets against the softmax of scores, over the number of entries."""
    top = F.array_max(scores)
    norm = top + F.log(total(F.transform(scores, lambda s: F.exp(s - top))))
    return -total(F.zip_with(scores, targets, lambda s, t: t * (s - norm))) / F.size(scores)


def bce_with_logits(z: Column, target: Column) -> Column:
    """The stable form of binary cross entropy."""
    return F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Terms of the series of erf; beyond ERF_FROM it is 1 to all digits that count.
ERF_TERMS, ERF_FROM = 60, 4.5


def erf_coefficients() -> list[float]:
    """2^n / (1 3 5 ... (2 n + 1)): erf x = 2 / sqrt(pi) exp(-x^2) times the sum of these by x^(2 n + 1), all positive."""
    out = [1.0]
    for n in range(1, ERF_TERMS):
        out.append(out[-1] * 2 / (2 * n + 1))
    return out


def erf(x: Column) -> Column:
    """The error function to some 1e-12, from built-ins only."""
    t, total_ = x * x, F.lit(0.0)
    for c in reversed(erf_coefficients()):
        total_ = total_ * t + c
    inner = F.exp(-t) * x * total_ * (2 / math.sqrt(math.pi))
    return F.when(F.abs(x) < ERF_FROM, inner).otherwise(F.signum(x))


def gelu(x: Column) -> Column:
    """The exact form, x times the normal distribution function."""
    return x * 0.5 * (erf(x / math.sqrt(2)) + 1.0)


def mlp(x: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    """Linear, exact GELU, linear: a small head over a stored embedding; weights are literals."""
    sums = F.array(*[dot(x, F.array(*map(F.lit, row))) + b for row, b in zip(w1, b1)])
    return dot(F.transform(sums, gelu), F.array(*map(F.lit, w2))) + b2


def scores_from(probs: Column, yes_no: Column) -> Column:
    """Scores that give back probabilities: of yes against no as one log ratio (first entry: no, second: yes), else their logarithms."""
    low = lambda p: F.log(F.greatest(p, F.lit(TINY)))
    yes = F.get(probs, F.lit(1))
    return F.when(yes_no, F.array(low(yes) - low(1 - yes))).otherwise(F.transform(probs, low))


def polarity(logits: Column, positive: list[int], negative: list[int]) -> Column:
    """Whether the entries for one polarity have more probability together than those for the other."""
    top = F.array_max(logits)
    mass = lambda ids: sum((F.exp(F.get(logits, F.lit(i)) - top) for i in ids), F.lit(0.0))
    return mass(positive) > mass(negative)


def restricted(logits: Column, ids: list[int]) -> Column:
    """The softmax over some entries only."""
    return softmax(F.array(*[F.get(logits, F.lit(i)) for i in ids]))
