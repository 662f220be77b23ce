"""Scores, gates and small statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarity gates, duplicate threshold, judge band, and boosts of the memory model.
GATE_REINFORCE, GATE_UPDATE = 0.92, 0.75
DUPLICATE = 0.85
JUDGE_BAND = (0.6, 0.8)
ACCESS_BOOST, THROTTLE = 0.01, 0.8
RRF_K = 60.0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def entropy_weights(entropy: Column) -> tuple[Column, Column]:
    """(text weight, vector weight): logistic in the query's entropy, middle 2.75, steepness 2."""
    t = 1 / (1 + F.exp(-2.0 * (entropy - 2.75)))
    return 0.7 - 0.4 * t, 0.3 + 0.4 * t


def rrf(rank0: Column, weight: Column | float = 1.0) -> Column:
    """Reciprocal-rank share of a row at 0-based ``rank0``."""
    return (F.lit(weight) if isinstance(weight, (int, float)) else weight) / (RRF_K + rank0 + 1)


def importance_prior(kind: Column, density: Column) -> Column:
    return (
        F.when(kind == "decision", 0.8).when(kind == "lesson", 0.75).when(kind.isin("error", "solution"), 0.7)
        .when(kind.isin("fact", "preference"), clamp(density * 0.6, 0.1, 0.9))
        .when(kind.isin("context", "tool_usage"), clamp(density * 0.4, 0.1, 0.7)).otherwise(clamp(density, 0.1, 0.8)))


def grounding_level(confidence: Column) -> Column:
    return F.when(confidence > 0.7, "verified").when(confidence > 0.5, "partial").when(confidence > 0.3, "weak").otherwise("unknown")


def grounding(top: Column, mean: Column, n: Column, sources: Column, total: Column | None = None) -> Column:
    """0.45 max + 0.25 mean + 0.20 coverage + 0.10 source diversity, at most 1."""
    ratio = F.lit(0.3) * n if total is None else F.lit(3.0) * n / total
    return F.least(F.lit(1.0), 0.45 * top + 0.25 * mean + 0.20 * F.least(F.lit(1.0), 1 - F.exp(-ratio)) + 0.10 * sources / F.greatest(n, F.lit(1)))


def judged_grounding(support: Column, contra: Column) -> tuple[Column, Column]:
    """(confidence, level) from the weights of supporting and contradicting evidence."""
    both = support + contra
    share = support / both
    strong = clamp(share * (1 - F.exp(-2.0 * support)), 0.0, 1.0)
    confidence = F.when(both <= 2.220446049250313e-16, 0.0).when(contra > support, clamp(share, 0.0, 1.0)).otherwise(strong)
    level = F.when(both <= 2.220446049250313e-16, "unknown").when(contra > support, "contradicted").otherwise(grounding_level(strong))
    return confidence, level


def nli_decision(entail: Column, neutral: Column, contra: Column) -> Column:
    """Floors 0.80, 0.60 and 0.50; neutral where nothing decides."""
    return (
        F.when((entail >= 0.80) & (entail > contra), "supports").when((contra >= 0.60) & (contra > entail), "contradicts").otherwise("neutral"))


def gate(similarity: Column, reinforce: Column | float = GATE_REINFORCE, update: Column | float = GATE_UPDATE) -> Column:
    return F.when(similarity >= reinforce, "reinforce").when(similarity >= update, "update").otherwise("create")


def contradiction(cosine: Column, negated: Column) -> Column:
    return clamp(cosine * F.when(negated, 1.5).otherwise(0.7), 0.0, 1.0)


def npmi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information; null if the pair is in every session."""
    p = ab / n
    return F.when(p < 1, F.log(p / ((a / n) * (b / n))) / -F.log(p))


def adamic_adar(degree: Column) -> Column:
    return 1 / F.log(2 + degree)


def saturate(score: Column) -> Column:
    """A predicted edge's strength."""
    return clamp(score / (score + 1), 0.01, 1.0)


def path_score(strengths: Column) -> Column:
    product = F.aggregate(strengths, F.lit(1.0), lambda a, s: a * F.least(F.lit(1.0), F.greatest(F.lit(0.01), s)))
    return product / (1 + F.size(strengths))


def memory_op(verdict: Column, confidence: Column, floor: float) -> Column:
    return F.when(confidence < floor, "noop").when(verdict.isin("supersedes", "contradicts"), "update").when(verdict.isin("complementary", "unrelated"), "add").otherwise("noop")


def newer(counter: Column, actor: Column, other_counter: Column, other_actor: Column) -> Column:
    """Which of two versions wins: the greater counter, then the greater actor."""
    return F.when((counter > other_counter) | ((counter == other_counter) & (actor >= other_actor)), "local").otherwise("incoming")


def concurrent(counter: Column, actor: Column, other_counter: Column, other_actor: Column) -> Column:
    return (counter == other_counter) & (actor != other_actor)


def wilson_lower(successes: Column, trials: Column, z: float = 1.96) -> Column:
    p = successes / trials
    low = (p + z * z / (2 * trials) - z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)
    return F.when(trials <= 0, 0.0).otherwise(clamp(low, 0.0, 1.0))


def beta_posterior(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Mean, variance and width (two standard deviations, at most 1)."""
    var = a * b / ((a + b) * (a + b) * (a + b + 1))
    return a / (a + b), var, F.least(F.lit(1.0), 2 * F.sqrt(var))


def chi2_survival(x: Column, df: Column) -> Column:
    """Wilson-Hilferty's normal approximation with a rational approximation of erfc."""
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.when(x <= 0, 1.0).otherwise(0.5 * erfc(z / math.sqrt(2)))


def erfc(x: Column) -> Column:
    # The published five-term approximation of the error function.
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    r = poly * F.exp(-x * x)
    return F.when(x >= 0, r).otherwise(2 - r)


def decay(importance: Column, days: Column, halflife: Column | float, access: Column) -> Column:
    """Exponential decay whose half-life grows with the logarithm of the access count; floor 0.01."""
    return F.greatest(F.lit(0.01), importance * F.exp(-0.693 * days / (halflife * (1 + F.log(1 + access)))))
