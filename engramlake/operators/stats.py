"""Distributions, calibration, drift and retrieval-quality statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.operators.ordering import prefix_sums


def ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, first): how often each value occurs and the 1-based rank of its first occurrence in ascending order."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(per, [F.asc(value)], "n", "first").withColumn("first", F.col("first") + 1)


def at_rank(df: DataFrame, value: str, wanted: list[tuple[str, Column]]) -> DataFrame:
    """One row with the values at 1-based ranks, which are expressions over the total ``total``.

    Sorting is done on distinct values with their counts, so ties and hot values cost one row."""
    r = ranks(df, value)
    total = r.agg(F.sum("n").alias("total"))
    r = r.crossJoin(F.broadcast(total))
    inside = lambda k: (F.col("first") <= k) & (k < F.col("first") + F.col("n"))
    return r.agg(*(F.max(F.when(inside(k), F.col(value))).alias(name) for name, k in wanted))


def nearest_rank(q: float) -> Column:
    return F.round((F.col("total") - 1) * q).cast("long") + 1


def conformal_rank(alpha: float) -> Column:
    return F.least(F.greatest(F.ceil((F.col("total") + 1) * (1 - alpha)), F.lit(1)), F.col("total"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    picks = at_rank(df, value, [("p50", nearest_rank(0.5)), ("p90", nearest_rank(0.9)), ("p95", nearest_rank(0.95)), ("p99", nearest_rank(0.99))])
    ends = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return ends.crossJoin(picks)


def entropy(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Shannon entropy in bits and number of categories from counts."""
    by = by or []
    total = counts.groupBy(*by).agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * F.log2(n)).alias("s"))
    return total.select(*by, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"), "k")


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per bin: count, mean confidence, accuracy."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error."""
    y = F.col(correct).cast("double")
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(y).alias("a"), F.sum(F.pow(F.col(confidence) - y, F.lit(2))).alias("e"))
    return per.agg((F.sum("e") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def drift(recent: DataFrame, history: DataFrame, category: str, weeks: float = 4.0) -> DataFrame:
    """Chi-square of recent counts against past counts per week, over categories that occur in both."""
    a = recent.groupBy(category).agg(F.count(F.lit(1)).alias("o"))
    b = history.groupBy(category).agg((F.count(F.lit(1)) / weeks).alias("e"))
    chi = a.join(b, category).agg(F.coalesce(F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")), F.lit(0.0)).alias("chi2"), F.count(F.lit(1)).alias("categories"))
    chi = chi.withColumn("df", F.greatest(F.col("categories") - 1, F.lit(1)))
    return chi.withColumn("p", S.chi2_survival(F.col("chi2"), F.col("df").cast("double")))


def discounted(rank: str) -> Column:
    """Gain of a relevant row: 1 at ranks 1 and 2, then 1 / log2(rank)."""
    return F.when(F.col(rank) <= 2, 1.0).otherwise(1 / F.log2(F.col(rank).cast("double")))


def ranking_quality(ranked: DataFrame, query: str, rank: str, relevant: str, total: str, k: int = 10) -> DataFrame:
    """nDCG, precision, recall at k and reciprocal rank per query; ``total`` is the number of relevant rows."""
    inside = F.col(rank) <= k
    hit = F.col(relevant).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + F.when(i <= 2, 1.0).otherwise(1 / F.log2(i.cast("double"))))
    per = ranked.groupBy(query).agg(
        F.sum(F.when(inside, hit * discounted(rank)).otherwise(0.0)).alias("dcg"), F.sum(F.when(inside, hit).otherwise(0)).alias("hits"),
        F.count_if(inside).alias("shown"), F.min(F.when(hit == 1, F.col(rank))).alias("first"), F.max(total).alias("total"))
    none = F.col("total") == 0
    return per.select(
        query, F.when(none, 0.0).otherwise(F.least(F.lit(1.0), F.col("dcg") / F.when(none, 1.0).otherwise(ideal))).alias("ndcg"),
        F.when(F.col("shown") == 0, 0.0).otherwise(F.col("hits") / F.col("shown")).alias("precision"),
        F.when(none, 0.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.col("total"))).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def minimum_detectable_effect(df: DataFrame, value: str, paired: bool = False) -> DataFrame:
    n = F.count(value)
    return df.agg((2.80 * F.stddev_samp(value) * (F.sqrt(1.0 / n) if paired else F.sqrt(2.0 / n))).alias("mde"))


# Multiplier, increment and seed of the congruential generator that resampling uses.
_LCG, _STEP, _SEED = 6_364_136_223_846_793_005, 1_442_695_040_888_963_407, 0x2545_F491_4F6C_DD1D


def bootstrap_interval(scores: list[float], iterations: int = 2000, confidence: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) by resampling; the scores are one number per evaluated query, on the driver."""
    n = len(scores)
    if not n:
        return 0.0, 0.0, 0.0
    values = np.asarray(scores, float)
    if n == 1:
        return (float(values[0]),) * 3
    state, mask = _SEED, (1 << 64) - 1
    picks = np.empty(iterations * n, np.int64)
    for i in range(len(picks)):
        state = (state * _LCG + _STEP) & mask
        picks[i] = (state >> 33) % n
    means = np.sort(values[picks.reshape(iterations, n)].sum(1) / n)
    tail = (1 - confidence) / 2
    return float(values.mean()), float(means[min(int(tail * iterations), iterations - 1)]), float(means[min(int((1 - tail) * iterations), iterations - 1)])


class OutlierModel:
    """Mean and inverse of a shrunk covariance; distances are Mahalanobis'."""

    def __init__(self, mean: np.ndarray, inverse: np.ndarray, n: int, shrinkage: float):
        self.mean, self.inverse, self.n, self.shrinkage = mean, inverse, n, shrinkage


def fit_outliers(vectors: DataFrame, column: str, least: int = 50) -> OutlierModel | None:
    """Moments in two passes of partial sums, d * d numbers to the driver whatever the rows; then shrinkage towards a
    multiple of the identity by the samples' own spread, and a ridge."""
    v = vectors.select(F.col(column).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    first = v.select(F.size("v").alias("d")).limit(1).collect()
    if not first:
        return None
    d = first[0].d

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for p in parts:
            x = np.stack(p["v"].to_numpy()) if len(p) else np.zeros((0, d))
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"i": np.arange(1 + d + d * d), "x": np.concatenate([[n], s, q.reshape(-1)])})

    rows = v.mapInPandas(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + d + d * d)
    for r in rows:
        flat[r.i] = r.x
    n = int(flat[0])
    if n < max(2, least):
        return None
    mean = flat[1 : 1 + d] / n
    cov = (flat[1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)
    centre = F.array(*(F.lit(float(m)) for m in mean))
    length = F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    fourth = v.agg(F.sum(length * length).alias("s")).first().s
    mu = np.trace(cov) / d
    away = ((cov - mu * np.eye(d)) ** 2).sum() / d
    spread = (fourth - 2 * (n - 1) * (cov**2).sum() + n * (cov**2).sum()) / d / n**2
    share = float(np.clip(min(spread, away) / away, 0, 1)) if away > np.finfo(float).eps else 0.0
    cov = share * mu * np.eye(d) + (1 - share) * cov + max(mu * 1e-6, np.finfo(float).tiny) * np.eye(d)
    return OutlierModel(mean, np.linalg.inv(cov), n, share)


def outlier_distance(model: OutlierModel):
    mean, inverse = model.mean, model.inverse

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            x = np.stack(s.to_numpy()).astype(float) - mean
            yield pd.Series(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x), 0)))

    return run


def outlier_threshold(dims: int, z: float = 2.3263479) -> float:
    """Root of the 99 % quantile of chi-square, by the cube approximation."""
    a = 2 / (9 * dims)
    return max(dims * (1 - a + z * a**0.5) ** 3, 0) ** 0.5 if dims else 0.0
