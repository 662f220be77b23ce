"""Ranked retrieval: legs, fusion, boosts and diversification.

Legs are lazy plans with an explicit rank; each leg is cut to its top rows before it meets another, so everything
after the legs works on a few hundred rows whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X


def leg(df: DataFrame, score: Column, k: int, name: str, key: str = "id", digits: int = 6) -> DataFrame:
    """(leg, id, rank, score): the k best rows by score, then id; rows without a score are out.  The bounded top is found
    without a full sort, and the score is computed once a row: nulls come last and are left out after the cut."""
    best = df.select(F.col(key).alias("id"), F.round(score, digits).alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(k).where("score IS NOT NULL")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return best.select(F.lit(name).alias("leg"), "id", rank.alias("rank"), "score")


def text_leg(df: DataFrame, query: str, terms: list[str], k: int, threshold: float = 0.3, name: str = "text", content: str = "content") -> DataFrame:
    """Rows that match a term or resemble the query; 0.7 of lexical rank and similarity, 0.3 of importance."""
    c = F.col(content)

    def score(sim: Column) -> Column:
        return F.when(X.matches_any(c, terms) | (sim > threshold), (X.rank_any(c, terms) + sim) * 0.7 + F.col("importance") * 0.3)

    return leg(df, X.let(X.trigram_similarity(c, query), score), k, name)


def cover_leg(df: DataFrame, terms: list[str], k: int, name: str = "lexical", content: str = "content") -> DataFrame:
    c = F.col(content)
    density = X.let(X.cover_density(c, terms), lambda found: F.when(found > 0, found))
    return leg(df, density, k, name)


def vector_leg(df: DataFrame, cosine: Column, k: int, name: str = "vector") -> DataFrame:
    return leg(df, cosine, k, name)


def fuse(legs: list[tuple[DataFrame, float | Column]], key: str = "id", digits: int = 8) -> DataFrame:
    """Weighted reciprocal-rank fusion: (id, score)."""
    parts = [df.select(key, S.rrf(F.col("rank") - 1, w).alias("part")) for df, w in legs]
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.round(F.sum("part"), digits).alias("score"))


def append_absent(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of ``second`` whose id isn't in ``first``, after the last rank of ``first``."""
    last = first.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last"))
    new = second.join(first.select("id"), "id", "left_anti").crossJoin(F.broadcast(last))
    put = new.select("leg", "id", (F.col("last") + F.row_number().over(Window.orderBy("rank"))).alias("rank"), "score")
    return first.select("leg", "id", "rank", "score").union(put)


def session_boost(results: DataFrame, goals: DataFrame, names: str = "entity", content: str = "content") -> DataFrame:
    """x 1.3 where a goal mentions the entity; else x (1 + 0.3 * share of the first goal's words that the content has),
    over the first goal that shares a word.  ``goals`` has place and goal; ``results`` is a cut list and is broadcast."""
    tokens = lambda c: F.array_distinct(F.filter(X.tokens(c), lambda w: F.octet_length(w) > 1))
    g = goals.select("place", X.normalize_mention(F.col("goal")).alias("said"), tokens(F.col("goal")).alias("g"))
    r = results.select("*", X.normalize_mention(F.col(names)).alias("__n"), tokens(F.col(content)).alias("__t"))
    j = g.crossJoin(F.broadcast(r))
    share = F.size(F.array_intersect("__t", "g")) / F.greatest(F.size("g"), F.lit(1))
    named = (F.length("__n") >= 4) & F.contains(F.col("said"), F.col("__n"))
    per = j.groupBy("id").agg(F.max(named).alias("named"), F.min_by(share, F.when(share > 0, F.col("place"))).alias("share"))
    factor = F.when(F.col("named"), 1.3).otherwise(1 + 0.3 * F.coalesce("share", F.lit(0.0)))
    return results.join(per.select("id", factor.alias("factor")), "id", "left").withColumn("boosted", F.col("score") * F.coalesce("factor", F.lit(1.0)))


def _tokens(text: str | None, more_than: int = 0) -> frozenset[str]:
    import regex

    return frozenset(w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if len(w.encode()) > more_than)


def greedy_dedup(ranked: DataFrame, group: str, threshold: float = 0.85, content: str = "content") -> DataFrame:
    """Within each group, in rank order, a row goes if its overlap with a kept row is above the threshold.

    Sequential by nature: meant for cut result lists, one group a task."""

    def keep(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank")
        kept: list[frozenset] = []
        out = []
        for t in map(_tokens, p[content]):
            dup = any(t and k and len(t & k) / min(len(t), len(k)) > threshold for k in kept)
            out.append(not dup)
            if not dup:
                kept.append(t)
        return p[out]

    return ranked.groupBy(group).applyInPandas(keep, ranked.schema)


def diversify(ranked: DataFrame, group: str, k: int, weight: float = 0.7, content: str = "content") -> DataFrame:
    """Maximal marginal relevance within each group: (group, id, place).

    A candidate's gain is weight * score - (1 - weight) * its largest Jaccard similarity to a chosen row; of equal
    gains the one that stands first in the remaining list wins, where a chosen row's place is taken by the last."""

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank")
        ids, score = p["id"].tolist(), p["score"].tolist()
        words = [_tokens(t, 2) for t in p[content]]
        left, nearest, picked = list(range(len(ids))), [None] * len(ids), []
        while left and len(picked) < k:
            at = max(range(len(left)), key=lambda i: (weight * score[left[i]] - (1 - weight) * (nearest[left[i]] or 0.0), -i))
            row, last = left[at], left.pop()
            if at < len(left):
                left[at] = last
            picked.append(row)
            for i in left:
                union = len(words[i] | words[row])
                near = len(words[i] & words[row]) / union if union else 0.0
                nearest[i] = near if nearest[i] is None else max(near, nearest[i])
        return pd.DataFrame({group: p[group].iloc[:1].tolist() * len(picked), "id": [ids[i] for i in picked], "place": range(1, len(picked) + 1)})

    g, i = ranked.schema[group].dataType.simpleString(), ranked.schema["id"].dataType.simpleString()
    return ranked.groupBy(group).applyInPandas(choose, f"{group} {g}, id {i}, place int")


#: Rows of one side that one task compares.
BLOCK_ROWS = 1024


def cosine_band(rows: DataFrame, group: str, low: float, high: float, others: DataFrame | None = None, best: int | None = None,
                each: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    """(group, a, b, cosine): pairs of one group whose cosine, to six digits, lies in the closed band: rows a < b of ``rows``,
    or a of ``rows`` and b of ``others``.  With ``best``, the first of each group, or of ``each`` a, by cosine, then a and b.

    Both have id, the group and v.  A group is dealt to blocks of about ``block`` rows, and blocks meet two by two as
    matrices, so no group is held whole and pairs outside the band, or beyond the best of two blocks, leave no task.
    Vectors that are null or hold a null, null groups, and pairs of different length take no part; ``low`` must be
    positive, as a vector of norm 0 has cosine 0."""
    if low <= 0:
        raise ValueError("low must be positive")

    def held(df: DataFrame) -> DataFrame:
        v = F.col("v").cast("array<double>")
        own = df.select(F.col(group).alias("grp"), F.size("v").alias("width"), "id", v.alias("v"))
        return own.where(F.col("grp").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    def counted(df: DataFrame, into: str) -> DataFrame:
        return df.groupBy("grp", "width").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(into))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left, keys = held(rows), ["grp", "width"]
    if others is None:
        own = dealt(left.join(counted(left, "n"), keys), "n", "n")
        met = own.select(*keys, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "v")
    else:
        right = held(others)
        sizes = counted(left, "n").join(counted(right, "m"), keys)
        first = dealt(left.join(sizes, keys), "n", "m").select(*keys, F.col("own").alias("x"), F.col("other").alias("y"), F.lit(0).alias("side"), "id", "v")
        second = dealt(right.join(sizes, keys), "m", "n").select(*keys, F.col("other").alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"), "id", "v")
        met = first.union(second)
    alone = others is None

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        ids, side, width = t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("width")[0].as_py()
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(len(ids), width)
        same = alone and t.column("x")[0].as_py() == t.column("y")[0].as_py()
        i, j = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(1))
            c = (v[i] @ v[j].T) / (norm[i][:, None] * norm[j][None, :])
            c = np.floor(c * 1e6 + 0.5) / 1e6
            in_band = (c >= low) & (c <= high)
        if same:
            in_band &= i[:, None] < j[None, :]
        p, q = np.nonzero(in_band)
        a, b, c = ids[i[p]], ids[j[q]], c[p, q]
        if alone:
            a, b = np.minimum(a, b), np.maximum(a, b)
        if best is not None:
            order = np.lexsort((b, -c, a) if each else (b, a, -c))
            a, b, c = a[order], b[order], c[order]
            place = np.arange(len(a)) - (np.searchsorted(a, a) if each else 0)
            a, b, c = a[place < best], b[place < best], c[place < best]
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(a), t.schema.field("grp").type), "a": a, "b": b, "cosine": c})

    g, k = rows.schema[group].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    found = met.groupBy(*keys, "x", "y").applyInArrow(compare, f"grp {g}, a {k}, b {k}, cosine double")
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("grp", *(["a"] if each else [])).orderBy(F.desc("cosine"), "a", "b"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= best).drop("rank")
    return found.withColumnRenamed("grp", group)


def rerank(ranked: DataFrame, scorer=None, top: int = 50) -> DataFrame:
    """Reorders the first ``top`` rows by a scorer of (content) batches; without one the order stays, and a column says so."""
    if scorer is None:
        return ranked.withColumn("reranker", F.lit("identity"))
    score = F.when(F.col("rank") <= top, scorer(F.col("content")))
    order = Window.orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return ranked.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order)).withColumn("reranker", F.lit("scorer"))
