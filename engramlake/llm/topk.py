"""Operator 5: exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.llm.common import materialize, shard_count, table

K = 5
EVERY = 50
SCALE = 256
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 256
DIMS_PER_STEP = 8
#: Share of pairs below which queries go on one by one.
SPARSE = 0.3
#: Groups of candidate blocks; each is sent all queries.
MAX_GROUPS = 1024
#: Query blocks whose k-th scores a task carries on.
HELD_SEARCHES = 512
#: Components beyond this don't fit the integers.
MAX_SCALED = 2.0**62


def exact_type(a: np.ndarray, b: np.ndarray, dims: int):
    """The fastest type in which every partial sum of products of these integers is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, dims)
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


class Search:
    """Branch and bound of one block of queries over candidate blocks, which hold their vectors dimension by dimension.

    ``floor`` has each query's k-th score so far and is carried from block to block.  Dimensions go by falling energy.
    After each run of them the remaining mass of a candidate and a query bounds by Cauchy-Schwarz what the rest can
    add; a pair stays if its upper bound reaches the k-th score so far, or the k-th largest lower bound in the
    block.  Once ``SPARSE`` of the pairs or fewer stay, each query goes on with its own compacted candidates.
    ``work`` counts products (``done`` of ``all``)."""

    def __init__(self, queries: np.ndarray, k: int, step: int = DIMS_PER_STEP):
        self.queries, self.k, self.step = queries, k, step
        self.held: list[np.ndarray] = [np.empty(0)] * len(queries)  # the k highest scores so far
        self.floor = np.full(len(queries), -np.inf)
        self.work = {"done": 0, "all": 0}

    def block(self, columns: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (columns, scores), with all that can be among its k best; ``own`` is its column here or -1."""
        dims, n = columns.shape
        energy = np.argsort(-((columns.astype(float) ** 2).sum(1) * (self.queries.astype(float) ** 2).sum(0)), kind="stable")
        kind = exact_type(self.queries, columns, dims)
        q, c = self.queries[:, energy].astype(kind), columns[energy].astype(kind)
        mass_q = np.sqrt(np.cumsum(q[:, ::-1].astype(float) ** 2, axis=1)[:, ::-1])
        mass_c = np.sqrt(np.cumsum(c[::-1].astype(float) ** 2, axis=0)[::-1])
        scores = np.zeros((len(q), n), kind)
        stay = np.ones((len(q), n), bool)
        stay[np.flatnonzero(own >= 0), own[own >= 0]] = False
        self.work["all"] += int(stay.sum()) * dims
        at = 0
        while at < dims:
            to = min(at + self.step, dims)
            scores = scores + q[:, at:to] @ c[at:to]
            self.work["done"] += int(stay.sum()) * (to - at)
            at = to
            if at < dims and n > 2 * self.k and self._bound(scores, stay, mass_q, mass_c, at, slice(0, len(q), max(1, len(q) // 8))).mean() <= SPARSE:
                stay = self._bound(scores, stay, mass_q, mass_c, at, slice(None))
                if stay.mean() <= SPARSE:
                    break
        out = []
        for i in range(len(q)):
            idx = np.flatnonzero(stay[i])
            s = scores[i, idx]
            for a in range(at, dims, self.step):
                b = min(a + self.step, dims)
                s = s + q[i, a:b] @ c[a:b, idx]
                self.work["done"] += len(idx) * (b - a)
                if b < dims and len(idx) > self.k:
                    near = s.astype(float) + self._room(mass_q[i, b], mass_c[b, idx]) >= self.floor[i]
                    idx, s = idx[near], s[near]
            out.append((idx, s))
            top = np.concatenate([self.held[i], s.astype(float)])
            if len(top) > self.k:
                top = np.partition(top, len(top) - self.k)[-self.k :]
            self.held[i] = top
            if len(top) == self.k:
                self.floor[i] = top.min()
        return out

    @staticmethod
    def _room(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return q * c * (1 + 1e-9) + 1e-6

    def _bound(self, scores: np.ndarray, stay: np.ndarray, mass_q: np.ndarray, mass_c: np.ndarray, at: int, rows: slice) -> np.ndarray:
        near = scores[rows].astype(float)
        room = self._room(mass_q[rows, at][:, None], mass_c[at][None, :])
        low = np.where(stay[rows], near - room, -np.inf)  # a query's own row must not raise its bound
        kth = np.partition(low, low.shape[1] - self.k, axis=1)[:, -self.k]
        return stay[rows] & (near + room >= np.maximum(kth, self.floor[rows])[:, None])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    order = sorted(near, key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k], np.int64)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products over floor(scale * x): query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own.  Rows with
    a null id or vector, or with null or non-finite components, take no part; vectors meet those of their own
    length only; a component beyond 2^62 / ``scale`` is an error.  Ties go to the smaller id; a repeated row is a candidate of its twin.  With fewer candidates
    all are returned; no rows give no rows.

    Rows are packed into blocks in vertical layout, queries into blocks of their own; every query block meets
    every candidate block once, as an equi-join over the candidate blocks' groups.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()).where(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        held: dict[int, list] = {}

        def blob(a: np.ndarray) -> bytes:
            small = np.abs(a).max(initial=0) < 2**15
            return (b"s" if small else b"l") + np.ascontiguousarray(a, np.int16 if small else np.int64).tobytes()

        def out(dims: int, rows: list):
            nonlocal block
            ids = np.array([r[0] for r in rows], np.int64)
            m = np.array([r[1] for r in rows], np.int64).reshape(len(rows), dims)
            found = [(0, block, dims, np.arange(len(ids)), ids, np.ascontiguousarray(m.T))]
            ask = np.flatnonzero(ids % every == 0)
            for i in range(0, len(ask), QUERIES_PER_BLOCK):
                part = ask[i : i + QUERIES_PER_BLOCK]
                found.append((1, block, dims, part, ids[part], m[part]))
            block += 1
            kind, name, d, place, who, data = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(name, pa.int64()), pa.array(d, pa.int32()),
                 pa.array([x.astype(np.int64).tobytes() for x in place], pa.binary()),
                 pa.array([x.tobytes() for x in who], pa.binary()), pa.array([blob(x) for x in data], pa.binary())],
                names=["kind", "block", "dims", "place", "ids", "data"])

        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), batch.column(1)
            flat, offs = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
            scaled = np.floor(flat * scale)
            if len(scaled) and np.abs(scaled).max() >= MAX_SCALED:
                raise ValueError("a component is too large for an integer of 64 bits")
            scaled = scaled.astype(np.int64)
            for i, who in enumerate(ids):
                v = scaled[offs[i] : offs[i + 1]]
                rows = held.setdefault(len(v), [])
                rows.append((who, v))
                if len(rows) >= ROWS_PER_BLOCK:
                    yield out(len(v), held.pop(len(v)))
        for dims, rows in held.items():
            yield out(dims, rows)

    packed = materialize(source.mapInArrow(pack, "kind int, block long, dims int, place binary, ids binary, data binary"), "vectors")
    groups = min(shard_count(packed, 1 << 20, 12), MAX_GROUPS)
    cand = packed.where("kind = 0").select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), "dims", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    asks = packed.where("kind = 1").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "dims", "block", "place", "ids", "data")
    pairs = cand.join(asks, ["g", "dims"])

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.int16 if raw[:1] == b"s" else np.int64, offset=1).astype(np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}  # by query block: a task has the blocks of a few groups
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, who = np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                place = np.frombuffer(r["place"], np.int64)
                own = place if r["block"] == r["c_block"] else np.full(len(who), -1)
                name = (r["block"], int(place[0]))
                if name not in searches:
                    if len(searches) >= HELD_SEARCHES:
                        searches.clear()
                    searches[name] = Search(read(r["data"]).reshape(len(who), r["dims"]), k)
                q, row, v, s = [], [], [], []
                for i, (cols, scores) in enumerate(searches[name].block(read(r["c_data"]).reshape(r["dims"], len(ids)), own)):
                    at = best(ids[cols], scores, k)
                    q += [int(who[i])] * len(at)
                    row += [(r["block"] << 12) + int(place[i])] * len(at)
                    v += ids[cols[at]].tolist()
                    s += [int(x) for x in scores[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, row, v, s)], names=["query_id", "row", "vec_id", "score"])

    near = pairs.mapInArrow(meet, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= {K}"""
