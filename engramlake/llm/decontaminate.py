"""Operator 8: benchmark decontamination by Wu-Manber search over word symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.lineage import discard
from engramlake.llm.common import alnum_words, materialize, slices, table
from engramlake.session import ship

WINDOW = 10
#: Words of benchmark items in one broadcast set of tables (by estimate 150 bytes of tables a word); larger benchmarks are
#: searched set by set.
MAX_PATTERN_WORDS = 400_000
_SEGMENT = 512
_HASH_BITS = 16


def _block_hash(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Block of two word symbols."""
    return ((a.astype(np.int64) * 0x9E3779B1 + np.asarray(b, np.int64) * 0x85EBCA6B) >> 7) & ((1 << _HASH_BITS) - 1)


class WuManber:
    """Patterns of one length ``m`` over word symbols.

    ``shift`` tells, for the block that ends at a position, how many positions no pattern can end at; where it is
    zero, the block's bucket holds the patterns to compare word by word."""

    def __init__(self, patterns: np.ndarray, owner: np.ndarray, first_owner: np.ndarray):
        """``owner[first_owner[p] : first_owner[p + 1]]`` are the items that hold pattern p."""
        self.patterns, self.owner, self.first_owner = patterns, owner, first_owner
        self.m = m = patterns.shape[1]
        self.block = min(2, m)
        size = 1 << _HASH_BITS
        self.shift = np.full(size, m - self.block + 1, np.int32)
        for end in range(self.block - 1, m):
            h = self._hash(patterns, end)
            np.minimum.at(self.shift, h, m - 1 - end)
        suffix = self._hash(patterns, m - 1)
        self.bucket = np.argsort(suffix, kind="stable")
        cuts = np.searchsorted(suffix[self.bucket], np.arange(size + 1))
        self.first, self.count = cuts[:-1], np.diff(cuts)

    def _hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        return _block_hash(rows[:, end], rows[:, end - 1] if self.block == 2 else 0)

    def search(self, text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence that lies within one document."""
        n, m = len(text), self.m
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(m - 1, n, _SEGMENT)
        stop = np.minimum(at + _SEGMENT, n)
        ends = []
        while len(at):  # one cursor for each segment; all cursors jump together
            step = self.shift[_block_hash(text[at], text[at - 1] if self.block == 2 else 0)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(ends)
        ends = ends[doc[ends] == doc[ends - m + 1]]
        h = _block_hash(text[ends], text[ends - 1] if self.block == 2 else 0)
        n_in = self.count[h]
        starts, found = [], []
        for k in range(int(n_in.max(initial=0))):  # the k-th pattern of every bucket
            has = n_in > k
            e, p = ends[has], self.bucket[self.first[h[has]] + k]
            for j in range(m):
                same = text[e - j] == self.patterns[p, m - 1 - j]
                e, p = e[same], p[same]
            starts.append(e - m + 1)
            found.append(p)
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.empty(0, np.int64),) * 2


class Matcher:
    """Wu-Manber tables for each window length over a shared vocabulary; symbol 0 is any other word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        index = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, words in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
            if len(ids):
                m = min(window, len(ids))
                by_length.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(ids, m), index[name]))
        self.tables = []
        for m, found in sorted(by_length.items()):
            rows = np.concatenate([w for w, _ in found])
            owner = np.repeat([i for _, i in found], [len(w) for w, _ in found])
            patterns, pattern = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([pattern.reshape(-1), owner], 1), axis=0)
            self.tables.append(WuManber(patterns, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1))))

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: number of words, merged spans of words inside occurrences, items that occur."""
        get = self.vocab.get
        parts = [np.fromiter((get(w, 0) for w in found), np.int64, len(found)) for found in map(alnum_words, texts)]
        lengths = np.array([len(p) for p in parts], np.int64)
        text = np.concatenate(parts) if parts else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(parts)), lengths)
        cover = np.zeros(len(text) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for t in self.tables:
            starts, patterns = t.search(text, doc)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + t.m, -1)
            pairs = np.unique(np.stack([doc[starts], patterns], 1), axis=0) if len(starts) else []
            for d, p in pairs:
                items.setdefault(int(d), set()).update(self.names[i] for i in t.owner[t.first_owner[p] : t.first_owner[p + 1]])
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        out = [(int(n), [], items.get(i, set())) for i, n in enumerate(lengths)]
        for d in items:
            a, b = begin[d], begin[d + 1]
            own = np.concatenate([[False], hit[a + 1 : b + 1], [False]]).astype(np.int8)
            edge = np.flatnonzero(np.diff(own))
            out[d][1].extend((int(x), int(y)) for x, y in zip(edge[::2], edge[1::2]))
        return out


def pattern_sets(benchmark: DataFrame, item_col: str, text_col: str, limit: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The words of the benchmark's items in sets of at most ``limit`` words.  Items come to the driver one by one and one
    set is held at a time; a longer item is cut into pieces that share ``window`` - 1 words."""
    held, size = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        words, name = alnum_words(row[1]), "" if row[0] is None else str(row[0])
        at = 0
        while at == 0 or at < len(words) - window + 1:
            part = words[at : at + max(limit, window)]
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((name, part))
            size += len(part)
            at += max(limit, window) - window + 1
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", limit: int = MAX_PATTERN_WORDS) -> DataFrame:
    """The columns of ``docs``, named c0, c1 ... by their places, with n_words, spans and items as in :func:`scan`.

    One set of patterns at a time is on the driver and in the executors: what a pass found is stored, and its tables are
    given up, before the next set is built."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(names, docs.schema))
    schema = own + ", n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    at = docs.columns.index(text_col)

    def step(shared, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, names[at]):
                before = None if first else (batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist())
                spans, owners, counts = [], [], []
                for i, (n, own, x) in enumerate(shared.value.find(batch.column(at).to_pylist())):
                    if before:
                        own = merge_spans(own + [(s["start"], s["end"]) for s in before[0][i]])
                        x = x | set(before[1][i])
                    counts.append(n)
                    spans.append([{"start": a, "end": b} for a, b in own])
                    owners.append(sorted(x))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(owners, pa.list_(pa.string()))],
                    names=[*names, "n_words", "spans", "items"])

        return run

    out, stored = docs.toDF(*names), None
    sets = pattern_sets(benchmark, item_col, item_text, limit, window)
    items, first = next(sets, []), True
    while True:
        shared = spark.sparkContext.broadcast(Matcher(items, window))
        found = out.mapInArrow(step(shared, first), schema)
        items = next(sets, None)
        if items is None:
            return found
        out = materialize(found, "searched")
        shared.unpersist()
        if stored is not None:
            discard(stored)
        stored, first = out, False


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", limit: int = MAX_PATTERN_WORDS) -> DataFrame:
    """The columns of ``keep`` with n_words, spans (word ranges inside occurrences of a window of ``window`` consecutive
    item words; a shorter item is one window) and items (texts of the item ids that occur, sorted).

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  Null and empty texts have no
    words and no spans; items without words match nothing; repeated rows are judged alike; other columns are
    ignored; a kept column may have the name of a result, which then stands behind it.  The tables of a pattern
    set are bounded by ``limit`` words and broadcast; a larger benchmark is searched in further passes, each of
    which adds to what the passes before it found.
    """
    found = search(docs.select(*keep, F.col(text_col).alias("__text")), benchmark, window, "__text", item_col, item_text, limit)
    return found.drop(f"c{len(keep)}").toDF(*keep, "n_words", "spans", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without an occurrence, columns unchanged."""
    found = search(docs, benchmark, window, text_col, item_col, item_text)
    return found.where(F.size("spans") == 0).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame) -> DataFrame:
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    out = []
    for doc, text in docs:
        w = alnum_words(text)
        hit, names = set(), set()
        for item, t in items:
            v = alnum_words(t)
            m = min(window, len(v))
            for i in range(len(v) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == v[i : i + m]:
                        hit.update(range(j, j + m))
                        names.add(str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def oracle() -> str:
    words = r"list_filter(regexp_split_to_array(regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words.format(t='text')}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({words.format(t='text')}, []) AS w FROM benchmark),
p AS (SELECT item_id, least({WINDOW}, len(w)) AS m, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
pats AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS k FROM p),
lens AS (SELECT DISTINCT m FROM pats),
dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m),
occ AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, pats.item_id FROM dw JOIN pats ON dw.m = pats.m AND list_slice(dw.w, dw.i, dw.i + dw.m - 1) = pats.k),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""
