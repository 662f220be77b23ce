"""Operator 7: best-fit packing by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.llm.common import materialize, slices, table

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Fillings that the search may enumerate, over all bins and per bin.
SEARCH_NODES = 20_000
FILLINGS = 16

Plan = list[tuple[list[tuple[int, int]], int]]


def fillings(room: int, counts: dict[int, int], lengths: list[int], most: int = FILLINGS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(items with counts, waste) of undominated ways to fill ``room``, best first.

    ``lengths`` are the lengths left, falling.  The depth-first search takes lengths in falling order, as many items of
    each as fit and then fewer, and keeps maximal fillings: one into whose waste another item fits is dominated.  So is
    one in which a longer item that is left fits in the place of another.  An exact fit by one item dominates every
    other filling.  The first descent always ends in a filling; limits apply after it."""
    if counts.get(room, 0) > 0:
        return [(((room, 1),), 0)]
    found: dict[tuple[tuple[int, int], ...], int] = {}
    steps = 0

    def go(left: int, at: int, taken: dict[int, int]) -> None:
        nonlocal steps
        maximal = True
        for i in range(at, len(lengths)):
            x = lengths[i]
            fit = min(counts[x], left // x)
            if fit:
                maximal = False
            for k in range(fit, 0, -1):
                steps += 1
                if found and (steps > 40 * most or len(found) >= 4 * most or (len(found) > 1 and 0 in found.values())):
                    return
                go(left - k * x, i + 1, {**taken, x: k})
        if maximal and not any(x <= left and counts[x] > taken.get(x, 0) for x in lengths[:at]):
            found[tuple(taken.items())] = left

    def dominated(items: tuple[tuple[int, int], ...], waste: int) -> bool:
        used = dict(items)
        return any(counts.get(y, 0) > used.get(y, 0) for x in used for y in range(x + 1, x + waste + 1))

    go(room, 0, {})
    best = [f for f in found.items() if not dominated(*f)] or list(found.items())
    return sorted(best, key=lambda f: (f[1], sum(k for _, k in f[0])))[:most]


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> Plan:
    """Fillings with multiplicities that use every item once, in as few bins as the search finds.

    Bins are completed around the longest item left; a filling is repeated as often as the items last, so the
    search sees lengths and not items.  The first descent takes the best-fit filling everywhere and is the first
    incumbent; a branch is cut when its waste leaves no room for a better total.  The search ends at the volume
    bound, or after ``nodes`` bins with the best plan found."""
    total = sum(x * n for x, n in histogram.items())
    bound = -(-total // capacity)
    best: Plan = []
    best_bins = sum(histogram.values()) + 1
    spent = 0

    def choices(counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
        """(items with counts, waste) of the bins around the longest item left."""
        longest = max(counts)
        left = {x: n - (x == longest) for x, n in counts.items()}
        options = fillings(capacity - longest, left, sorted((x for x, n in left.items() if n), reverse=True))
        return [({**dict(items), longest: dict(items).get(longest, 0) + 1}, waste) for items, waste in options]

    def fill(counts: dict[int, int], plan: Plan, bins: int, waste: int, option: tuple[dict[int, int], int]) -> tuple:
        need, left = option
        times = min(counts[x] // k for x, k in need.items())
        after = {x: n - need.get(x, 0) * times for x, n in counts.items()}
        return {x: n for x, n in after.items() if n}, [*plan, (sorted(need.items(), reverse=True), times)], bins + times, waste + left * times

    stack = [({x: n for x, n in histogram.items() if n}, [], 0, 0)]
    while stack and best_bins > bound and not (best and spent >= nodes):
        state = stack.pop()
        while state[0]:
            if best and state[3] > (best_bins - 1) * capacity - total:
                break
            spent += 1
            first, *others = choices(state[0])
            if spent < nodes and len(stack) < 64:
                stack.extend(fill(*state, option) for option in reversed(others))
            state = fill(*state, first)
        else:
            if state[2] < best_bins:
                best, best_bins = state[1], state[2]
    return best


class Placement:
    """The plan as ranges: the r-th piece of a length has its sequence and offset by arithmetic."""

    def __init__(self, plan: Plan, capacity: int = CAPACITY):
        used: dict[int, int] = {}
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for items, times in plan:
            offset = 0
            for length, k in items:
                entries.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
                used[length] = used.get(length, 0) + k * times
                offset += k * length
            sequence += times
        self.entries = {x: np.array(e, np.int64) for x, e in entries.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            own = order[a:b]
            x = int(length[own[0]])
            e = self.entries[x]
            at = np.searchsorted(e[:, 0], rank[own], "right") - 1
            r = rank[own] - e[at, 0]
            sequence[own] = e[at, 2] + r // e[at, 1]
            offset[own] = e[at, 3] + r % e[at, 1] * x
        return sequence, offset


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizers file at ``path`` gives them, without special tokens added.

    Added tokens are taken out first, as that file has them.  What lies between goes to the rank file of the same
    vocabulary beside it, four times as fast; texts with very long runs of blanks, which its regular expression
    can't take, and vocabularies without such a file go to the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.added = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        ranks = path.removesuffix(".json") + ".tiktoken"
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.ranked = self._ranked(ranks) if plain and os.path.exists(ranks) else None

    @staticmethod
    def _ranked(path: str) -> tiktoken.Encoding:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _between(self, text: str) -> list[int]:
        if _LONG_BLANK.search(text):
            return self._library(text)
        try:
            return self.ranked.encode_ordinary(text)
        except BaseException as e:  # a panic of the extension is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self._library(text)

    def ids(self, text: str) -> list[int]:
        if self.ranked is None:
            return self._library(text)
        if self.split is None or not self.split.search(text):
            return self._between(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.added[part]] if part in self.added else self._between(part) if part else []
        return out


_LONG_BLANK = re.compile(r"\s{2000}")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(i, capacity) for i in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, block, local): ``local`` counts the pieces of a length in a block,
    the run of rows of one task."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            doc_at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*(enc.ids(text) if text else ()), END_ID], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    doc_at.append(i)
                    rows.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes()), block, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc_at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "local"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, local long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, doc_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id, so null and empty texts are one piece of length 1.  Only documents of
    more than ``capacity`` ids are cut.  The driver sees the histogram of lengths, at most ``capacity`` rows, and
    sends back a plan bounded by the same number; pieces of one length are interchangeable, so a piece's rank
    among them, from counts per block, gives its place.  Repeated rows are packed each; no rows give no rows.
    """
    spark = docs.sparkSession
    cutup = materialize(pieces(docs, capacity, doc_col, text_col, vocabulary), "pieces")
    counts = cutup.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(Placement(complete_bins(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cutup.join(offsets, ["block", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
