"""Operator 4: SimHash near-duplicates, compared per anchor of a covering code."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.lineage import discard
from engramlake.llm.common import first_of_runs, lower_words, materialize, mix64, shard_count, slices, table
from engramlake.llm.components import components

SHINGLE = 4
THRESHOLD = 4
BLOCKS = 3
_PAIRS_AT_ONCE = 1 << 21
#: Copies of one anchor that one task compares; an anchor with more is dealt to several.
ANCHOR_ROWS = 200_000
_HASHES_AT_ONCE = 1 << 16


def shingle_hashes(found: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``k`` words joined by spaces; of the whole sequence if it is shorter."""
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    text = b" ".join(found)
    ends = [e + i for i, e in enumerate(accumulate(map(len, found)))]
    starts = [0, *(e + 1 for e in ends[: len(found) - k])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], 42) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[i : i + _HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


class CoveringCode:
    """Anchors for one run of ``width`` bits: the Hamming code on the first 2^r - 1 bits, all words on the others.
    Every word has exactly one anchor within distance 1, its *home* (``decode``)."""

    def __init__(self, offset: int, width: int, slack: int):
        self.offset, self.width = offset, width
        r = (width + 1).bit_length() - 1
        self.checks = [sum(1 << (p - 1) for p in range(1, 1 << r) if p >> j & 1) for j in range(r)]
        self.errors = np.array([sum(1 << b for b in c) for w in range(slack + 1) for c in combinations(range(width), w)], np.uint64)

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(self.offset)) & np.uint64((1 << self.width) - 1)

    def decode(self, b: np.ndarray) -> np.ndarray:
        syndrome = np.zeros(b.shape, np.uint64)
        for j, mask in enumerate(self.checks):
            syndrome |= (np.bitwise_count(b & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
        return np.where(syndrome > 0, b ^ (np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1))), b)

    def anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of x, anchor, is home): every anchor that is home to a word within ``slack`` of x; these lie within
        the covering radius plus the slack."""
        b = self.bits(x)
        all_ = np.sort(self.decode(b[:, None] ^ self.errors[None, :]), axis=1)
        new = np.ones(all_.shape, bool)
        new[:, 1:] = all_[:, 1:] != all_[:, :-1]
        who, at = np.nonzero(new)
        anchor = all_[who, at]
        return who, anchor, anchor == self.decode(b)[who]


def covering(threshold: int = THRESHOLD, blocks: int = BLOCKS) -> list[CoveringCode]:
    """64 bits in ``blocks`` runs: two fingerprints within ``threshold`` differ in at most threshold // blocks bits of
    one of them, so in that run the home anchor of one is among the anchors of the other."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [CoveringCode(a, b - a, threshold // blocks) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Run:
    """One run of bits: its code, the word of the fingerprint it lies in, and the words its copies carry."""

    code: CoveringCode
    word: int
    carried: tuple[int, ...]


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of a graph to the least node it is connected with: at most one for each node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for side in (i, j):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_pairs(key: np.ndarray, home: np.ndarray, member: np.ndarray, node: np.ndarray, words: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right): positions of the pairs (home, member) of one key whose ``words`` differ in at most ``most`` bits.
    Pairs are formed in bounded runs; the rows must be sorted by key, members first, then by node."""
    cut = np.flatnonzero(first_of_runs(key))
    group = np.cumsum(first_of_runs(key)) - 1
    members = np.add.reduceat(member.astype(np.int64), cut) if len(cut) else cut
    homes = np.flatnonzero(home)
    homes = homes[np.lexsort((node[homes], group[homes]))]
    size, begin = members[group[homes]], cut[group[homes]]
    total = np.cumsum(size)
    at = 0
    while at < len(homes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + _PAIRS_AT_ONCE, "right")))
        n = size[at:to]
        left = np.repeat(homes[at:to], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
        apart = node[left] != node[right]
        left, right = left[apart], right[apart]
        far = np.zeros(len(left), np.int64)
        for w in words:
            far += np.bitwise_count(w[left] ^ w[right])
            left, right, far = left[far <= most], right[far <= most], far[far <= most]
        if len(left):
            yield left, right
        at = to


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row; fp holds the 64 bits.  Null texts and texts without words have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(shingle_hashes(lower_words(t), shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def link_fingerprints(distinct: DataFrame, runs: list[Run], most: int, partitions: int = 64) -> DataFrame:
    """Edges (a, b) that connect the rows of ``distinct`` as the pairs found do: ``node`` names a row, w0, w1 ... are the
    words of its fingerprint.

    Each row is replicated to its anchors in every run, and the rows of an anchor are compared by the words that
    they carry, which may differ in at most ``most`` bits.  Anchors of more than ``ANCHOR_ROWS`` copies are dealt to
    several keys: a member to one, a home to all of them.
    """
    carry = [f"f{i}" for i in range(len(runs[0].carried))]
    names = ["key", "home", "member", "node", *carry]
    words = sorted({r.word for r in runs} | {w for r in runs for w in r.carried})
    spark = distinct.sparkSession
    source = distinct.select("node", *(f"w{i}" for i in words))

    def anchored(batch: pa.RecordBatch) -> Iterator[tuple]:
        node, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held = {w: c.view(np.uint64) for w, c in zip(words, cols)}
        for k, run in enumerate(runs):
            for i in range(0, len(node), 1 << 14):
                who, anchor, home = run.code.anchors(held[run.word][i : i + (1 << 14)])
                yield run, node, held, i + who, (np.int64(k) << np.int64(48)) | (anchor.astype(np.int64) << np.int64(16)), home

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, key, _ in anchored(batch):
                k, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["key", "n"])

    hot = source.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > ANCHOR_ROWS)
    # at most (copies / ANCHOR_ROWS) anchors
    large = sorted((r["key"], -(-r["n"] // ANCHOR_ROWS)) for r in hot.collect())
    dealt = spark.sparkContext.broadcast((np.array([k for k, _ in large], np.int64), np.array([min(n, 1 << 16) for _, n in large], np.int64)))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, parts = dealt.value
        for batch in batches:
            for run, node, held, who, key, home in anchored(batch):
                member = np.ones(len(key), bool)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    n = np.where(hot[at] == key, parts[at], 1)
                    own = (mix64(node[who]) % n.astype(np.uint64)).astype(np.int64)
                    more = np.flatnonzero(home & (n > 1))
                    copy = np.repeat(more, n[more])
                    part = np.arange(len(copy)) - np.repeat(np.cumsum(n[more]) - n[more], n[more])
                    other = part != own[copy]
                    copy, part = copy[other], part[other]
                    key = np.concatenate([key | own, key[copy] | part])
                    who, home = np.concatenate([who, who[copy]]), np.concatenate([home, home[copy]])
                    member = np.concatenate([member, np.zeros(len(copy), bool)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(home), pa.array(member), pa.array(node[who]), *(pa.array(held[w][who].view(np.int64)) for w in run.carried)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, home, member, node, *carried = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        order = np.lexsort((node, ~member, key))
        key, home, member, node = key[order], home[order], member[order], node[order]
        for left, right in near_pairs(key, home, member, node, [c[order].view(np.uint64) for c in carried], most):
            a, b = star_edges(node[left], node[right])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    copies = source.mapInArrow(replicate, "key long, home boolean, member boolean, node long" + "".join(f", {c} long" for c in carry))
    return copies.repartition(partitions, "key").mapInArrow(compare, "a long, b long")


SIMILARITY = 0.8
STAGE_SHINGLE = 5
#: Share of the pairs just at the similarity that meet in a band; pairs above it meet more often.
RECALL = 0.997
#: Minima that make the key of one band: sets of similarity s share a key with probability s^BAND_ROWS.
BAND_ROWS = 8
#: Words of a fingerprint, and the standard deviations of slack in comparing them.
WORDS, SLACK = 3, 4.5
#: Shingles of a cluster that are compared in one block; the blocks of a larger cluster meet two by two.
BLOCK_SHINGLES = 2_000_000
#: Keys that one task brings together.
BAND_KEYS = 1_000_000
_MINIMA_AT_ONCE = 512


def flips(similarity: float) -> float:
    """Share of SimHash bits in which two sets of equal size and this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bands(similarity: float = SIMILARITY) -> int:
    """Bands that ``RECALL`` needs, whatever the number of texts."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - similarity**BAND_ROWS))


def band_keys(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` keys of a set that isn't empty, each of the minima of the set under ``BAND_ROWS`` hash functions."""
    k = np.arange(count * BAND_ROWS, dtype=np.uint64)
    times, plus = (mix64(2 * k + np.uint64(99991)) | np.uint64(1)).astype(np.uint32), mix64(2 * k + np.uint64(1299710)).astype(np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(k), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), _MINIMA_AT_ONCE):
        np.minimum(least, (x[i : i + _MINIMA_AT_ONCE, None] * times + plus).min(0), out=least)
    keys = np.arange(1, count + 1, dtype=np.uint64)
    for row in least.reshape(count, BAND_ROWS).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def shingle_sketches(rows: DataFrame, words: int, shingle: int, count: int) -> DataFrame:
    """(row, d0, d1, n, w0, w1 ..., keys) of (row, text): 128-bit digest, size, fingerprint and ``count`` band keys of the set
    of shingles; an empty set has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, keys = [], []
            for t in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(lower_words(t), shingle))
                digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                out.append([*digest.tolist(), len(h), *(np.uint64(fingerprint(mix64(h + np.uint64(k)))).view(np.int64) for k in range(words))])
                keys.append(band_keys(h, count) if len(h) else np.empty(0, np.int64))
            cols = np.array(out, np.int64).reshape(len(out), words + 3).T
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols), lists],
                                             names=["row", "d0", "d1", "n", *(f"w{k}" for k in range(words)), "keys"])

    kind = "row long, d0 long, d1 long, n long" + "".join(f", w{k} long" for k in range(words)) + ", keys array<long>"
    return rows.select("row", "text").mapInArrow(run, kind)


def band_links(keyed: DataFrame, partitions: int) -> DataFrame:
    """Edges (a, b) from each row of (node, keys) to the least node that shares a key with it, for each key.

    Rows of one batch that share a key are linked there and only their least node goes on, so a key that many rows
    share sends one row a batch."""

    def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = first_of_runs(key)
        return first, node, node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else node

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            key = lists.flatten().to_numpy()
            node = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            first, node, least = stars(key, node)
            # a link that is already found rides with its node, an entry of a key with the key
            deals = np.where(first, np.sort(key), mix64(node).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(deals), pa.array(node), pa.array(least), pa.array(first)], names=["key", "node", "least", "entry"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, node, least, entry = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        first, met, low = stars(key[entry], node[entry])
        edges = np.stack([np.concatenate([node[~entry], met[~first]]), np.concatenate([least[~entry], low[~first]])], 1)
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], names=["a", "b"])

    dealt = keyed.select("node", "keys").mapInArrow(deal, "key long, node long, least long, entry boolean")
    return dealt.repartition(partitions, "key").mapInArrow(meet, "a long, b long")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) of (node, text): the distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(lower_words(t), shingle)) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["node", "grams"])

    return rows.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar_links(words: np.ndarray, sets: list[np.ndarray], side: np.ndarray, most: int, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j), at most one less than rows, that connect the rows as all pairs do that are similar, of different
    ``side`` where there are two, and whose fingerprints differ in at most ``most`` bits.  The nearest pairs are
    measured first, and pairs that the links so far connect aren't measured."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (np.arange(n), np.arange(n))
    out = []
    step = max(1, _PAIRS_AT_ONCE // max(1, len(second)))
    for at in range(0, len(first), step):
        rows = first[at : at + step]
        far = np.zeros((len(rows), len(second)), np.int64)
        for k in range(words.shape[1]):
            far += np.bitwise_count(words[rows, k][:, None] ^ words[second, k][None, :])
        small, large = np.minimum(size[rows][:, None], size[second][None, :]), np.maximum(size[rows][:, None], size[second][None, :])
        i, j = np.nonzero((far <= most) & (rows[:, None] != second[None, :]) & (small >= similarity * large - 1e-9))
        order = np.argsort(far[i, j], kind="stable")
        for a, b in zip(rows[i[order]].tolist(), second[j[order]].tolist()):
            x, y = find(a), find(b)
            if x == y:
                continue
            common = overlap(sets[a], sets[b])
            if common >= similarity * (size[a] + size[b] - common) - 1e-9:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def confirmed_links(clusters: DataFrame, rows: DataFrame, words: int, most: int, similarity: float, shingle: int) -> DataFrame:
    """Edges (a, b) between similar nodes of one cluster; ``clusters`` has node, root, n, w0, w1 ...

    A cluster's sets are dealt to blocks of a bounded number of shingles, and the blocks meet two by two."""
    prints = [f"w{k}" for k in range(words)]
    total = clusters.groupBy("root").agg(F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("long")
    dealt = materialize(clusters.join(total, "root").withColumn("blocks", blocks), "clusters")
    texts = rows.join(dealt.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "text")
    sets = materialize(shingle_sets(texts, shingle), "shingles")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = dealt.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", *prints)
    met = met.join(sets, "node")

    def confirm(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        grams = t.column("grams").combine_chunks()
        offsets, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
        held = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
        own = np.stack([t.column(w).to_numpy().view(np.uint64) for w in prints], 1)
        links = np.array(similar_links(own, held, side, most, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": node[links[:, 0]], "b": node[links[:, 1]]})

    found = materialize(met.groupBy("root", "x", "y").applyInArrow(confirm, "a long, b long"), "similar")
    discard(sets)
    discard(dealt)
    return found


def link_texts(classes: DataFrame, keyed: DataFrame, rows: DataFrame, words: int, similarity: float, shingle: int, partitions: int) -> DataFrame:
    """Edges (a, b) between nodes of ``classes`` (node, n, w0, w1 ...) whose texts in ``rows`` (row, text) are similar, enough
    to connect all similar pairs that share a key in ``keyed`` (node, keys).

    Texts that share a key make clusters; within a cluster the fingerprints and then the sets themselves are compared."""
    p, bits = flips(similarity), 64 * words
    most = math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))
    roots = materialize(components(band_links(keyed, partitions), "clusters"), "clusters")
    clusters = classes.join(roots, "node").select("node", "root", "n", *(f"w{k}" for k in range(words)))
    return confirmed_links(clusters, rows, words, most, similarity, shingle)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = STAGE_SHINGLE,
                         doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document of each group of near-duplicates: the one with the smallest id stays
    (null ids come last, then the earlier row).

    Two documents are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or
    more and these sets share the key of a band of minima; links are followed.  Every link is confirmed by its exact
    similarity, so no other documents are linked.  Pairs meet with a probability of ``RECALL`` just at ``similarity``
    and more above it; equal sets always do.  A row costs a fixed number of keys, and texts that have little in common
    don't meet, so the work grows with the rows.  Texts of fewer words are one shingle.
    Null and empty texts are one group.  Rows are numbered once and stored with their numbers, as another read
    may deal them otherwise.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = materialize(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    doc, text = (names[docs.columns.index(c)] for c in (doc_col, text_col))
    n = max(1, numbered.count())
    count = bands(similarity)
    rows = numbered.select("row", F.col(text).alias("text"))
    sketches = materialize(shingle_sketches(rows, WORDS, shingle, count), "sketches")
    prints = [f"w{k}" for k in range(WORDS)]
    order = F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), "row")
    named = sketches.drop("keys").join(numbered.select("row", doc), "row")
    classes = named.groupBy("d0", "d1").agg(F.min(order).alias("first"), *(F.min(c).alias(c) for c in ("n", *prints)))
    classes = materialize(classes.select(F.col("first.row").alias("node"), F.col("first.none").alias("none"), F.col("first.doc").alias("doc"), "n", *prints), "classes")
    keyed = sketches.select(F.col("row").alias("node"), "keys").join(classes.select("node"), "node", "left_semi")
    partitions = int(max(24, n * count // BAND_KEYS))
    roots = components(link_texts(classes, keyed, rows, WORDS, similarity, shingle, partitions), "near")
    placed = classes.join(roots, "node", "left").select("node", "none", "doc", F.coalesce("root", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min(F.struct("none", "doc", "node")).alias("first")).select(F.col("first.node").alias("row"))
    # narrow rows tell which go; these are few as a rule, and then texts needn't be dealt anew to be left out
    gone = materialize(sketches.select("row").join(kept, "row", "left_anti"), "gone")
    return numbered.join(gone, "row", "left_anti").select(*names).toDF(*docs.columns)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, blocks: int = BLOCKS,
                    doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, fp (long) and component_id, the smallest doc_id that links reach.

    Documents whose fingerprints differ in at most ``threshold`` bits are linked; links are followed.  Equal
    fingerprints are one class, so copies meet no one but their class.  Null and empty texts have fingerprint zero
    and are linked like any other; a null doc_id is never a component_id unless its component has no other.
    """
    fps = materialize(fingerprints(docs, shingle, doc_col, text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    runs = [Run(code, 0, (0,)) for code in covering(threshold, blocks)]
    links = link_fingerprints(classes.select(F.col("fp").alias("node"), F.col("fp").alias("w0")), runs, threshold, shard_count(fps, 1 << 16, 24))
    roots = components(links, "simhash")
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    # plain joins of stored tables, whose hot keys can be split
    low = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "low")
    labels = materialize(placed.join(low, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple], shingle: int = SHINGLE, threshold: int = THRESHOLD) -> list[tuple]:
    fps = {}
    for doc, text in docs:
        w = [x.decode() for x in lower_words(text)]
        grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    group = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= threshold and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return [(d, f"{fps[d]:016x}", group[d]) for d in fps]
