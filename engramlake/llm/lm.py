"""Operator 1: language-model scoring with an Elias-Fano n-gram trie.

Documents become blocks.  Words are numbered by shards that hold the vocabulary; each block then sends its distinct
n-grams, with their training counts, to shards that build a trie of the training n-grams, answer with quantised
probabilities, and never see a text.  A shard of the model is one buffer of Elias-Fano sequences and codes
that is read in place.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import (
    DOCS, PACKET_SCHEMA, QUERY, REPLY, Block, blocks, deltas, first_of_runs, grouped, in_fold, lower_words, materialize, mix64, pack,
    packets, shard_count, sized, slices, table, trimmed, undeltas, unpack,
)

#: Weight of the lower order in a context, in pseudo-counts.
PRIOR = 200.0
#: Probabilities are stored as bytes: code c is 10^(-c / CODES_PER_DECADE).
CODES_PER_DECADE = 16.0
TOP_CODE = 255
TOKENS, TYPES = 8, 9
END = b""


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * CODES_PER_DECADE), 0, TOP_CODE).astype(np.uint8)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    if not width or not len(values):
        return np.empty(0, np.uint8)
    out, place = [], np.arange(width, dtype=np.uint64)
    for i in range(0, len(values), 1 << 15):  # a multiple of 8 values ends on a byte
        bits = (values[i : i + (1 << 15), None] >> place) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"))
    return np.concatenate(out)


class EliasFano:
    """A monotone sequence: low bits side by side, high bits in unary.  ``parts`` are the arrays to store."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.padded = np.concatenate([low, np.zeros(9, np.uint8)])
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little")) if n else np.empty(0, np.int64)
        self.upper = ones[:n] - np.arange(n)  # the select directory, made on opening
        self.buckets = np.searchsorted(self.upper, np.arange(int(self.upper[-1]) + 2)) if n else np.zeros(1, np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = _pack_bits(values.astype(np.uint64) & np.uint64((1 << width) - 1), width)
        upper = (values.astype(np.uint64) >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(int(upper[-1]) + n + 1 if n else 0, np.uint8)
        bits[upper + np.arange(n)] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        start = at * self.width
        byte = start >> 3
        word = np.zeros(len(at), np.uint64)
        for j in range(8):
            word |= self.padded[byte + j].astype(np.uint64) << np.uint64(8 * j)
        out = word >> (start & 7).astype(np.uint64)
        if self.width > 57:
            shift = (start & 7).astype(np.uint64)
            out |= np.where(shift > 0, self.padded[byte + 8].astype(np.uint64) << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (out & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.upper[at] << self.width) | self._low(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Position of the first element not below each value: the bucket of its high bits, then bisection by low bits."""
        if not self.n:
            return np.zeros(len(values), np.int64)
        bucket = np.minimum(values >> self.width, len(self.buckets) - 1)
        lo = self.buckets[bucket].copy()
        hi = np.where(bucket + 1 < len(self.buckets), self.buckets[np.minimum(bucket + 1, len(self.buckets) - 1)], self.n)
        beyond = (values >> self.width) > bucket
        lo[beyond] = hi[beyond]
        want = values & ((1 << self.width) - 1)
        open_ = lo < hi
        while open_.any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(values), bool)
            less[open_] = self._low(mid[open_]) < want[open_]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
            open_ = lo < hi
        return lo


class Trie:
    """Two levels: contexts, and under each context its words.  A word is stored as the sum of its id and the largest
    value of the contexts before, so that the level is monotone and pointers into it are too."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, children: EliasFano, backoff: np.ndarray, probability: np.ndarray):
        self.contexts, self.pointers, self.children, self.backoff, self.probability = contexts, pointers, children, backoff, probability

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, probability: np.ndarray, backoff: np.ndarray) -> Trie:
        """From entries sorted by context and word; ``backoff`` has a code for each distinct context."""
        first = np.flatnonzero(first_of_runs(context))
        ends = np.concatenate([first[1:], [len(word)]]).astype(np.int64)
        last = word[ends - 1] if len(first) else np.empty(0, np.int64)
        base = np.concatenate([[0], np.cumsum(last + 1)])[:-1]
        children = word + np.repeat(base, ends - first)
        return cls(EliasFano.of(context[first]), EliasFano.of(np.concatenate([first, [len(word)]])), EliasFano.of(children), backoff, probability)

    def to_bytes(self) -> bytes:
        heads, parts = [], []
        for s in (self.contexts, self.pointers, self.children):
            heads += [s.n, s.width, len(s.low), len(s.high)]
            parts += [s.low, s.high]
        heads += [len(self.backoff), len(self.probability)]
        return np.array(heads, "<i8").tobytes() + b"".join(p.tobytes() for p in [*parts, self.backoff, self.probability])

    @classmethod
    def over(cls, buffer) -> Trie:
        """Over a buffer or memory map; nothing but the select directories is copied."""
        h = np.frombuffer(buffer, "<i8", 14).tolist()
        at = 14 * 8
        sequences = []
        for i in range(0, 12, 4):
            n, width, low, high = h[i : i + 4]
            sequences.append(EliasFano(n, width, np.frombuffer(buffer, np.uint8, low, at), np.frombuffer(buffer, np.uint8, high, at + low)))
            at += low + high
        return cls(*sequences, np.frombuffer(buffer, np.uint8, h[12], at), np.frombuffer(buffer, np.uint8, h[13], at + h[12]))

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls.over(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, code, backoff code).  The successor is sought relative to the context: its children start after the
        largest value before them."""
        n = len(context)
        found, code, backoff = np.zeros(n, bool), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        if not self.contexts.n or not n:
            return found, code, backoff
        node = self.contexts.successor(context)
        known = np.flatnonzero(node < self.contexts.n)
        known = known[self.contexts[node[known]] == context[known]]
        node = node[known]
        backoff[known] = self.backoff[node]
        begin, end = self.pointers[node], self.pointers[node + 1]
        base = np.where(begin > 0, self.children[np.maximum(begin - 1, 0)] + 1, 0)
        value = base + word[known]
        at = self.children.successor(value)
        hit = (at < end) & (at >= begin)
        hit[hit] = self.children[at[hit]] == value[hit]
        found[known[hit]] = True
        code[known[hit]] = self.probability[at[hit]]
        return found, code, backoff


def _word_shard(vocab: list[bytes], n_shards: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % n_shards for w in vocab), np.int64, len(vocab))


def _runs(shard: np.ndarray, n_shards: int) -> Iterator[tuple[int, int, int]]:
    cuts = np.searchsorted(shard, np.arange(n_shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), int(cuts[s]), int(cuts[s + 1])


class Known:
    """A block with what the vocabulary shards said: global ids and training counts of its words."""

    def __init__(self, t: pa.Table, stride: int, n_shards: int):
        ids, counts = {}, {}
        self.answers = {}
        for kind, name, shard, data in zip(*(t.column(c).to_pylist() for c in ("kind", "block", "shard", "data"))):
            if kind == DOCS:
                self.name, self.block = name, Block.unpack(unpack(data)[0])
                self.end = int(unpack(data)[1][0])
            elif kind == REPLY:
                i, c = unpack(data)
                ids[shard], counts[shard] = undeltas(i) + shard * stride, c
            else:
                self.answers[shard] = data
        self.gid = np.concatenate([ids[s] for s in sorted(ids)])
        self.count = np.concatenate([counts[s] for s in sorted(counts)]).astype(np.int64)
        b = self.block
        previous = np.empty_like(b.ids)
        previous[1:] = b.ids[:-1]
        previous[b.starts()[:-1]] = self.end  # a text begins after an end
        self.pairs, self.pair_of = np.unique(previous * len(self.gid) + b.ids, return_inverse=True)
        self.left, self.right = self.pairs // len(self.gid), self.pairs % len(self.gid)
        shard = (mix64(mix64(self.gid[self.left]) ^ self.gid[self.right].astype(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
        self.order = np.argsort(shard.astype(np.uint16) if n_shards < 1 << 16 else shard, kind="stable")
        self.shard = shard[self.order]


def score_texts(docs: DataFrame, train: str = "train", prior: float = PRIOR, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (ASCII white space, A-Z lower-cased) and one end a text, so null and empty texts have one
    token.  The rows where the boolean column ``train`` holds are learned from; without any, every token is
    unknown.  ``base_score`` adds log10((c+1)/(N+V+1)).  ``score`` is the model's log10 probability of the text,
    p(w | v) = (c(v w) + prior * p(w)) / (c(v) + prior) over the base distribution p, each factor rounded to the
    trie's byte codes.  Repeated rows are scored each; other columns are ignored; no rows give no rows.
    """
    source = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(train).cast("int").alias("flag"))
    source = sized(source)
    n_shards = shard_count(source)

    def split(text):
        return [*lower_words(text), END]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, vocab in blocks(slices(batches), split):
            shard = _word_shard(vocab, n_shards)
            order = np.array(sorted(range(len(vocab)), key=lambda i: (shard[i], vocab[i])), np.int64)
            new = np.empty(len(vocab), np.int64)
            new[order] = np.arange(len(vocab))
            end = new[vocab.index(END)]
            block.ids = new[block.ids]
            count = np.bincount(block.ids[np.repeat(block.flags & 1 > 0, block.lengths)], minlength=len(vocab))
            rows = [(DOCS, name, -1, pack(block.pack(), np.array([end])))]
            for s, a, b in _runs(shard[order], n_shards):
                rows.append((QUERY, name, s, pack(b" ".join([vocab[i] for i in order[a:b]]), count[a:b])))
            yield packets(rows)

    def number(t: pa.Table) -> pa.Table:
        """Ids within the shard in word order, and training counts over all blocks."""
        shard = t.column("shard")[0].as_py()
        sent = [(v.split(b" "), c) for v, c in map(unpack, t.column("data").to_pylist())]
        total: dict[bytes, int] = {}
        for vocab, count in sent:
            for w, c in zip(vocab, count.tolist()):
                total[w] = total.get(w, 0) + c
        place = {w: i for i, w in enumerate(sorted(total))}
        # training tokens and types of the shard, each with its number of words
        rows = [(TOKENS, sum(total.values()), len(total), b""), (TYPES, sum(c > 0 for c in total.values()), len(total), b"")]
        for name, (vocab, _) in zip(t.column("block").to_pylist(), sent):
            ids = np.fromiter((place[w] for w in vocab), np.int64, len(vocab))
            rows.append((REPLY, name, shard, pack(deltas(ids), np.fromiter((total[w] for w in vocab), np.int64, len(vocab)))))
        return pa.Table.from_batches([packets(rows)])

    sent = materialize(source.mapInArrow(encode, PACKET_SCHEMA), "lm")
    held = sent.where(F.col("kind") == DOCS)
    numbered = materialize(grouped(sent.where(F.col("kind") == QUERY), "shard", n_shards).applyInArrow(trimmed(number), PACKET_SCHEMA), "vocabulary")
    stats = numbered.where(F.col("kind").isin(TOKENS, TYPES)).groupBy("kind").agg(F.sum("block").alias("n"), F.max("shard").alias("words"))
    seen = {r.kind: (r.n, r.words) for r in stats.collect()}
    n_train, n_types = (seen.get(k, (0, 0))[0] for k in (TOKENS, TYPES))
    stride = max(1, seen.get(TOKENS, (0, 0))[1])  # a word's id: its shard times the largest shard's words, and its place
    floor = n_train + n_types + 1

    def ask(t: pa.Table) -> pa.Table:
        k = Known(t, stride, n_shards)
        trained = np.repeat(k.block.flags & 1 > 0, k.block.lengths)
        count = np.bincount(k.pair_of[trained], minlength=len(k.pairs))
        rows = []
        for s, a, b in _runs(k.shard, n_shards):
            at = k.order[a:b]
            left = k.left[at]
            first = np.flatnonzero(first_of_runs(left))
            sizes = np.diff(first, append=len(at)).astype(np.int32)
            word = k.gid[k.right[at]]
            step = deltas(word)
            step[first] = word[first]
            rows.append((QUERY, k.name, s, pack(
                deltas(k.gid[left[first]]), k.count[left[first]], sizes, step.astype(np.int64), count[at].astype(np.uint32),
                quantise((k.count[k.right[at]] + 1) / floor))))
        return pa.Table.from_batches([packets(rows)])

    def answer(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        parts = []
        for data in t.column("data").to_pylist():
            ctx, seen, sizes, step, count, low = unpack(data)
            sizes = sizes.astype(np.int64)
            total = np.cumsum(step)
            start = np.cumsum(sizes) - sizes
            word = total - np.repeat(total[start] - step[start], sizes)
            parts.append((np.repeat(undeltas(ctx), sizes), np.repeat(seen, sizes), word, count.astype(np.int64), low))
        ctx, seen, word, count, low = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((word, ctx))
        first = np.flatnonzero(first_of_runs(ctx[order]) | first_of_runs(word[order]))
        total = np.add.reduceat(count[order], first)
        at, total = order[first][total > 0], total[total > 0]
        lower = 10.0 ** (-low[at].astype(float) / CODES_PER_DECADE)
        heads = at[first_of_runs(ctx[at])] if len(at) else at
        trie = Trie.build(ctx[at], word[at], quantise((total + prior * lower) / (seen[at] + prior)), quantise(prior / (seen[heads] + prior)))
        raw = trie.to_bytes()
        level = mmap.mmap(-1, len(raw))
        level.write(raw)
        trie = Trie.over(level)
        del order, first, total, at, lower
        found, code = np.empty(len(ctx), bool), np.empty(len(ctx), np.uint8)
        for i in range(0, len(ctx), 1 << 18):
            found[i : i + (1 << 18)], code[i : i + (1 << 18)], _ = trie.lookup(ctx[i : i + (1 << 18)], word[i : i + (1 << 18)])
        away = quantise(prior / (seen + prior)).astype(np.int64) + low  # an unseen pair backs off, seen context or not
        code = np.where(found, code, np.minimum(away, TOP_CODE)).astype(np.uint8)
        cut = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        return pa.Table.from_batches([packets([(REPLY + 1, b, shard, pack(code[i:j])) for b, i, j in zip(t.column("block").to_pylist(), cut, cut[1:])])])

    def score(t: pa.Table) -> pa.Table:
        k = Known(t, stride, n_shards)
        code = np.empty(len(k.pairs), np.int64)
        for s, a, b in _runs(k.shard, n_shards):
            code[k.order[a:b]] = unpack(k.answers[s])[0]
        b = k.block
        starts = b.starts()[:-1]
        known = np.add.reduceat((k.count > 0)[b.ids].astype(np.int64), starts)
        plain = np.add.reduceat(np.log10((k.count + 1) / floor)[b.ids], starts)
        model = np.add.reduceat(code[k.pair_of], starts) / -CODES_PER_DECADE
        return pa.table({
            "doc_id": b.ids_array(), "train": pa.array(b.flags & 1 > 0), "n_tokens": pa.array(b.lengths, pa.int64()),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), n_train, np.int64)),
            "base_score": pa.array(plain, pa.float64()), "score": pa.array(model, pa.float64()),
        })

    vocabulary = numbered.where(F.col("kind") == REPLY)
    asked = grouped(held.union(vocabulary), "block", n_shards).applyInArrow(trimmed(ask), PACKET_SCHEMA)
    answers = grouped(asked, "shard", n_shards).applyInArrow(trimmed(answer), PACKET_SCHEMA)
    return grouped(held.union(vocabulary).union(answers), "block", n_shards).applyInArrow(trimmed(score), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", ~in_fold(F.col("doc_id"), 7, 2))
    scored = score_texts(docs)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute_force(docs: list[tuple], prior: float = PRIOR) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, N, base_score, unquantised score)"""
    import math

    split = [(d, [w for w in (t or "").encode().lower().split()] + [END], zlib.crc32(str(d).encode()) % 7 != 2) for d, t in docs]
    one: dict = {}
    two: dict = {}
    for _, w, train in split:
        if train:
            for a, b in zip([END, *w], w):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
    n, v = sum(one.values()), len(one)
    out = []
    for d, w, train in split:
        base = [(one.get(x, 0) + 1) / (n + v + 1) for x in w]
        full = [(two.get((a, b), 0) + prior * p) / (one.get(a, 0) + prior) for a, b, p in zip([END, *w], w, base)]
        out.append((d, not train, len(w), sum(x in one for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out
