"""Operator 2: removal of repeated passages, located by sharded Aho-Corasick automata over confirmed windows.

1. Every window of 13 words has a *seed*, the least hash of its runs of 5 words; windows with equal words have
   equal seeds.  Each block sends its distinct seeds to shards and learns which recur in the corpus.
2. Runs of windows with one recurring seed are passages.  Every document's passages go, as words, to the shard of their
   seed; a passage that a block holds several times goes once, with the least and the largest document id.
3. A shard compares windows word by word.  Those that recur in several documents are the patterns; it compiles them into
   automata by ranges of seeds, one symbol a word, and streams all passages of the corpus with these seeds through
   them.  No other passage can hold a pattern.  The hits go back to the blocks and tell which words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import (
    DOCS, PACKET_SCHEMA, QUERY, REPLY, Block, blocks, by_shard, deltas, first_of_runs, grouped, materialize, mix64, pack, packets,
    shard_count, sized, slices, table, trimmed, undeltas, unpack, words,
)

WINDOW = 13
SEED = 5
PATTERNS_PER_AUTOMATON = 1_000
#: What a hit says: the pattern's first document comes before all that hold the passage in its block, or is one of them.
BEFORE, FIRST = 1, 2


def rolling(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Polynomial hash of each run of ``n`` hashes."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(factor) + h[j : j + size]
    return mix64(out)


class Windows:
    """The windows of a block: start positions, keys and seeds; positions whose window crosses documents are out."""

    def __init__(self, block: Block, vocab: list[bytes], window: int, seed: int):
        self.block, self.window = block, window
        word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))
        self.word_hash = word[block.ids] if len(vocab) else np.empty(0, np.uint64)
        self.doc = block.doc_of_word()
        n = max(0, len(block.ids) - window + 1)
        least = rolling(self.word_hash, seed, 0x9E3779B97F4A7C15)
        width = window - seed + 1
        done = 1
        while done < width:  # minimum over runs of 1, 2, 4 ... width
            by = min(done, width - done)
            least = np.minimum(least[: len(least) - by], least[by:]) if len(least) > by else least[:0]
            done += by
        self.seeds = least[:n]
        self.inside = self.doc[:n] == self.doc[window - 1 : window - 1 + n] if n else np.empty(0, bool)

    def distinct_seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct seeds, and which of them several documents of the block have."""
        at = np.flatnonzero(self.inside)
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, bool)
        s, d = self.seeds[at], self.doc[at]
        new = first_of_runs(s) | first_of_runs(d)
        s, d = s[new], d[new]
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        first = np.flatnonzero(first_of_runs(s))
        return s[first], np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)

    def passages(self, recurring: np.ndarray, n_shards: int) -> Passages:
        at = np.flatnonzero(self.inside)
        if len(at) and len(recurring):
            i = np.minimum(np.searchsorted(recurring, self.seeds[at]), len(recurring) - 1)
            at = at[recurring[i] == self.seeds[at]]
        else:
            at = at[:0]
        return Passages(self, at, n_shards)


class Passages:
    """Runs of windows of one seed, cut to ``most`` windows (longer ones repeat the seed's words), as rows of word ids that
    end in -1.  Equal rows are one *kind*; kinds are sorted by shard and by the bucket of the seed."""

    def __init__(self, w: Windows, at: np.ndarray, n_shards: int):
        self.most = w.window - SEED + 1 if w.window > SEED else 1
        seeds = w.seeds[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (seeds[1:] != seeds[:-1])
        run = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
        first = np.flatnonzero(place % self.most == 0)
        start, count = at[first], np.diff(first, append=len(at))
        width = w.window + self.most - 1
        rows = w.block.ids[np.minimum(start[:, None] + np.arange(width), max(0, len(w.block.ids) - 1))] if len(first) else np.empty((0, width), np.int64)
        rows = np.where(np.arange(width) < (count + w.window - 1)[:, None], rows, -1)
        seed = mix64(seeds[first])
        shard = (seed % np.uint64(n_shards)).astype(np.int64)
        bucket = (mix64(seed) >> np.uint64(48)).astype(np.int64)
        doc = w.block.doc_ids[w.doc[start]]
        order = np.lexsort((fold(rows), bucket, shard))
        rows, self.start, self.doc = rows[order], start[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        lead = np.flatnonzero(new)
        self.kind = np.cumsum(new) - 1
        self.rows, self.shard, self.bucket, self.count = rows[lead], shard[order][lead], bucket[order][lead], count[order][lead]
        self.low = np.minimum.reduceat(self.doc, lead) if len(lead) else self.doc
        self.high = np.maximum.reduceat(self.doc, lead) if len(lead) else self.doc

    def by_shard(self, n_shards: int) -> Iterator[tuple[int, int, int]]:
        cuts = np.searchsorted(self.shard, np.arange(n_shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            yield int(s), int(cuts[s]), int(cuts[s + 1])


def fold(rows: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + (rows[:, j] + 2).astype(np.uint64))
    return out


def _read_block(t: pa.Table) -> tuple[int, Block, list[bytes], dict[int, dict[int, bytes]]]:
    """Block id, block, vocabulary and the replies by kind and shard."""
    found = None
    replies: dict[int, dict[int, bytes]] = {}
    for kind, block, shard, data in zip(*(t.column(c).to_pylist() for c in ("kind", "block", "shard", "data"))):
        if kind == DOCS:
            inner, vocab = unpack(data)
            found = (block, Block.unpack(inner), vocab.split(b" ") if vocab else [])
        else:
            replies.setdefault(kind, {})[shard] = data
    return (*found, replies)


def _bits(replies: dict[int, bytes], keys: np.ndarray, n_shards: int) -> np.ndarray:
    """One answer for each key, from packed bits in the order in which the keys were sent."""
    out = np.zeros(len(keys), bool)
    for s, at in by_shard(keys, n_shards):
        out[at] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=len(at)).astype(bool)
    return out


def spelled(ids: np.ndarray, digits: int) -> str:
    """Each word as ``digits`` characters of base 64, the first from an alphabet of its own: an automaton's nodes stay
    narrow, and no match begins within a word."""
    out = np.empty((len(ids), digits), "<u4")
    rest = ids.copy()
    for j in range(digits - 1, -1, -1):
        out[:, j] = 64 + (rest & 63)
        rest >>= 6
    out[:, 0] += 64
    return out.tobytes().decode("utf-32-le")


def confirmed_windows(rows: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, bucket: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first document, bucket) of each distinct window that several documents hold, sorted by bucket.  Windows are
    brought together by a hash and then compared word by word."""
    passage = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(passage)) - np.repeat(np.cumsum(count) - count, count)
    windows = rows[passage[:, None], place[:, None] + np.arange(window)]
    order = np.lexsort((fold(windows), bucket[passage]))
    windows, passage = windows[order], passage[order]
    new = np.ones(len(order), bool)
    new[1:] = (windows[1:] != windows[:-1]).any(1)
    lead = np.flatnonzero(new)
    if not len(lead):
        return windows, low[:0], bucket[:0]
    least, most = np.minimum.reduceat(low[passage], lead), np.maximum.reduceat(high[passage], lead)
    several = least < most
    return windows[lead[several]], least[several], bucket[passage[lead[several]]]


def locate(rows: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, bucket: np.ndarray, window: int,
           limit: int = PATTERNS_PER_AUTOMATON) -> np.ndarray:
    """For each window of each passage, passage after passage: 0, or ``BEFORE`` or ``FIRST`` where a pattern occurs.

    ``rows`` are passages as word ids that end in -1, sorted by ``bucket``; patterns are their windows that several
    documents hold.  Automata of about ``limit`` patterns are compiled by ranges of buckets, and all passages of a
    range are streamed through its automaton."""
    begin = np.cumsum(count) - count
    state = np.zeros(int(count.sum()), np.uint8)
    patterns, owner, range_of = confirmed_windows(rows, count, low, high, bucket, window)
    i = 0
    while i < len(patterns):
        j = min(i + limit, len(patterns))
        j = int(np.searchsorted(range_of, range_of[j - 1], "right"))  # a seed's patterns stay together
        a, b = np.searchsorted(bucket, range_of[i], "left"), np.searchsorted(bucket, range_of[j - 1], "right")
        size = count[a:b] + window  # a separator ends each passage
        passage = np.repeat(np.arange(a, b), size)
        place = np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size)
        stream = rows[passage, np.minimum(place, rows.shape[1] - 1)]
        stream[np.cumsum(size) - 1] = -1
        known, stream = np.unique(stream, return_inverse=True)  # the separator is the least
        digits = max(1, -(-int(len(known)).bit_length() // 6))
        text = spelled(stream.reshape(-1).astype(np.int64), digits)
        words = spelled(np.searchsorted(known, patterns[i:j]).reshape(-1).astype(np.int64), digits)
        width = digits * window
        automaton = ahocorasick.Automaton()
        add = automaton.add_word
        for k, own in enumerate(owner[i:j].tolist()):
            add(words[k * width : (k + 1) * width], own)
        automaton.make_automaton()
        end, own = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2).T
        start = (end + 1) // digits - window
        hit = passage[start]
        state[begin[hit] + place[start]] = np.where(own < low[hit], BEFORE, FIRST)
        i = j
    return state


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of ``window`` words around it also starts in a document with a smaller id.  Words are
    runs of non-white-space (ASCII white space); windows are judged on the input.  Null and empty texts have no
    words; texts shorter than a window lose nothing; repetitions within a document, or between rows of one id,
    are no reason to remove; a null id counts as the largest.  Other columns are ignored.  No rows give no rows.
    """
    source = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source = sized(source)
    n_shards = shard_count(source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, vocab in blocks(slices(batches), words):
            seeds, several = Windows(block, vocab, window, seed).distinct_seeds()
            yield packets([(DOCS, name, -1, pack(block.pack(), b" ".join(vocab)))] + [
                (QUERY, name, s, pack(deltas(seeds[at]), np.packbits(several[at]))) for s, at in by_shard(seeds, n_shards)])

    def recur(t: pa.Table) -> pa.Table:
        names, shard = t.column("block").to_pylist(), t.column("shard")[0].as_py()
        sent = [unpack(x) for x in t.column("data").to_pylist()]
        keys = [undeltas(s) for s, _ in sent]
        size = [len(k) for k in keys]
        flat = np.concatenate(keys)
        several = np.concatenate([np.unpackbits(f, count=n).astype(bool) for (_, f), n in zip(sent, size)])
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(first_of_runs(flat[order]))
        yes = np.logical_or.reduceat(several[order], first) | (np.diff(first, append=len(flat)) > 1)
        answer = np.empty(len(flat), bool)
        answer[order] = np.repeat(yes, np.diff(first, append=len(flat)))
        cut = np.concatenate([[0], np.cumsum(size)])
        return pa.Table.from_batches([packets([(REPLY, b, shard, np.packbits(answer[i:j]).tobytes()) for b, i, j in zip(names, cut, cut[1:])])])

    def passages_of(t: pa.Table) -> tuple[int, Block, list[bytes], dict[int, dict[int, bytes]], Passages]:
        name, block, vocab, replies = _read_block(t)
        w = Windows(block, vocab, window, seed)
        seeds, _ = w.distinct_seeds()
        return name, block, vocab, replies, w.passages(seeds[_bits(replies.get(REPLY, {}), seeds, n_shards)], n_shards)

    def ask(t: pa.Table) -> pa.Table:
        name, _, vocab, _, p = passages_of(t)
        rows = []
        for s, i, j in p.by_shard(n_shards):
            inside = p.rows[i:j] >= 0
            used, ids = np.unique(p.rows[i:j][inside], return_inverse=True)
            rows.append((QUERY, name, s, pack(
                b" ".join([vocab[k] for k in used.tolist()]), ids.reshape(-1).astype(np.uint32), p.count[i:j].astype(np.uint8),
                deltas(p.bucket[i:j]).astype(np.uint16), p.low[i:j], p.high[i:j] - p.low[i:j])))
        return pa.Table.from_batches([packets(rows)])

    def confirm(t: pa.Table) -> pa.Table:
        names, shard = t.column("block").to_pylist(), t.column("shard")[0].as_py()
        index: dict[bytes, int] = {}
        parts = []
        for data in t.column("data").to_pylist():
            words, ids, count, bucket, low, more = unpack(data)
            found = [index.setdefault(x, len(index)) for x in words.split(b" ")]
            count = count.astype(np.int64)
            rows = np.full((len(count), window + int(count.max()) - 1), -1, np.int32)
            rows[np.arange(rows.shape[1]) < (count + window - 1)[:, None]] = np.array(found, np.int32)[ids]
            parts.append((rows, count, undeltas(bucket.astype(np.int64)), low, low + more))
        width = max(p[0].shape[1] for p in parts)
        rows = np.concatenate([np.pad(p[0], ((0, 0), (0, width - p[0].shape[1])), constant_values=-1) for p in parts])
        count, bucket, low, high = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        order = np.argsort(bucket, kind="stable")
        state = locate(rows[order], count[order], low[order], high[order], bucket[order], window)
        back = np.empty(len(order), np.int64)  # where a passage's answers begin
        back[order] = np.cumsum(count[order]) - count[order]
        flat = state[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - back, count)]
        cut = np.concatenate([[0], np.cumsum([p[1].sum() for p in parts])])
        return pa.Table.from_batches([packets([(REPLY + 1, b, shard, pack(flat[i:j])) for b, i, j in zip(names, cut, cut[1:])])])

    def remove(t: pa.Table) -> pa.Table:
        _, block, vocab, replies, p = passages_of(t)
        change = np.zeros(len(block.ids) + 1, np.int32)
        if len(p.count):
            state = np.concatenate([unpack(replies[REPLY + 1][s])[0] for s, _, _ in p.by_shard(n_shards)])
            begin, count = np.cumsum(p.count) - p.count, p.count[p.kind]
            passage = np.repeat(np.arange(len(p.kind)), count)
            place = np.arange(len(passage)) - np.repeat(np.cumsum(count) - count, count)
            said = state[begin[p.kind[passage]] + place]
            goes = (said == BEFORE) | ((said == FIRST) & (p.doc > p.low[p.kind])[passage])
            start = (p.start[passage] + place)[goes]
            np.add.at(change, start, 1)
            np.add.at(change, start + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        starts = block.starts()
        kept = [
            b" ".join([vocab[i] for i in block.ids[a:b][~gone[a:b]].tolist()]).decode("utf-8", "surrogatepass")
            for a, b in zip(starts, starts[1:])
        ]
        removed = np.concatenate([[0], np.cumsum(gone)])[starts]
        return pa.table({
            "doc_id": block.ids_array(),
            "n_words": pa.array(block.lengths, pa.int64()),
            "n_removed": pa.array(np.diff(removed).astype(np.int64)),
            "kept": pa.array(kept, pa.string()),
        })

    sent = materialize(source.mapInArrow(encode, PACKET_SCHEMA), "phrases")
    held = sent.where(F.col("kind") == DOCS)
    known = materialize(grouped(sent.where(F.col("kind") == QUERY), "shard", n_shards).applyInArrow(trimmed(recur), PACKET_SCHEMA), "seeds")
    asked = grouped(held.union(known), "block", n_shards).applyInArrow(trimmed(ask), PACKET_SCHEMA)
    answers = grouped(asked, "shard", n_shards).applyInArrow(trimmed(confirm), PACKET_SCHEMA)
    return grouped(held.union(known).union(answers), "block", n_shards).applyInArrow(trimmed(remove), "doc_id long, n_words long, n_removed long, kept string")


def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    first: dict[tuple, int] = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def oracle() -> str:
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
own AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT win.doc_id, unnest(range(i, i + {WINDOW})) AS j FROM win JOIN own USING (k) WHERE o < win.doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)"""
