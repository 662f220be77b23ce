"""Operator 9: word language labels by a linear-chain conditional random field, documents by their words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import in_fold, slices, table
from engramlake.session import ship

#: Rows that the model is fitted on: those with the smallest hash among the training rows.
SAMPLE_ROWS = 1500
#: Characters of these rows together, and of one row at most.
SAMPLE_CHARS = 16 << 20
SAMPLE_ROW_CHARS = 1 << 20
N_BUCKETS = 1 << 17
EPOCHS = 12
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = 64
_FIT_WORDS = 60_000
_KNOWN_WORDS = 300_000
#: Words whose features are worked on at once in fitting.
_VOCAB_WORDS = 16_384
_M = np.uint64(0x9E3779B97F4A7C15)


def features(vocab: list[str], n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, flat, with offsets: the whole word (lexicon), prefixes and suffixes of one to
    four characters (affixes) and all runs of one to three characters (n-grams), bounded by ``^`` and ``$``."""
    text = "".join(f"^{w}$" for w in vocab)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocab], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(vocab)), size)
    place = np.arange(len(c)) - start[word]
    left = size[word] - place
    owner, code = [], []

    def add(kind: int, where: np.ndarray, h: np.ndarray):
        owner.append(word[where])
        x = (h[where] + np.uint64(kind)) * _M
        code.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(n_buckets - 1))

    h = c.copy()
    for n in range(1, 6):
        if n <= 3:
            add(n, left >= n, h)
        if n >= 2:
            add(10 + n, (place == 0) & (left >= n), h)
            add(20 + n, left == n, h)
        nxt = np.zeros_like(c)
        nxt[:-n] = c[n:] if n < len(c) else 0
        h = h * np.uint64(1000003) + nxt
    total = np.zeros(len(vocab), np.uint64)
    if len(c):
        total = np.add.reduceat(c * (_M ** (place % 60 + 1).astype(np.uint64) | np.uint64(1)), start[:-1])
    owner.append(np.arange(len(vocab)))
    x = total * _M
    code.append((x ^ (x >> np.uint64(31))) % np.uint64(n_buckets))
    owner, code = np.concatenate(owner), np.concatenate(code).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return code[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(vocab)))])


def emissions(weights: np.ndarray, vocab: list[str]) -> np.ndarray:
    if not vocab:
        return np.zeros((0, weights.shape[1]))
    code, off = features(vocab, len(weights))
    return np.add.reduceat(weights[code], off[:-1], axis=0) / np.diff(off)[:, None]


def marginals(emit: np.ndarray, begins: np.ndarray, trans: np.ndarray, init: np.ndarray, pair_sums: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Exact forward-backward over chains laid end to end.

    ``emit`` (n, K) are log potentials, ``begins`` flags the first word of each chain.  Returns the marginals, the
    summed pair marginals (K, K) and first-word marginals (both zero without ``pair_sums``) and the normaliser's
    logarithm.  The chain is cut into runs of ``_CHUNK`` words: products of their step matrices give the messages
    that enter each run, then all runs advance together."""
    n, k = emit.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros(k), 0.0
    runs = -(-n // _CHUNK)
    pad = runs * _CHUNK

    def by_step(flat: np.ndarray) -> np.ndarray:  # (step within the run, run, ...)
        return np.ascontiguousarray(flat.reshape(runs, _CHUNK, *flat.shape[1:]).swapaxes(0, 1))

    top = emit.max(1)
    potential = np.ones((pad, k))
    potential[:n] = np.exp(emit - top[:, None])
    e = by_step(potential)
    first = np.zeros(pad, bool)
    first[:n] = begins
    begin = [np.flatnonzero(f) for f in by_step(first)]
    inert = [np.flatnonzero(f) for f in by_step(np.arange(pad) >= n)]  # of the last run only
    t, i0 = np.exp(trans), np.exp(init)

    prod = np.broadcast_to(np.eye(k), (runs, k, k)).copy()  # alpha' = alpha @ prod over a run
    for c in range(_CHUNK):
        new = (prod.reshape(-1, k) @ t).reshape(runs, k, k) * e[c, :, None, :]
        at = begin[c]  # a first word forgets what came before
        new[at] = prod[at].sum(2, keepdims=True) * (i0 * e[c, at])[:, None, :]
        new[inert[c]] = prod[inert[c]]
        prod = new / new.sum((1, 2), keepdims=True)
    enter = np.empty((runs, k))
    a = np.full(k, 1.0 / k)
    for r in range(runs):
        enter[r] = a
        a = a @ prod[r]
        a /= a.sum()
    leave = np.empty((runs, k))
    b = np.ones(k)
    for r in range(runs - 1, -1, -1):
        leave[r] = b
        b = prod[r] @ b
        b /= b.sum()
    alpha, scale = np.empty((_CHUNK, runs, k)), np.empty((_CHUNK, runs))
    before = np.empty((_CHUNK, runs, k)) if pair_sums else None
    a = enter
    for c in range(_CHUNK):
        if pair_sums:
            before[c] = a
        new = (a @ t) * e[c]
        new[begin[c]] = i0 * e[c, begin[c]]
        new[inert[c]] = a[inert[c]]
        scale[c] = new.sum(1)
        a = alpha[c] = new / scale[c][:, None]
    pairs, firsts = np.zeros((k, k)), np.zeros(k)
    b = leave
    for c in range(_CHUNK - 1, -1, -1):
        g = alpha[c] * b
        g /= g.sum(1, keepdims=True)
        alpha[c] = g  # from here on the marginals
        eb = e[c] * b
        if pair_sums:
            inner = np.ones(runs, bool)
            inner[begin[c]] = inner[inert[c]] = False
            x = before[c, inner][:, :, None] * t[None] * eb[inner][:, None, :]
            pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
            firsts += g[begin[c]].sum(0)
        back = eb @ t.T
        back[begin[c]] = (i0 * eb[begin[c]]).sum(1, keepdims=True)
        back /= back.sum(1, keepdims=True)
        back[inert[c]] = b[inert[c]]
        b = back
    z = float(np.log(scale).sum() + top.sum())  # padding scales by 1
    return alpha.swapaxes(0, 1).reshape(pad, k)[:n], pairs, firsts, z


def _lettered(text: str | None) -> list[str]:
    """The words of a text, none if it has no letter (signs such as raised digits alone are no letters)."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, init: np.ndarray):
        self.labels, self.weights, self.trans, self.init = labels, weights, trans, init
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], n_buckets: int = N_BUCKETS, epochs: int = EPOCHS, rate: float = 0.5, l2: float = 1e-6) -> Crf:
        """Maximum likelihood by AdaGrad.  A row labels all its words.  Chains hold the lines of several rows, dealt
        in turn, so that label changes between neighbours occur and the transitions are learned from them."""
        labels = sorted({lang for lang, _ in rows})
        index = {x: i for i, x in enumerate(labels)}
        k = len(labels)
        seen_as: dict[str, int] = {}
        lines = []  # words by number at once: a string for each word of the sample would fill the driver
        for i, (lang, text) in enumerate(rows):
            for j, line in enumerate((text or "").split("\n")):
                if found := _WORD.findall(line.lower()):
                    lines.append((j, i, index[lang], np.array([seen_as.setdefault(w, len(seen_as)) for w in found], np.int32)))
        lines.sort(key=lambda x: x[:2])  # first lines of all rows, then second lines ...
        weights, trans, init = np.zeros((n_buckets, k)), np.zeros((k, k)), np.zeros(k)
        if not lines or k < 2:
            return cls(labels, weights, trans, init)
        size = np.array([len(x) for *_, x in lines])
        ids = np.concatenate([x for *_, x in lines])
        gold = np.repeat(np.array([lang for _, _, lang, _ in lines], np.int32), size)
        begins = np.zeros(len(ids), bool)
        begins[(np.cumsum(size) - size)[::16]] = True
        del lines
        order = np.argsort(np.unique(ids, return_index=True)[1])  # words by first place
        words = list(seen_as)
        vocab = [words[i] for i in order.tolist()]
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        ids = number[ids]
        del seen_as, words
        cuts = [*range(0, len(vocab), _VOCAB_WORDS), len(vocab)]
        slabs = [features(vocab[a:b], n_buckets) for a, b in zip(cuts, cuts[1:])]
        slabs = [(c.astype(np.int32), o) for c, o in slabs]
        code = np.concatenate([c for c, _ in slabs])
        width = np.concatenate([np.diff(o) for _, o in slabs])
        share = 1.0 / width
        word = np.repeat(np.arange(len(vocab), dtype=np.int32), width)
        seen = np.zeros((len(vocab), k))
        np.add.at(seen, (ids, gold), 1)
        inner = ~begins[1:]
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (gold[:-1][inner], gold[1:][inner]), 1)
        gold_first = np.bincount(gold[begins], minlength=k)
        acc = [np.full_like(x, 1e-8) for x in (weights, trans, init)]
        starts = np.flatnonzero(begins)
        runs = [*starts[np.searchsorted(starts, np.arange(0, len(ids), _FIT_WORDS))[: -(-len(ids) // _FIT_WORDS)].clip(max=len(starts) - 1)], len(ids)]
        runs = sorted(set(runs))
        for _ in range(epochs):
            emit = np.concatenate([np.add.reduceat(weights[c], o[:-1], axis=0) for c, o in slabs]) * share[:, None]
            expected, pairs, firsts = np.zeros((len(vocab), k)), np.zeros((k, k)), np.zeros(k)
            for a, b in zip(runs, runs[1:]):  # whole chains, a bounded number of words at a time
                gamma, p, f, _ = marginals(emit[ids[a:b]], begins[a:b], trans, init)
                expected += np.stack([np.bincount(ids[a:b], gamma[:, j], len(vocab)) for j in range(k)], 1)
                pairs, firsts = pairs + p, firsts + f
            d = (seen - expected) * share[:, None] / len(ids)
            grads = [
                np.stack([np.bincount(code, d[word, j], n_buckets) for j in range(k)], 1) - l2 * weights,
                (gold_pairs - pairs) / len(ids) - l2 * trans,
                (gold_first - firsts) / max(1, begins.sum()) - l2 * init,
            ]
            for x, g, a in zip((weights, trans, init), grads, acc):
                a += g * g
                x += rate * g / np.sqrt(a)
        return cls(labels, weights.astype(np.float32), trans, init)

    def __getstate__(self):
        return self.labels, self.weights, self.trans, self.init

    def __setstate__(self, state):
        self.__init__(*state)

    def _emit(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words' potentials; those of recent words are kept, up to a fixed number."""
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if len(self.known) + len(new) > _KNOWN_WORDS:
            self.known, self.rows = {}, np.zeros((0, len(self.labels)))
            new = list(dict.fromkeys(flat))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.concatenate([self.rows, emissions(self.weights, new)])
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), self.rows

    def label_words(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, their number, and the label marginals of all words, text after text."""
        found = [_lettered(t) for t in texts]
        flat = list(chain.from_iterable(found))
        ids, emit = self._emit(flat)
        size = np.array([len(f) for f in found], np.int64)
        begins = np.zeros(len(ids), bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        gamma = marginals(emit[ids], begins, self.trans, self.init, pair_sums=False)[0]
        return found, size, gamma

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The label with the largest mean marginal over the text's words, and that mean."""
        if not self.labels:
            return [(UNDETERMINED, 0.0)] * len(texts)
        _, size, gamma = self.label_words(texts)
        doc = np.repeat(np.arange(len(size)), size)
        total = np.stack([np.bincount(doc, gamma[:, j], len(size)) for j in range(gamma.shape[1])], 1)
        score = np.clip(total.max(1) / np.maximum(size, 1), 0.0, 1.0)
        return [(self.labels[j], x) if n else (UNDETERMINED, 0.0) for n, j, x in zip(size, total.argmax(1).tolist(), score.tolist())]


def sample_rows(docs: DataFrame, doc_col: str, text_col: str, lang_col: str, limit: int, chars: int) -> list[tuple[str, str]]:
    """At most ``limit`` labelled rows of ``chars`` characters together, those with the smallest hash of id and text among
    the rows of at most ``SAMPLE_ROW_CHARS`` characters: a fixed sample that does not depend on the order of the rows.
    Lengths come first, texts for those chosen.  A cut on the hash leaves a few times ``limit`` rows to sort, so that
    tasks send little, whatever their number; it is widened should too few pass."""
    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(doc_col).cast("string"), F.col(text_col)).alias("h"))
    rows = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_ROW_CHARS))
    total, share = rows.count(), 2.0 * limit
    while True:
        part = rows if share >= total else rows.where(F.col("h") < int(-(2**63) + 2**64 * (share / total)))
        found = part.select("h", F.length("text").alias("n")).orderBy("h", "n").limit(limit).collect()
        if share >= total or len(found) == limit:
            break
        share *= 4
    held, last = 0, None
    for r in found:
        held += r["n"]
        if held > chars and last is not None:
            break
        last = r["h"]
    if last is None:
        return []
    chosen = rows.where(F.col("h") <= F.lit(last)).orderBy("h", "lang", "text").limit(limit).collect()
    return [(r["lang"], r["text"]) for r in chosen]


def fit(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Crf:
    """``sample`` and ``chars`` bound the labelled rows the model is fitted on; whole texts of those rows are used."""
    return Crf.fit(sample_rows(docs, doc_col, text_col, lang_col, sample, chars))


def judge(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, named c0, c1 ... by their places, with lang_pred and score as in :func:`predict`."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(names, docs.schema)) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at], 2 << 20):
            said = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.toDF(*names).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Crf, doc_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row: ``doc_col``, the columns of ``keep``, lang_pred and score (0 to 1).

    ``und`` with score 0 for a null text, one without letters, or a model without labels.  Every word of a text
    counts; ties go to the label that sorts first; repeated rows are predicted alike; other columns are ignored;
    a kept column may have the name of a result, which then stands behind it.  The model is broadcast; its size is
    fixed by its number of buckets and labels.
    """
    names = list(dict.fromkeys((doc_col, *keep)))
    found = judge(docs.select(*names, F.col(text_col).alias("__text")), model, "__text")
    return found.drop(f"c{len(names)}").toDF(*names, "lang_pred", "score")


def known_documents(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined, columns unchanged; without labels to learn from, those with a
    letter."""
    found = judge(docs, model, text_col)
    lettered = F.col("lang_pred") != UNDETERMINED if model.labels else F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit("")).rlike(r"\p{L}")
    return found.where(lettered).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 3, 1))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("held_out",))
