"""What the training-data operators share: shared-folder tables, byte tokenisation and blocks.

A *block* is a run of documents of one input task, encoded with a vocabulary of its own.  Operators that
need corpus-wide facts about the items of a block (words, windows, n-grams) send each *distinct* item of the
block once to the shard that owns it and get one short answer back.  A hot item therefore costs one entry per
block, whatever share of the rows holds it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.lineage import cut

BLOCK_TEXT_BYTES = 12 << 20
BLOCK_MAX_WORDS = 1_000_000
SHARD_INPUT_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
NULL_ID = 128

PACKET_SCHEMA = "kind int, block long, shard int, data binary"
_PACKET = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
DOCS, QUERY, REPLY = 0, 1, 2

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


try:  # arrays of 8 MB and more get mappings of their own, which go back to the system when freed
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 8 << 20)
    _libc.mallopt(-1, 64 << 20)
except (OSError, AttributeError):
    _libc = None


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and several share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(fn):
    """A group function that gives its memory back."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return fn(t)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and the rows survive the loss of an executor."""
    return cut(df, label, "zstd")


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame) -> DataFrame:
    """``df``, stored first if the planner doesn't know its size."""
    return df if _estimate(df) < 1 << 60 else materialize(df, "input")


def shard_count(df: DataFrame, per_shard: int = SHARD_INPUT_BYTES, least: int = 24) -> int:
    """Shards in proportion to the planner's size estimate of ``df``, so that one shard stays the same size."""
    size = _estimate(df)
    return int(max(least, min(-(-size // per_shard), 1 << 22)))


def grouped(df: DataFrame, key: str, parts: int):
    """``df`` by ``key`` over a number of tasks that grows with the input, so that a task has few groups at any size."""
    return df.repartition(parts, key).groupBy(key)


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about ``size`` characters; no row is cut."""
    for batch in batches:
        start = total = 0
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        for i, n in enumerate(lengths.to_pylist()):
            total += n or 0
            if total >= size:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed buffer; wide numbers are stored byte plane by byte plane."""
    parts, heads = [], []
    for a in arrays:
        if isinstance(a, bytes):
            heads.append(("b", len(a)))
            parts.append(a)
        else:
            heads.append((a.dtype.str, len(a)))
            parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")
    head = ";".join(f"{d},{n}" for d, n in heads).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(parts))


def unpack(data: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for item in raw[4:at].decode().split(";"):
        kind, n = item.split(",")
        n = int(n)
        if kind == "b":
            out.append(raw[at : at + n])
            at += n
        else:
            dt = np.dtype(kind)
            size = n * dt.itemsize
            planes = np.frombuffer(raw, np.uint8, size, at).reshape(dt.itemsize, n)
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dt))
            at += size
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def undeltas(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def packets(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, block, shard, data = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())],
        schema=_PACKET,
    )


class Block:
    """Documents as ids of the block's own vocabulary."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, flags: np.ndarray):
        self.ids, self.lengths, self.doc_ids, self.flags = ids, lengths, doc_ids, flags

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)])

    def ids_array(self) -> pa.Array:
        return pa.array(self.doc_ids, mask=self.flags & NULL_ID > 0)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def pack(self) -> bytes:
        return pack(self.ids.astype(np.uint32), self.lengths.astype(np.int32), self.doc_ids, self.flags)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        ids, lengths, doc_ids, flags = unpack(data)
        return cls(ids.astype(np.int64), lengths.astype(np.int64), doc_ids, flags)


def blocks(batches: Iterator[pa.RecordBatch], split=words) -> Iterator[tuple[int, Block, list[bytes]]]:
    """(block id, block, vocabulary) over batches of (doc_id, text[, flag]); null ids become ``NO_ID`` with the flag ``NULL_ID``.
    Block ids follow from the task's partition, so a repeated task gives the same ones."""
    base = TaskContext.get().partitionId() << 24
    count = 0
    vocab: dict[bytes, int] = {}
    parts, lengths, ids, flags, size = [], [], [], [], 0

    def done():
        return Block(
            np.concatenate(parts) if parts else np.empty(0, np.int64),
            np.array(lengths, np.int64),
            np.array(ids, np.int64),
            np.array(flags, np.uint8),
        ), list(vocab)

    for batch in batches:
        cols = batch.to_pydict()
        flag = cols.get("flag") or [0] * batch.num_rows
        for doc, text, f in zip(cols["doc_id"], cols["text"], flag):
            found = split(text)
            put = vocab.setdefault
            parts.append(np.fromiter((put(w, len(vocab)) for w in found), np.int64, len(found)))
            lengths.append(len(found))
            ids.append(NO_ID if doc is None else doc)
            flags.append((f or 0) | (NULL_ID if doc is None else 0))
            size += len(text or "")
            if size >= BLOCK_TEXT_BYTES or len(vocab) >= BLOCK_MAX_WORDS:
                yield base + count, *done()
                count += 1
                vocab = {}
                parts, lengths, ids, flags, size = [], [], [], [], 0
                give_back()
    if lengths:
        yield base + count, *done()
    vocab, parts = {}, []
    give_back()


def by_shard(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) for 64-bit hashes; positions keep their order."""
    shard = (mix64(keys) % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
    for s in range(n_shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def first_of_runs(sorted_values: np.ndarray) -> np.ndarray:
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out
