"""Operator 10: consistent sharding by a permutation-filled lookup table."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import table

N_SHARDS = 64
TABLE_SIZE = 6553
#: Slots of the largest table that is broadcast; at 12 bytes a slot this bounds the broadcast to 24 MB.
MAX_TABLE_SIZE = 2_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """Shards take turns; at each turn a shard claims the first free slot of its own permutation
    ``offset + j * skip (mod size)``.  Shard loads differ by one slot at most."""
    if not _is_prime(size) or size > MAX_TABLE_SIZE:
        raise ValueError(f"table size must be a prime of at most {MAX_TABLE_SIZE}, not {size}")
    if not 0 < len(shards) <= size:
        raise ValueError("there must be between 1 and table-size shards")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    at = [zlib.crc32(f"offset:{s}".encode()) % size for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % size
        owner[at[k]] = k
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def slot_of(key: Column, size: int) -> Column:
    """The first 15 hex digits of the key's MD5, modulo the table size; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """Columns ``key``, ``slot`` (long) and ``shard`` (int, index into ``shards``), a row for each row of ``df``.

    The table is a small relation of ``size`` rows, bounded by ``MAX_TABLE_SIZE``, and is broadcast: a row costs
    one hash and one array probe, and nothing is shuffled.  Equal keys share a shard; null and empty keys go
    where the empty text goes; other columns of ``df`` are ignored; a key named slot or shard stands before the
    result of that name.  An empty input gives no rows.
    """
    owner = lookup_table(shards or shard_names(N_SHARDS), size)
    entries = F.from_json(F.lit("[" + ",".join(map(str, owner)) + "]"), "array<int>")
    slots = df.sparkSession.range(1).select(F.posexplode(entries).alias("slot", "shard"))
    slots = slots.select(F.col("slot").cast("long").alias("slot"), "shard")
    keyed = df.select(F.col(key).alias("key"), slot_of(F.col(key), size).alias("slot"))
    return keyed.join(F.broadcast(slots), "slot").select("key", "slot", "shard").toDF(key, "slot", "shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))



def oracle() -> str:
    """SQL recomputes every row's slot and placement; the table is filled here anew, from whole preference lists."""
    names = [f"shard-{k:05d}" for k in range(N_SHARDS)]
    prefer = []
    for s in names:
        first, step = zlib.crc32(b"offset:" + s.encode()), zlib.crc32(b"skip:" + s.encode()) % (TABLE_SIZE - 1) + 1
        prefer.append([(first + j * step) % TABLE_SIZE for j in range(TABLE_SIZE)][::-1])
    taken: dict[int, int] = {}
    while len(taken) < TABLE_SIZE:
        for k, wish in enumerate(prefer):
            if len(taken) < TABLE_SIZE:
                while wish[-1] in taken:
                    wish.pop()
                taken[wish.pop()] = k
    owner = ",".join(str(taken[i]) for i in range(TABLE_SIZE))
    slot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE})"
    return f"SELECT doc_id, {slot} AS slot, ([{owner}])[{slot} + 1]::INTEGER AS shard FROM documents"
