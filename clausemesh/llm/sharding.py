"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: start + i * step modulo the size,
both from the hash of its name. Shards take turns; at its turn a shard claims the first free slot of its order. The
finished table is small and of fixed size, so it is broadcast, and a row's shard is found in constant time from the
hash of its key. When a shard goes, nearly all slots of the others stay where they were.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE, salt: str = "") -> list[int]:
    """For every slot the index of its shard. The size must be a prime above the number of shards, names must differ."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if size <= len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime above the number of shards")
    start = [_number(f"start{salt}:{name}") % size for name in shards]
    step = [_number(f"step{salt}:{name}") % (size - 1) + 1 for name in shards]
    place, taken, owner = start[:], 0, [-1] * size
    while True:
        for shard in range(len(shards)):
            at = place[shard]
            while owner[at] >= 0:
                at = (at + step[shard]) % size
            owner[at] = shard
            place[shard] = (at + step[shard]) % size
            taken += 1
            if taken == size:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 48 bits of the MD5 of its text, modulo the size. A null key has slot 0."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(size)), F.lit(0)).cast("int")


def assign_shards(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """The rows with their slot and shard. Rows of one key share a shard; equal rows do, too.

    Null keys go to slot 0. An empty frame gives an empty frame. Where df has a column of the same name as `slot` or
    `shard`, the new one gets a trailing underscore. No shuffle: the table's `size` rows are broadcast.
    """
    slot, shard = unused(df, slot, shard)
    [own] = unused(df.withColumns({slot: F.lit(0), shard: F.lit("")}), "_slot_of_table")
    rows = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))]
    table = df.sparkSession.createDataFrame(rows, f"`{own}` int, `{shard}` string")
    return df.withColumn(slot, slot_of(key, size)).join(F.broadcast(table), F.col(slot) == F.col(own)).drop(own)


def write_shards(df: DataFrame, key: Column, shards: list[str], path: str, size: int = TABLE_SIZE, pieces: int = 8) -> None:
    """Write a folder for each shard. Rows are spread by shard and a piece number, so a shard is never one task."""
    slot, shard = unused(df, "slot", "shard")
    out = assign_shards(df, key, shards, size, slot, shard)
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(pieces))
    out.repartition(F.col(shard), piece).drop(slot).write.partitionBy(shard).parquet(path)
