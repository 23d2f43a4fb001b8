"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: offset + k * skip modulo the size. Shards take
turns, each claiming the first free slot of its order, until the table is full. A key goes to the shard in slot
hash(key) mod size, so placement is one lookup; a shard that leaves hands its slots to the others and moves few keys.

The fill runs on the driver over the table alone; its size is a parameter with a checked bound, which also bounds the
broadcast. Placement itself is DataFrame functions only, a hash and a broadcast equi-join, and shuffles nothing.

Keys: null and the empty string share the slot of the empty string. Repeated keys go to the same shard.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime, over a thousand slots a shard for 64 shards: loads within a tenth of a percent of each other.
SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: Slots up to which the table is broadcast; two integers each.
MOST_SLOTS = 1 << 22


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = SIZE) -> list[int]:
    """Shard index of each slot. The order of shards doesn't matter beyond who claims first."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _prime(size) or size < len(shards) or size > MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(f"offset {s}") % size for s in shards]
    skip = [_number(f"skip {s}") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % size
            table[slot] = i
            at[i] = (slot + skip[i]) % size
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The first 60 bits of the MD5 of the key's text, modulo size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def sharded(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row. df keeps all its columns; a new name that df has gets underscores until it is free."""
    taken = {c.lower() for c in df.columns}
    slot, shard = (_free(name, taken) for name in (slot, shard))
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, size))), "_slot int, _shard int")
    place, index = (_free(name, taken) for name in ("_slot", "_shard"))
    table = table.toDF(place, index)
    names = F.array(*[F.lit(s) for s in shards])
    hashed = df.withColumn(slot, slot_of(key, size).cast("int"))
    out = hashed.join(F.broadcast(table), F.col(slot) == F.col(place), "left")
    return out.withColumn(shard, F.get(names, F.col(index))).drop(place, index)


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    taken.add(name)
    return name
