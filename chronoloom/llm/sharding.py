"""Placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: offset + j * skip, both
hashed from its name.  Shards take turns, in order of name, each claiming its first free slot, until
the table is full; slot counts differ by one at most, and a shard that leaves or joins moves few
slots but its own.  A key's hash picks a slot, hence its shard: one look-up in a table of fixed size,
which is broadcast (SLOTS rows, whatever the data).

Defined results: a null key has slot and shard null; equal keys share a shard; repeated rows each have
a row; no shards is an error; repeated shard names count once; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, well above a hundred slots for each shard.
SLOTS = 65537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index into the sorted distinct shards of each slot."""
    names = sorted(set(shards))
    if not names or len(names) > slots:
        raise ValueError("there must be a shard, and no more shards than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    hashed = [hashlib.sha256(s.encode()).digest() for s in names]
    offset = [int.from_bytes(h[:8]) % slots for h in hashed]
    skip = [int.from_bytes(h[8:16]) % (slots - 1) + 1 for h in hashed]
    table = np.full(slots, -1, dtype=np.int64)
    at, filled = [0] * len(names), 0
    while True:
        for k in range(len(names)):
            while table[slot := (offset[k] + at[k] * skip[k]) % slots] >= 0:
                at[k] += 1
            table[slot] = k
            at[k] += 1
            filled += 1
            if filled == slots:
                return table.tolist()


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with columns slot and shard."""
    names = sorted(set(shards))
    table = rows.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    hashed = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slots)).cast("int"))
    return rows.drop("slot", "shard").withColumn("slot", hashed).join(F.broadcast(table), "slot", "left").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")
