"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order of the table's slots: offset + j * skip modulo a prime, both from hashes of
its name. Shards take turns claiming their next free slot until the table is full, so shares differ by at most
one slot, and adding or removing a shard moves few slots besides its own. The table's size is fixed by the
caller, not by the data, so it is broadcast; a row's place is one hash and one look-up.

Defined results: a null key has the hash of no value (Spark's seed) and so a slot like any other; equal keys share a
shard; an empty table gives no rows; the input's columns stay, and clashing result names raise.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

#: A prime much larger than the number of shards.
SLOTS = 65_537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows with `slot` and `shard` added."""
    if {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError("the input has a column named slot or shard")
    table = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))]
    return df.withColumn("slot", slot(F.col(key), slots)).join(F.broadcast(df.sparkSession.createDataFrame(table, "slot int, shard string")), "slot").select(*columns(df), "slot", "shard")


def write(placed: DataFrame, path: str, files_each: int = 8) -> None:
    """Parquet by shard, each shard's rows spread over `files_each` tasks, so that a hot shard isn't one task's."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files_each))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
