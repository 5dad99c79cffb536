"""Shard placement through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size. The shards take turns: each claims the first slot of its order that is
still free, until the table is full, so their shares differ by one slot at most
and a shard more or less moves few other slots. Placing a key is one look-up.

Defined results: a null key is a key like any other and has one shard; equal keys
have equal shards; an empty table gives no rows; all input columns are kept, and
an input column that has the name of an output column is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime, and well over 100 slots a shard for the default of 128 shards. It bounds the broadcast.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_000_003


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's place in ``shards`` for every slot; ``size`` must be a prime, so each order meets every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be there and differ")
    if not len(shards) <= size <= MAX_TABLE_SIZE or any(size % p == 0 for p in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"table size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    at = [_digest(f"start {name}") % size for name in shards]
    step = [_digest(f"step {name}") % (size - 1) + 1 for name in shards]
    table, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: the first 60 bits of its text's digest, modulo the table's size."""
    text = F.concat(F.lit("k"), F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``. No shuffle: the table, of a fixed number of rows, is broadcast."""
    if {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError("the input has a column slot or shard already")
    spark = df.sparkSession
    claimed = ",".join(map(str, lookup_table(shards, size)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(claimed), ",")).alias("slot", "_shard"))
    names = F.array(*[F.lit(s) for s in shards])
    table = table.select("slot", names[F.col("_shard").cast("int")].alias("shard"))
    return df.withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot").select(
        *[df[c] for c in df.columns], "slot", "shard")
