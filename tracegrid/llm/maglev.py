"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in its own order (an offset
and a step hashed from its name). The shards take turns claiming their next
free slot until the table is full, so each holds nearly the same number of
slots, and a change of shards moves few of them. The table has a fixed size
and is broadcast; a key's shard is one lookup of its hash modulo the size.

Null keys hash like any value and all go to one shard. Repeated keys go where
the first one goes. An empty table of keys gives no rows; no shards is an error.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The number of the shard that holds each slot; ``size`` is a prime over the number of shards."""
    if not shards or len(set(shards)) < len(shards) or size <= len(shards):
        raise ValueError("shards need distinct names and more slots than shards")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    digest = lambda s, seed: xxhash.xxh64_intdigest(s.encode(), seed=seed)
    at = [digest(s, 1) % size for s in shards]
    step = [digest(s, 2) % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int64)
    left = size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def place(spark: SparkSession, df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with slot and shard of each row's key, replacing columns of those names."""
    names = [(int(i), shards[k]) for i, k in enumerate(lookup_table(shards, size))]
    slots = spark.createDataFrame(names, "slot long, shard string")
    df = df.drop("shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(size)))
    return df.join(F.broadcast(slots), "slot")  # `size` rows, whatever the data's size
