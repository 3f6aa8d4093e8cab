"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order of all slots of a prime-sized table (offset and
step from hashes of its name). Shards take turns, each claiming its next free slot,
until the table is full. A row's slot is a hash of its key modulo the size, its
shard one look into the broadcast table. Shares differ by one slot at most, and
when a shard leaves or joins, few slots change between the others.

The table is built on the driver: its size is a parameter and does not grow with
the data (``size`` rows are broadcast).

Defined results: rows with a null key go to the slot of the null hash; equal keys go
to one shard; an empty table gives an empty result; a name given twice, no names or
a size that is not prime or too small is an error. Input columns named slot or shard
are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """Shard number of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names have to be distinct, at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the size has to be a prime, not below the number of shards")
    seeds = [hashlib.blake2b(s.encode(), digest_size=16).digest() for s in shards]
    place = [int.from_bytes(s[:8], "little") % size for s in seeds]
    step = [int.from_bytes(s[8:], "little") % (size - 1) + 1 for s in seeds]
    table = [-1] * size
    left = size
    while left:
        for shard in range(len(shards)):
            at = place[shard]
            while table[at] >= 0:
                at = (at + step[shard]) % size
            table[at] = shard
            place[shard] = (at + step[shard]) % size
            left -= 1
            if not left:
                break
    return np.array(table, dtype=np.int32)


def place(docs: DataFrame, shards: list[str], keys: tuple[str, ...] = ("doc_id",), size: int = SIZE) -> DataFrame:
    """``docs`` with slot and shard (name)."""
    spark = docs.sparkSession
    names = [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, size).tolist())]
    table = spark.createDataFrame(names, "slot int, shard string")
    kept = [c for c in docs.columns if c not in ("slot", "shard") or c in keys]
    slot = F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")
    renamed = table.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    found = docs.select(*kept, slot.alias("__slot")).join(F.broadcast(renamed), "__slot")
    return found.select(*[c for c in kept if c not in ("slot", "shard")], F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(placed: DataFrame, folder: str, files: int = 4) -> None:
    """One folder per shard, ``files`` files each, dealt by slot so that no shard is one task."""
    dealt = placed.withColumn("__file", F.pmod(F.xxhash64("slot"), F.lit(files)))
    dealt.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(folder)
