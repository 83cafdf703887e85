"""Placement by a permutation-filled lookup table (operator 10).

Every shard owns a permutation of the slots of a prime-sized table; the shards take turns claiming
the next free slot of theirs until the table is full. A document's slot is a hash of its key modulo the
table's size, so placing it is one look into a broadcast table, and adding or removing a shard moves few
documents beyond those that must move.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Place in ``shards`` of the owner of each slot. ``size`` is a prime, at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime not below the number of shards")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its md5 modulo the size; a null key counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: list[str] | None = None, size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """All columns and rows, with ``slot`` and ``shard``. The broadcast has ``size`` rows.

    Equal keys share a shard; a null key is placed as the empty text; columns named slot or shard are
    replaced. An empty table stays empty.
    """
    names = shards or [f"shard-{k:03d}" for k in range(SHARDS)]
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(names, size))), "slot int, owner int")
    table = table.select("slot", F.element_at(F.array(*map(F.lit, names)), F.col("owner") + 1).alias("shard"))
    keyed = docs.drop("slot", "shard").withColumn("slot", slot(F.col(key), size))
    return keyed.join(F.broadcast(table), "slot").select(*keyed.columns, "shard")


def write_shards(docs: DataFrame, path: str, files: int = 8, **options) -> None:
    """Write a folder per shard, up to ``files`` files each, so that no shard is one task's work."""
    placed = place(docs, **options)
    spread = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
