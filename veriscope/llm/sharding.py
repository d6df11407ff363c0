"""Shard placement by a permutation-filled lookup table of prime size.

Each shard has its own order of preference over the slots; shards take turns,
each claiming the first free slot in its order, until the table is full.  A
key's slot is its hash modulo the table's size, so placement is one look into
a table whose size is a parameter, broadcast with every task.  Shares differ
by one slot at most, and a shard that comes or goes moves few keys besides
its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, restored

SLOTS = 6553
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of each slot's shard.

    The preference order of a shard starts at hash(name:offset) and steps by
    hash(name:skip), which visits every slot as ``slots`` is prime.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each by its own name")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number, no less than there are shards")
    at = [_hash(f"{s}:offset") % slots for s in shards]
    step = [_hash(f"{s}:skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key (a null key has slot 0), the same in any engine with MD5."""
    text = F.md5(key.cast("string").cast("binary"))
    return F.coalesce(F.conv(F.substring(text, 1, 15), 16, 10).cast("long") % slots, F.lit(0))


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the filled table: ``slots`` rows."""
    rows = [(i, shards[s]) for i, s in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard string")


def place(rows: DataFrame, key: Column, shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``rows`` with the slot and the shard of ``key``.

    The broadcast is ``slots`` rows, whatever the input.  All rows stay: a
    null key goes to slot 0, equal keys to one shard, repeated rows each.
    Columns already named like the two added are replaced.
    """
    names, cols = carried(rows, slot_col, shard_col)
    table = lookup_table(rows.sparkSession, shards, slots)
    keyed = rows.select(*cols, slot_of(key, slots).alias("slot")).join(F.broadcast(table), "slot")
    return keyed.select(*restored(names), F.col("slot").alias(slot_col), F.col("shard").alias(shard_col))


def write_shards(
    rows: DataFrame, key: Column, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, split: Column | None = None, files: int = 8, shard_col: str = "shard"
) -> None:
    """Write one folder a shard, each of ``files`` files at most.

    A shard's rows are dealt to its files by ``split``, or without it by the
    partition that they come from, so that no task writes a hot shard alone,
    were all its rows alike, and a task that is repeated deals them as before.
    A column of ``rows`` named like ``shard_col`` is replaced.
    """
    names, cols = carried(rows, shard_col)
    n = len(shards)
    deal = F.pmod(split if split is not None else F.spark_partition_id(), F.lit(files))
    keyed = rows.select(*cols, slot_of(key, slots).alias("slot"), deal.alias("file"))
    placed = keyed.join(F.broadcast(lookup_table(rows.sparkSession, shards, slots)), "slot")
    dealt = placed.repartition(n * files, "shard", "file")
    dealt.select(*restored(names), F.col("shard").alias(shard_col)).write.partitionBy(shard_col).parquet(path)
