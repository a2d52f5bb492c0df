"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size M in its own order (offset, offset +
skip, offset + 2 skip, ... modulo M).  Shards take turns; at its turn a shard claims the
first slot of its order that is still free, until the table is full.  Every shard gets
M/N slots, one more or less, and when a shard joins or leaves few slots change hands.
A row's key picks a slot, the slot names the shard: the table is broadcast (M rows, fixed
by a parameter, not by the data), so placing needs no shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name

TABLE_SIZE = 65_537
LARGEST_TABLE = 5_000_011  # slots that may be broadcast


def _hash(text: str) -> int:
    """60 bits of the MD5 digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not is_prime(size) or size < len(shards) or size > LARGEST_TABLE:
        raise ValueError(f"the table size must be a prime between the number of shards and {LARGEST_TABLE}")
    at = [_hash(f"{s}:offset") % size for s in shards]
    skip = [1 + _hash(f"{s}:skip") % (size - 1) if size > 2 else 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(keys: list[Column], size: int) -> Column:
    """Slot of a row: 60 bits of the MD5 digest of its keys (as text, null marked, joined
    by a tab) modulo the table size."""
    text = F.concat_ws("\t", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(rows: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (columns of these names are replaced).  Equal keys
    share a shard; null keys have a slot of their own; an empty table stays empty."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill_table(shards, size))], "_slot int, _shard string")
    slot, shard = free_name(rows, "_slot"), free_name(rows, "_shard")
    table = table.toDF(slot, shard)
    placed = rows.withColumn("slot", slot_of([column(rows, k) for k in keys], size))
    return placed.join(F.broadcast(table), F.col("slot") == F.col(slot)).withColumn("shard", F.col(shard)).drop(slot, shard)


def write_shards(rows: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str], files_per_shard: int = 1, size: int = TABLE_SIZE) -> None:
    """Writes one folder per shard.  ``files_per_shard`` deals the rows of a shard to as many
    tasks, by a hash of the keys, so that no task holds a shard that has grown too large."""
    placed = place(rows, keys, shards, size)
    salt = F.pmod(F.xxhash64(*[column(placed, k) for k in keys]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
