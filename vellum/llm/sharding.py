"""Permutation-filled lookup table for shard placement (DataFrame functions only on the rows)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import without

TABLE_SIZE = 65537  # a prime; 256 slots or more for each of up to 256 shards
MAX_TABLE = 4_194_301  # the table is a broadcast of this many (slot, shard) rows at most


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """slot -> index into `shards`.

    Every shard has a preference order over all slots, `offset + k * skip`
    modulo the prime `size`; shards take turns claiming their most preferred
    free slot until none is left, so that no two shards differ by more than one
    slot and a shard that goes leaves most of the others' slots alone.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime between the number of shards and {MAX_TABLE}")
    where = [_digest(f"{s}/offset") % size for s in shards]
    skip = [_digest(f"{s}/skip") % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            if not free:
                break
            while owner[where[i]] >= 0:
                where[i] = (where[i] + skip[i]) % size
            owner[where[i]] = i
            free -= 1
    return owner


def key_slot(keys: Sequence[Column], size: int) -> Column:
    """Slot of a row: 60 bits of the md5 of its keys' text modulo the table size; a null key reads as `~`."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("~")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) with one row per slot; `size` bounds it, and so its broadcast."""
    owner = fill_table(shards, size)
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "owner"))
    names = F.array(*[F.lit(s) for s in shards])
    return slots.select(F.col("slot").cast("long").alias("slot"),
                        F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(df: DataFrame, shards: Sequence[str], keys: Sequence[str] = ("doc_id",), size: int = TABLE_SIZE) -> DataFrame:
    """`df` with `slot` and `shard` for every row, by a broadcast lookup and no shuffle.

    Equal keys share a shard; null keys are a key like any other, as are empty
    ones. A hot source does not matter as long as the keys tell its rows apart:
    key by document, not by source. Input columns slot and shard are replaced;
    repeated rows stay; an empty table gives an empty result.
    """
    df = without(df, "slot", "shard")
    look = lookup_table(df.sparkSession, shards, size).withColumnRenamed("slot", "__slot")
    slotted = df.withColumn("slot", key_slot([F.col(k) for k in keys], size))
    return slotted.join(F.broadcast(look), F.col("slot") == F.col("__slot")).select(*df.columns, "slot", "shard")


def write_shards(placed: DataFrame, path: str, tasks_per_shard: int = 8, spread_by: str = "doc_id") -> None:
    """Write a placed table as one folder per shard, `tasks_per_shard` writers each."""
    n = placed.select("shard").distinct().count() * tasks_per_shard
    salt = F.pmod(F.xxhash64(spread_by), F.lit(tasks_per_shard))
    placed.repartition(max(1, n), "shard", salt).write.partitionBy("shard").parquet(path)
