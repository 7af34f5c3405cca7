"""Consistent placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, about a thousand for each of some dozens of shards.
SLOTS = 65_537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot.

    Each shard prefers the slots in an order of its own, offset + i * skip; in turns, each claims
    the first slot it likes that is still free. Shards differ by at most one slot; when one goes,
    few slots change hands among the others.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots has to be prime")
    draw = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in draw]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in draw]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key of any type; null keys take slot 0."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % slots, F.lit(0)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows with slot and shard, through a broadcast of the table, whose size is slots rows. Equal keys meet; no shuffle.

    Columns of these names are replaced. Null keys go to the shard of slot 0.
    """
    spark: SparkSession = df.sparkSession
    names = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(names), "slot")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """Write the rows by shard; a task writes one file for each shard it meets, with no shuffle, so a hot key stays spread."""
    place(df, key, shards, slots).write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Slot and shard, of 64, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes")), "doc_id", [f"shard-{i:03d}" for i in range(64)]).select("doc_id", "source", "n_bytes", "slot", "shard")
