"""Shard placement by a permutation-filled lookup table (native DataFrame operations only).

Every shard has its own preference order over the slots of a prime-sized table, made from two
hashes of its name (offset and skip).  The shards take turns; at its turn a shard claims the first
slot in its order that is still free.  A key is placed by one look into the broadcast table.  Shards
then hold equal shares of the slots (they differ by one at most), and adding or removing a shard moves few others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import own_name

#: Production parameters: a prime well above 100 slots a shard.
SHARDS = 64
TABLE_SIZE = 8191


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard index at each slot.  Its cost depends on ``size`` alone, not on any data."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime, so that every preference order visits every slot")
    if not names:
        raise ValueError("no shards")
    if len(set(names)) != len(names):
        raise ValueError("shard names must differ")
    digests = [hashlib.md5(x.encode()).hexdigest() for x in names]
    at = [int(d[:8], 16) % size for d in digests]
    skip = [int(d[8:16], 16) % (size - 1) + 1 for d in digests]
    table, free = [-1] * size, size
    while free:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as ``slot int, shard int``; it has ``size`` rows, so it may be broadcast at any input size."""
    text = ",".join(map(str, lookup_table(names, size)))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard"))
    return slots.select("slot", F.col("shard").cast("int").alias("shard"))


def assign_shards(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the slot and the shard index of each row.

    The slot is the first 32 bits of the md5 of the key as text, modulo the table size.  A null key
    counts as the empty text.  Rows that repeat a key get its shard, each; an empty input gives an empty
    result.  If ``docs`` already has columns of these names, they are replaced.
    """
    names = shard_names(SHARDS) if names is None else names
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    slot = own_name(docs, "slot_of_key")
    table = table_frame(docs.sparkSession, names, size).select(F.col("slot").alias(slot), F.col("shard").alias(f"{slot}_shard"))
    placed = docs.withColumn(slot, (h % size).cast("int")).join(F.broadcast(table), slot)
    rest = [c for c in docs.columns if c not in (slot_col, shard_col)]
    return placed.select(*[F.col(f"`{c}`") for c in rest], F.col(slot).alias(slot_col), F.col(f"{slot}_shard").alias(shard_col))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """Write one folder a shard.  Rows of a shard are dealt over ``files_per_shard`` tasks, so that a hot key does not fill one task."""
    placed = assign_shards(docs, key, names, size)
    salt = own_name(placed, "salt")
    placed.withColumn(salt, (F.rand(7) * files_per_shard).cast("int")).repartition("shard", salt).drop(salt, "slot").write.partitionBy("shard").parquet(path)


def op5_query(docs: DataFrame) -> DataFrame:
    return assign_shards(docs.select("doc_id")).select("doc_id", "slot", "shard")


def op5_sql(shards: int = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same table by a recursive query: each step is one turn of one shard."""
    return f"""
WITH RECURSIVE d AS (SELECT i, md5(printf('shard-%05d', i)) AS h FROM range({shards}) r(i)),
orders AS (SELECT list([CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {size}, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % {size - 1} + 1] ORDER BY i) AS o FROM d),
turns(t, slot, taken) AS (
  SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), list_transform(range(0, {size}), lambda x: false)
  UNION ALL
  SELECT t + 1, pick, list_concat(list_append(taken[:pick], true), taken[pick + 2:]) FROM (
    SELECT t, taken, list_filter(list_transform(range(0, {size}), lambda j: (o[(t + 1) % {shards} + 1][1] + j * o[(t + 1) % {shards} + 1][2]) % {size}), lambda s: NOT taken[s + 1])[1] AS pick
    FROM turns, orders WHERE t + 1 < {size}))
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(t % {shards} AS INTEGER) AS shard
FROM documents JOIN turns ON slot = CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {size}"""
