"""Placement of rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (offset and skip
from its name). The shards take turns, each claiming the first slot in its order that is still
free, until the table is full; slots per shard then differ by one at most, and a shard more or less
moves few of the others' slots. A row's key hashes to a slot: one look-up in a broadcast table of
``slots`` rows, whatever the number of rows or shards.

All of it is DataFrame and SQL functions; plain Python only writes the shards' parameters down.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import free_name

#: Prime; over a hundred slots for each of the shards keeps their shares within one per cent.
SLOTS = 4099


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def preferences(shards: list[str], slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(offset, skip, inverse of skip) of each shard's order: its j-th choice is offset + j * skip."""
    if len(set(shards)) < len(shards) or not shards:
        raise ValueError("shards need different names, one at least")
    if slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    out = []
    for name in shards:
        skip = _number(f"skip:{name}") % (slots - 1) + 1
        out.append((_number(f"offset:{name}") % slots, skip, pow(skip, -1, slots)))
    return out


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard_no): the filled table, ``slots`` rows.

    The place of a slot in a shard's order is (slot - offset) / skip modulo the prime, so a turn
    is the least place among the slots still free.
    """
    made = ", ".join(f"named_struct('o', {o}L, 's', {s}L, 'i', {i}L)" for o, s, i in preferences(shards, slots))
    n = len(shards)
    turn = f"element_at(p, cast(t % {n} as int) + 1)"
    return spark.sql(f"""
        SELECT slot, CAST(turn % {n} AS INT) AS shard_no FROM (
          SELECT posexplode(aggregate(
            sequence(0L, {slots - 1}L),
            named_struct('free', sequence(0L, {slots - 1}L), 'taken', CAST(array() AS ARRAY<BIGINT>)),
            (done, t) -> element_at(transform(array(
                pmod({turn}.o + {turn}.s * array_min(transform(done.free,
                  x -> pmod((x - {turn}.o) * {turn}.i, {slots}L))), {slots}L)),
              slot -> named_struct('free', array_remove(done.free, slot),
                                   'taken', array_append(done.taken, slot))), 1),
            done -> done.taken)) AS (turn, slot)
          FROM (SELECT array({made}) AS p))""")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 15 hex digits of the MD5 of its text; a null key counts as ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for every row of ``df``; rows are neither moved nor merged.

    Equal keys share a shard, null keys that of the empty text. Other columns are not read; an
    empty table gives an empty result. Take a key of the row, not of a group, where a group can
    be large.
    """
    names = F.array(*[F.lit(s) for s in shards])
    # The table's rows are its slots, a parameter: the broadcast cannot grow with the data.
    table = F.broadcast(lookup_table(df.sparkSession, shards, slots))
    rows = df.select(F.col(key_col).alias("key")).withColumn("slot", slot_of(F.col("key"), slots))
    return rows.join(table, "slot").select("key", "slot", F.element_at(names, F.col("shard_no") + 1).alias("shard"))


def write_shards(df: DataFrame, key_col: str, shards: list[str], path: str, files: int = 1, slots: int = SLOTS) -> None:
    """Write ``df`` below ``path``, a folder ``shard=...`` each, in about ``files`` files a shard.

    Rows with equal keys, null ones too, share a shard and a file; repeated rows are all written. An empty table writes no shard. A
    column named shard is refused; other columns keep their names, whatever they are.
    """
    if "shard" in {c.lower() for c in df.columns}:
        raise ValueError("df has a column named shard")
    slot, number = free_name(df, "slot"), free_name(df, "shard_no")
    table = F.broadcast(lookup_table(df.sparkSession, shards, slots).withColumnsRenamed({"slot": slot, "shard_no": number}))
    names = F.array(*[F.lit(s) for s in shards])
    rows = df.join(table, slot_of(F.col(key_col), slots) == F.col(slot))
    rows = rows.withColumn("shard", F.element_at(names, F.col(number) + 1)).drop(slot, number)
    salt = F.pmod(F.xxhash64(F.col(key_col)), F.lit(files))
    rows.repartition(len(shards) * files, "shard", salt).write.partitionBy("shard").parquet(path)
