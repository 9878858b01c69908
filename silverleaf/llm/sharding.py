"""Sharding through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (an
offset and a step, both from its name). Shards take turns, each claiming the next slot
of its order that is still free, until the table is full; shares differ by one slot at
most, and when shards come or go few slots change hands. A row's slot is a hash of its
key; its shard is one look-up in the table, which is broadcast: its size is the
table_size parameter, whatever the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, TABLE_SIZE = 32, 3203
#: Hexadecimal digits of a digest that make a number.
DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(names: list[str], size: int) -> list[int]:
    """The shard (its place in names) that holds each slot; size must be prime."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, at least one")
    if size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime, not below the number of shards")
    order = [(_number(f"{n}/offset") % size, _number(f"{n}/step") % (size - 1) + 1) for n in names]
    at, table = [0] * len(names), [-1] * size
    for turn in range(size):
        s = turn % len(names)
        offset, step = order[s]
        while table[(offset + at[s] * step) % size] >= 0:
            at[s] += 1
        table[(offset + at[s] * step) % size] = s
    return table


def lookup_table(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """(slot, shard), one row for each slot."""
    slots = F.split(F.lit(",".join(map(str, fill(names, size)))), ",").cast("array<long>")
    return spark.range(1).select(F.posexplode(slots).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), "shard")


def shard_names(count: int) -> list[str]:
    return [f"shard-{k}" for k in range(count)]


def slot_of(key: Column, size: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long") % size


def place(docs: DataFrame, names: list[str] | None = None, size: int = TABLE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, shard) of every row; rows never move.

    The key is the id; rows without an id are keyed by their text (null: empty), so they
    spread as well. Equal keys, and so repeated rows, share a shard; an empty table stays
    empty; other columns of docs are not read.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), slot_of(key, size).alias("slot"))
    table = lookup_table(docs.sparkSession, shard_names(SHARDS) if names is None else names, size)
    return rows.join(F.broadcast(table), "slot").select("id", "slot", "shard")


ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
    SELECT range AS s,
           ('0x' || substr(md5('shard-' || range || '/offset'), 1, {DIGITS}))::BIGINT % {TABLE_SIZE} AS o,
           ('0x' || substr(md5('shard-' || range || '/step'), 1, {DIGITS}))::BIGINT % {TABLE_SIZE - 1} + 1 AS d
    FROM range({SHARDS})
), fill AS (
    SELECT 0::BIGINT AS turn, list_transform(range({TABLE_SIZE}), lambda x: -1::BIGINT) AS slots
    UNION ALL
    SELECT turn + 1, slots[:p] || [s] || slots[p + 2:]
    FROM (
        SELECT f.turn, f.slots, h.s,
               (h.o + list_filter(range({TABLE_SIZE}), lambda j: f.slots[(h.o + j * h.d) % {TABLE_SIZE} + 1] = -1)[1] * h.d) % {TABLE_SIZE} AS p
        FROM fill f JOIN shards h ON h.s = f.turn % {SHARDS}
        WHERE f.turn < {TABLE_SIZE}
    )
), filled AS (
    SELECT slots FROM fill WHERE turn = {TABLE_SIZE}
), placed AS (
    SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, {DIGITS}))::BIGINT % {TABLE_SIZE} AS slot
    FROM documents
)
SELECT doc_id, slot, slots[slot + 1] AS shard FROM placed, filled
"""
