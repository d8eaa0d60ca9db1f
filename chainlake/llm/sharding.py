"""Sharding by a permutation-filled lookup table (Maglev hashing).

Every shard orders the slots of a table of prime size by its own permutation,
``(offset + j * skip) mod size``; the shards take turns, each claiming its
next free slot, until the table is full. A row's key hashes to a slot, the
table names the shard: constant time, shards even to within one slot, and
only few keys move when a shard joins or leaves.

The table has a fixed size, so it is broadcast; placement is a map over the
rows in DataFrame functions only, without a shuffle. Hashes are md5, so that
other systems can compute the same placement.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col_of, indexed

SIZE = 65537  # prime
SHARDS = 64


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def number(name: str) -> int:
    """The first 60 bits of a string's md5."""
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """``table[slot]`` = index of the shard that holds the slot."""
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("one to `size` different shards are needed")
    if any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [number("offset " + s) % size for s in shards]
    skip = [number("skip " + s) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """``(slot, shard)``: the lookup table as a DataFrame of ``size`` rows."""
    filled = ",".join(map(str, lookup_table(shards, size)))
    named = F.split(F.lit(",".join(shards)), ",")
    return (spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "i"))
            .select("slot", F.element_at(named, F.col("i").cast("int") + 1).alias("shard")))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key (a string column): 60 bits of md5 modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, shards: list[str] | None = None, key: str = "doc_id", spread: str | None = "n_chars",
          size: int = SIZE) -> DataFrame:
    """``rows`` with two more columns at the end, ``slot`` and ``shard``.

    Rows with the same key meet in one shard. A null key is no key: such rows
    are spread by the column ``spread`` (if given and present), so that many
    of them don't fill one shard. Columns of ``rows`` that are themselves named
    slot or shard stay as they are, in their places. Repeated rows go to the
    same shard; an empty table gives no rows."""
    shards = shards or shard_names()
    if any("," in s for s in shards):
        raise ValueError("shard names hold no comma")
    src = indexed(rows)
    spare = F.coalesce(col_of(rows, spread).cast("string"), F.lit("")) if spread in rows.columns else F.lit("")
    k = F.coalesce(col_of(rows, key).cast("string"), F.concat(F.lit("null "), spare))
    table = F.broadcast(table_frame(rows.sparkSession, shards, size).toDF("_slot", "_shard"))
    out = src.withColumn("_slot", slot_of(k, size)).join(table, "_slot")
    n = len(rows.columns)
    return out.select(*[f"_c{i}" for i in range(n)], "_slot", "_shard").toDF(*rows.columns, "slot", "shard")


def write_shards(rows: DataFrame, path: str, shards: list[str] | None = None, key: str = "doc_id",
                 spread: str | None = "n_chars") -> None:
    """Write ``rows`` as Parquet in one folder per shard. Spark rebalances the
    rows by shard and splits shards that are large, so no task holds a whole
    shard."""
    placed = place(rows, shards, key, spread)
    placed.drop("slot").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def placement_sql(shards: list[str] | None = None, size: int = SIZE) -> str:
    """The placement of ``documents`` in DuckDB SQL, over the same table."""
    shards = shards or shard_names()
    filled = ",".join(map(str, lookup_table(shards, size)))
    return f"""
    WITH k AS (
      SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR),
             'null ' || coalesce(CAST(n_chars AS VARCHAR), ''))), 1, 15)) AS BIGINT) % {size} AS slot
      FROM documents),
    t AS (SELECT CAST('[{filled}]' AS INTEGER[]) AS filled)
    SELECT doc_id, CAST(slot AS INTEGER) AS slot,
           'shard-' || lpad(CAST(filled[slot + 1] AS VARCHAR), 3, '0') AS shard
    FROM k, t"""
