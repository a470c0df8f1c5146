"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a prime-sized table
(offset, then steps of a skip, both from a hash of its name). Shards take turns;
at its turn a shard claims the first slot of its order that is free. A document
goes to the shard that owns the slot of its hash. Slots differ by one at most
between shards, and adding or removing a shard moves few slots.

The table depends on names and size alone, never on rows; filled once on the
driver, it is broadcast and each row is placed by one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Production parameters: shards, and slots of the table (a prime, 256 times as many).
SHARDS, SLOTS = 256, 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(names: list[str], slots: int) -> list[int]:
    """Owner of each slot, as an index of names."""
    if not names or not _is_prime(slots) or slots < len(names) or len(set(names)) < len(names):
        raise ValueError("fill needs distinct names and a prime number of slots, not fewer than names")
    seed = [hashlib.sha256(x.encode()).digest() for x in names]
    at = [int.from_bytes(s[:8], "little") % slots for s in seed]
    skip = [int.from_bytes(s[8:16], "little") % (slots - 1) + 1 if slots > 2 else 1 for s in seed]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return owner


def shard(df: DataFrame, id_col: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns to keep, slot (int), shard (int, index of names).

    The key is the id as text; its slot is the first 60 bits of its MD5, modulo slots, so any engine can place it.
    Null ids count as the empty string; repeated rows go to one shard; an empty table gives an empty result; further
    columns are ignored. Columns to keep that are named slot or shard come out as input_slot and input_shard.
    """
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")).alias("slot", "shard"))
    table = F.broadcast(table.select("slot", F.col("shard").cast("int").alias("shard")))  # slots rows, whatever the input
    names_out = {c: c if c.lower() not in ("slot", "shard") else free_name(f"input_{c}", [id_col, *keep]) for c in keep}
    kept = [F.col(c).alias(names_out[c]) for c in keep]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")
    return df.select(F.col(id_col), *kept, slot.alias("slot")).join(table, "slot").select(id_col, *names_out.values(), "slot", "shard")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", parts: int = 4, **placing) -> None:
    """Writes df below path, one folder a shard with up to parts files."""
    placed = shard(df, id_col, keep=tuple(c for c in df.columns if c != id_col), **placing)
    n = len(placing.get("names") or range(SHARDS)) * parts
    salt = F.pmod(F.xxhash64(id_col), F.lit(parts))
    placed.drop("slot").repartition(n, "shard", salt).write.partitionBy("shard").mode("overwrite").parquet(path)


def oracle(names: list[str] | None = None, slots: int = SLOTS) -> str:
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    return f"""
    WITH owner AS (SELECT unnest(range({slots}))::INT AS slot, unnest([{','.join(map(str, fill(names, slots)))}])::INT AS shard),
    placed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots})::INT AS slot FROM documents)
    SELECT doc_id, slot, shard FROM placed JOIN owner USING (slot)"""
