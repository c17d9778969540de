"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose size is prime: it
starts at ``offset`` and goes on by ``skip``, both from a hash of its name. The shards take turns,
each claiming its next free slot, until the table is full. So all shards own nearly the same
number of slots, and taking a shard away moves few slots of the others. The table has a fixed size
whatever the data, is broadcast, and places a row by one look-up of its key's hash.

Defined cases: equal keys, and so repeated rows, go to one shard; a null key counts as empty; an
empty table gives no rows; other columns are kept, and the two new ones replace columns of the same
name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .common import spread, spread_sql, table

SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
#: prime, over a hundred slots for each shard
TABLE_SIZE = 4099


def lookup_table(shards, size):
    """The owner (index into ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size < len(shards) or size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime not below the number of shards")
    orders = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        offset = int.from_bytes(digest[:8], "big") % size
        skip = int.from_bytes(digest[8:], "big") % (size - 1) + 1
        orders.append([offset, skip])
    owner, left = [-1] * size, size
    while left:
        for shard, order in enumerate(orders):
            slot = order[0]
            while owner[slot] >= 0:
                slot = (slot + order[1]) % size
            owner[slot] = shard
            order[0] = (slot + order[1]) % size
            left -= 1
            if not left:
                break
    return owner


def place(df, key, shards=SHARDS, size=TABLE_SIZE):
    """``df`` with ``slot`` and ``shard`` of the column ``key``."""
    owner = lookup_table(shards, size)
    slots = df.sparkSession.createDataFrame(
        [(slot, shards[o]) for slot, o in enumerate(owner)], "slot long, shard string"
    )
    keyed = df.drop("shard").withColumn("slot", spread(F.col(key)) % size)
    return keyed.join(F.broadcast(slots), "slot", "left").select(*keyed.columns, "shard")


def write_shards(df, path, key, shards=SHARDS, size=TABLE_SIZE, files=8):
    """Write one folder a shard, each in up to ``files`` files, whatever single keys hold."""
    placed = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(*[c for c, t in placed.dtypes if not t.startswith("map")]), F.lit(files))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def op3_shard_placement(spark, sf_dir):
    """Slot and shard of every document."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op3_sql():
    owner = lookup_table(SHARDS, TABLE_SIZE)
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
SELECT doc_id, slot, ([{names}])[([{', '.join(map(str, owner))}])[slot + 1] + 1] AS shard
FROM (SELECT doc_id, {spread_sql('doc_id')} % {TABLE_SIZE} AS slot FROM documents)"""
