"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS places. Every shard owns the stretches that end at its virtual nodes; a document
hashes to a place. Documents arrive in the order of the ring (place, hash, doc_id): each goes to the
first shard clockwise that still has room. With the capacities of the `rows` law (the rounded-down
mean, one more for the first shards) all shards end full, so their counts differ by one at most.
The documents per place are all that the driver sees, SLOTS numbers for any input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.shared import text_key, without

SLOTS = 1 << 14
VIRTUAL_NODES = 64


def place(*parts: F.Column) -> F.Column:
    """48 hashed bits of the parts; the upper ones name the place on the ring."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("bigint")


def owners(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(node of each place, shard of each node): a node owns the places up to it, clockwise."""
    at = sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:12], 16) * slots >> 48, s, v) for s in range(n_shards) for v in range(virtual_nodes))
    places, shards = np.array([a[0] for a in at]), np.array([a[1] for a in at])
    return np.searchsorted(places, np.arange(slots)) % len(at), shards


def fill(counts: np.ndarray, node_of: np.ndarray, shard_of: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Segments (place, first rank, end rank, shard, load of the shard before): who takes which documents of a place."""
    room, load, out = room.astype(np.int64).copy(), np.zeros(len(room), np.int64), []
    after = (np.arange(len(shard_of)) + 1) % len(shard_of)  # from a full node to the next that may have room

    def with_room(node: int) -> int:
        passed = []
        while not room[shard_of[node]]:
            passed.append(node)
            node = int(after[node])
        after[passed] = node
        return node

    for p in np.flatnonzero(counts):
        rank, left = 0, int(counts[p])
        while left:
            shard = int(shard_of[with_room(int(node_of[p]))])
            take = min(left, int(room[shard]))
            out.append((int(p), rank, rank + take, shard, int(load[shard])))
            room[shard] -= take
            load[shard] += take
            rank, left = rank + take, left - take
    return out


def row_capacities(total: int, n_shards: int, slack: float = 0.0) -> np.ndarray:
    """Room of each shard: an even split, or ``1 + slack`` times the mean, rounded up, where slack is above 0."""
    if slack > 0:
        return np.full(n_shards, int(np.ceil(total / n_shards * (1 + slack))))
    return total // n_shards + (np.arange(n_shards) < total % n_shards)


def assign(docs: DataFrame, n_shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (0, 1, ... without a gap inside a shard), laid out by shard.

    ``slack`` 0 is the `rows` law: counts at most one apart. A larger one lets a shard hold
    ``1 + slack`` times the mean, which moves fewer documents when shards or documents change.
    The rows are dealt once, by ranges of (shard that owns the place, part of the place), and ranked
    there; a place whose documents spill to the next shard keeps its rows, only their shard differs.
    Rows that repeat a doc_id are spread by a hash of the text; full copies of a row are
    interchangeable. A null doc_id hashes as the empty text. An empty table gives an empty result.
    Columns of ``docs`` named shard or slot are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot").withColumn("__at", place(text_key("doc_id"), F.crc32(text_key("text")).cast("string")))
    docs = docs.withColumn("__place", F.shiftrightunsigned(F.col("__at") * slots, 48).cast("int"))
    counts = np.zeros(slots, np.int64)
    for row in docs.groupBy("__place").count().collect():  # at most `slots` rows
        counts[row[0]] = row[1]
    node_of, shard_of = owners(n_shards, virtual_nodes, slots)
    segments = fill(counts, node_of, shard_of, row_capacities(int(counts.sum()), n_shards, slack))
    first = {}
    for p, _, _, shard, _ in segments:
        first.setdefault(p, shard)
    plan = spark.createDataFrame([(*s, first[s[0]]) for s in segments], "__place int, __from bigint, __end bigint, shard int, __load bigint, __first int")
    # both tables have at most slots + shards rows, whatever the input
    homes = F.broadcast(plan.where("__from = 0").select("__place", "__first"))
    dealt = docs.join(homes, "__place").repartitionByRange("__first", "__place")
    inside = Window.partitionBy("__first", "__place").orderBy("__at", "doc_id", F.xxhash64(text_key("text")))
    dealt = dealt.withColumn("__rank", F.row_number().over(inside) - F.lit(1).cast("bigint"))
    plan = F.broadcast(plan.drop("__first"))
    out = dealt.join(plan, "__place").where("__rank >= __from AND __rank < __end")
    return out.withColumn("slot", F.col("__load") + F.col("__rank") - F.col("__from")).drop("__at", "__place", "__first", "__rank", "__from", "__end", "__load")


def write_shards(docs: DataFrame, path: str, n_shards: int, **how) -> DataFrame:
    """Write the assigned rows to ``path``, a folder per shard, and read them back."""
    assign(docs, n_shards, **how).write.partitionBy("shard").parquet(path)
    schema = without(docs, "shard", "slot").schema.add("slot", "long").add("shard", "integer")
    return docs.sparkSession.read.schema(schema).parquet(path)
