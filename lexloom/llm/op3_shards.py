"""Shards of nearly equal bytes by minimax contiguous partition.

Rows of equal texts form one atomic group, which no cut divides. What the driver
orders is bounded at any size of input: groups above 1/HEAVY of a fair share by
themselves (at most shards * HEAVY of them), all smaller ones in BUNDLES bundles by
hash. Groups stand in an order that mixes sizes: heavy ones are dealt to piles,
largest first to the least full pile, and behind each pile's heavy groups stand as
many bundles as fill it to the common level.

Over that order the least feasible capacity is found by binary search with a
greedy check. The cuts keep it, and each lies as near to an equal share of what
is left as the capacity allows, so that no last shard runs short. A group larger
than its fair share ends up alone, and the others stay equal.

Heavy groups and bundles find their shard by broadcast maps, so no text, however
often repeated, is a key of a shuffle beyond the sum of its bytes. Slots are
counted in BINS hashed bins of a shard (offsets from bounded counts, then a row
number inside the bin), by a row key of their own, so neither a shard nor
repeated or null ids pass through one task.

Defined cases: a null text has no bytes and is in one group with empty texts;
repeated rows get slots of their own; fewer groups than shards leave shards
empty; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import materialize

OVERHEAD, BINS, HEAVY, BUNDLES = 16, 1024, 1024, 1 << 16


def arranged(heavy: np.ndarray, light: np.ndarray, shards: int) -> np.ndarray:
    """Places of the atoms in walking order: heavy ones count first, then light ones."""
    piles: list[tuple[int, int, list[int]]] = [(0, k, []) for k in range(shards)]
    for at in np.argsort(-heavy, kind="stable").tolist():
        load, k, held = piles[0]
        held.append(at)
        heapq.heapreplace(piles, (load + int(heavy[at]), k, held))
    piles.sort(key=lambda p: (-p[0], p[1]))
    # the level to which the light ones fill the piles
    loads, rest = [p[0] for p in piles], int(light.sum())
    k = next((k for k in range(shards) if (sum(loads[k:]) + rest) / (shards - k) >= loads[k]), shards - 1)
    level = (sum(loads[k:]) + rest) / (shards - k)
    middle, order, taken, filled = np.cumsum(light) - light / 2, [], 0, 0.0
    for load, _, held in piles:
        order += held
        filled += max(level - load, 0.0)
        upto = int(np.searchsorted(middle, filled))
        order += range(len(heavy) + taken, len(heavy) + max(upto, taken))
        taken = max(upto, taken)
    return np.array([*order, *range(len(heavy) + taken, len(heavy) + len(light))], np.int64)


def capacity(before: np.ndarray, shards: int) -> int:
    """The least capacity with which a greedy walk over the ordered atoms needs no more than the shards.

    ``before`` holds the bytes before each atom, and the total at its end.
    """
    n, total = len(before) - 1, int(before[-1])
    low, high = max(-(-total // shards), int(np.diff(before).max(initial=0))), total
    while low < high:
        middle, at = (low + high) // 2, 0
        for _ in range(shards):
            at = int(np.searchsorted(before, int(before[at]) + middle, "right")) - 1
            if at == n:
                break
        low, high = (low, middle) if at == n else (middle + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First atom of each shard but the first, over the ordered atoms."""
    before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    n, most = len(sizes), capacity(before, shards)
    reach = np.searchsorted(before, before + most, "right") - 1
    need = np.zeros(n + 1, np.int64)  # shards that the walk needs from each atom on
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]]
    at, out = 0, []
    for left in range(shards, 1, -1):
        if at < n:
            goal = int(before[at]) + (int(before[-1]) - int(before[at])) / left
            near = int(np.searchsorted(before, goal))
            near -= near > 0 and goal - before[near - 1] <= before[min(near, n)] - goal
            least = int(np.searchsorted(-need, -(left - 1)))  # from here the other shards are enough
            at = min(max(near, at + 1, least), int(reach[at]))
        out.append(at)
    return out


def by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("int")), "shard-rows")
    groups = materialize(rows.groupBy("key", "bundle").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    is_heavy = F.col("bytes") > total / (shards * HEAVY)
    heavy = sorted(groups.where(is_heavy).select("key", "bytes").collect())  # at most shards * HEAVY
    light = sorted(groups.where(~is_heavy).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect())  # at most BUNDLES
    sizes = [np.array([r["bytes"] for r in found], np.int64) for found in (heavy, light)]
    order = arranged(*sizes, shards)
    shard = np.empty(len(order), np.int64)
    shard[order] = np.searchsorted(cuts(np.concatenate(sizes)[order], shards), np.arange(len(order)), "right")
    of_heavy = spark.createDataFrame([(bytes(r["key"]), int(s)) for r, s in zip(heavy, shard, strict=False)], "key binary, of_heavy int")
    of_light = spark.createDataFrame([(r["bundle"], int(s)) for r, s in zip(light, shard[len(heavy) :], strict=True)], "bundle int, of_light int")
    placed = rows.join(F.broadcast(of_heavy), "key", "left").join(F.broadcast(of_light), "bundle", "left").withColumn("shard", F.coalesce("of_heavy", "of_light"))
    binned = placed.select("doc_id", "size", "text_crc32", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(BINS)).cast("int").alias("bin"))
    counts = binned.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bin", (F.sum("n").over(W.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))  # at most shards * BINS
    inside = binned.withColumn("at", F.row_number().over(W.partitionBy("shard", "bin").orderBy("row")) - 1)
    return inside.join(F.broadcast(offsets), ["shard", "bin"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
