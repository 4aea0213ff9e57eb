"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. Slots, not records, are given
to shards: the map from slot to shard is a small versioned table, planned from
the bytes per slot and edited, a few slots at a time, when shards are added or
drift apart. The number of slots is fixed, so everything that reaches the
driver or is broadcast has a bound that doesn't depend on the input.

Defined cases: a null text has no bytes (its record still counts 16) and the
checksum of an empty text; null keys hash like any value; repeated rows share a
slot; an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
RECORD_BYTES = 16
#: Rows of one slot are numbered in so many independent parts.
PARTS = 16

SlotMap = list[tuple[int, int]]


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    """The virtual slot of a record: it never changes, whatever the shards."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Bytes of every slot, empty ones included: `slots` rows on the driver."""
    found = dict(
        map(tuple, records.groupBy("virtual_slot").agg(F.sum("size")).collect())
    )
    return [(slot, found.get(slot, 0)) for slot in range(slots)]


def first_map(totals: list[tuple[int, int]], shards: int) -> SlotMap:
    """A new map: the heaviest slot goes to the lightest shard, again and again."""
    heap = [(0, 0, shard) for shard in range(shards)]
    placed = []
    for slot, size in sorted(totals, key=lambda x: (-x[1], x[0])):
        load, held, shard = heapq.heappop(heap)
        placed.append((slot, shard))
        heapq.heappush(heap, (load + size, held + 1, shard))
    return sorted(placed)


def rebalance(slot_map: SlotMap, totals: list[tuple[int, int]], shards: int) -> SlotMap:
    """The next version: slots move from the heaviest to the lightest shard while that helps.

    Shards may have been added or removed; slots of removed shards move first.
    Slots that needn't move stay where they are.
    """
    size = dict(totals)
    held: dict[int, set[int]] = defaultdict(set)
    load = dict.fromkeys(range(shards), 0)
    homeless = []
    for slot, shard in slot_map:
        if shard < shards:
            held[shard].add(slot)
            load[shard] += size.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size.get(s, 0), s)):
        shard = min(load, key=lambda s: (load[s], s))
        held[shard].add(slot)
        load[shard] += size.get(slot, 0)
    stuck: set[int] = set()
    while len(stuck) < shards - 1:
        heavy = max((s for s in load if s not in stuck), key=lambda s: (load[s], -s))
        light = min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fit = [s for s in held[heavy] if 0 < size.get(s, 0) < gap]
        if not fit:
            stuck.add(heavy)
            continue
        slot = min(fit, key=lambda s: (abs(2 * size[s] - gap), s))
        held[heavy].remove(slot)
        held[light].add(slot)
        load[heavy] -= size[slot]
        load[light] += size[slot]
    return sorted((slot, shard) for shard, own in held.items() for slot in own)


def save_map(spark: SparkSession, path: str, version: int, slot_map: SlotMap) -> None:
    """Add one version to the stored map; earlier versions stay readable."""
    table = spark.createDataFrame(slot_map, "virtual_slot int, shard int").coalesce(1)
    table.write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def edit_map(spark: SparkSession, path: str, version: int, totals: list[tuple[int, int]], shards: int) -> int:
    """Rebalance a stored version into the next one; returns its number. A map is a row per slot."""
    stored = [tuple(row) for row in load_map(spark, path, version).collect()]
    save_map(spark, path, version + 1, rebalance(sorted(stored), totals, shards))
    return version + 1


def place(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Give each record its shard and its gapless place in the shard.

    Places are numbered per part of a slot and shifted by the counts of the
    parts before it, so no shard is ever sorted as a whole. The broadcast
    tables have at most SLOTS and SLOTS * PARTS rows.
    """
    parts = records.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part")
    starts = (
        parts.groupBy("virtual_slot", "_part")
        .agg(F.count("*").alias("_rows"))
        .join(F.broadcast(slot_map), "virtual_slot")
        .withColumn("_start", F.sum("_rows").over(before) - F.col("_rows"))
        .drop("_rows")
    )
    own = Window.partitionBy("virtual_slot", "_part").orderBy(*order)
    return (
        parts.withColumn("_own", F.row_number().over(own) - 1)
        .join(F.broadcast(starts), ["virtual_slot", "_part"])
        .withColumn("slot", F.col("_start") + F.col("_own"))
        .drop("_part", "_own", "_start")
    )
