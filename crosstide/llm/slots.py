"""Sharding over fixed virtual slots.

A record hashes into one of some thousands of slots; the slot never changes. A small versioned table maps slots to
shards. The first version is dealt from the bytes of each slot, largest first onto the lightest shard; later versions
are edits: only the slots named by the rebalancing move. What passes through the driver is one row per slot, a
constant set by `slots`, whatever the size of the table.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, col
from crosstide.session import settle

SLOTS = 4096
OVERHEAD = 8
RUN = 10_000  # equal rows that one step spells out


def slotted(records: DataFrame, key: str = KEY, text: str = TEXT, slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32, virtual_slot per record; the text itself is left behind.

    Size is the UTF-8 bytes of the text (null: none) plus 8. The slot hashes the key with the text's checksum and size,
    so rows that share a key, or have none, still spread. Rows equal in all three are numbered and their number is hashed
    too: which row has which number does not matter, as they are equal, so they are counted in groups, not sorted.
    """
    body = F.coalesce(col(text), F.lit(""))
    same = ["id", "size", "text_crc32"]
    narrow = records.select(col(key).alias("id"), (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    groups = narrow.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    # a group's numbers are spelled out in two steps, runs of RUN and then the numbers of a run, which are spread in between
    runs = groups.select(*same, "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))).alias("run"))
    lone = runs.where("copies <= 1").select(*same, F.lit(0).cast("bigint").alias("copy"))
    many = runs.where("copies > 1").repartition(*same, "run")
    first = F.col("run") * RUN
    each = many.select(*same, F.explode(F.sequence(first, F.least(first + RUN, F.col("copies")) - 1)).alias("copy"))
    rows = lone.unionByName(each)
    hashed = F.when(F.col("copy") == 0, F.xxhash64("id", "text_crc32", "size")).otherwise(F.xxhash64("id", "text_crc32", "size", "copy"))
    return rows.select("id", "size", "text_crc32", F.pmod(hashed, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(placed: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, rows, bytes) of the slots that hold rows; at most one row per slot reaches the driver."""
    rows = placed.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    return sorted((r["virtual_slot"], r["n"], r["bytes"]) for r in rows)


def first_map(sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: heaviest slot first, each to the lightest shard. Empty slots are dealt in turn."""
    lightest = [(0, s) for s in range(shards)]
    out = {}
    for slot, _, weight in sorted(sizes, key=lambda x: (-x[2], x[0])):
        load, shard = heapq.heappop(lightest)
        out[slot] = shard
        heapq.heappush(lightest, (load + weight, shard))
    for i, slot in enumerate(x for x in range(slots) if x not in out):
        out[slot] = i % shards
    return out


def rebalanced(mapping: dict[int, int], sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """An edited map for `shards` shards that moves few slots.

    Slots of shards that are gone, and then the lightest slots of shards above the mean, move to the lightest shard,
    as long as a move narrows the gap. With one shard more, rows move into the new shard only.
    """
    weight = {s: b for s, _, b in sizes}
    load, held = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for slot, shard in sorted(mapping.items()):
        if shard < shards:
            load[shard] += weight.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    old = max(mapping.values(), default=-1) + 1
    out = dict(mapping)
    for slot in sorted(homeless, key=lambda s: (-weight.get(s, 0), s)):
        shard = min(range(shards), key=lambda i: (load[i], i))
        out[slot], load[shard] = shard, load[shard] + weight.get(slot, 0)
        held[shard].append(slot)
    for shard in held:
        shard.sort(key=lambda s: (weight.get(s, 0), s), reverse=True)  # the lightest is taken first
    while True:
        into = min(range(old, shards) if shards > old else range(shards), key=lambda i: (load[i], i))
        out_of = max(range(shards), key=lambda i: (load[i] if held[i] else -1, -i))
        movable = [s for s in held[out_of] if weight.get(s, 0)]
        if out_of == into or not movable or load[into] + weight[movable[-1]] >= load[out_of]:
            return out
        slot = movable[-1]
        held[out_of].remove(slot)
        held[into].insert(0, slot)
        load[out_of] -= weight[slot]
        load[into] += weight[slot]
        out[slot] = into


def store_map(spark: SparkSession, path: str, version: int, mapping: dict[int, int], sizes: list[tuple[int, int, int]]) -> None:
    """Write a version of the map; earlier versions stay, and a version is never written twice."""
    rows, weight = {s: n for s, n, _ in sizes}, {s: b for s, _, b in sizes}
    table = [(s, shard, rows.get(s, 0), weight.get(s, 0)) for s, shard in sorted(mapping.items())]
    df = spark.createDataFrame(table, "virtual_slot int, shard int, n bigint, bytes bigint").coalesce(1)
    df.write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot, shard, n, bytes of one version."""
    return spark.read.schema("virtual_slot int, shard int, n bigint, bytes bigint").parquet(f"{path}/version={version}")


def shard_records(records: DataFrame, path: str, shards: int, key: str = KEY, text: str = TEXT, slots: int = SLOTS) -> DataFrame:
    """`<key>`, size, text_crc32, shard, slot, virtual_slot per landed record; stores version 1 of the map under `path`.

    The sizes of the shards are near equal: they differ by about the lightest slots, or by one record where a record is
    heavier than a shard's part. `slot` is the record's place in its shard, gapless from 0: places of a virtual slot follow
    those of lower slots of the same shard, and inside it rows are numbered by key, checksum and size. So no task holds
    more than one virtual slot. A null text weighs 8 bytes, a null key is smallest, equal rows are spread over the slots like
    others, other columns are ignored, an empty table gives an empty result.
    """
    spark = records.sparkSession
    placed = settle(slotted(records, key, text, slots), "slots")
    sizes = slot_sizes(placed)
    store_map(spark, path, 1, first_map(sizes, shards, slots), sizes)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = load_map(spark, path, 1).select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")
    out = placed.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("before") + F.row_number().over(inside) - 1)
    return out.select(F.col("id").alias(key), "size", "text_crc32", "shard", "slot", "virtual_slot")
