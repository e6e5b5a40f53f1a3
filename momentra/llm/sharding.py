"""Sharding by fixed virtual slots.

A record's hash gives one of SLOTS virtual slots for good. Bytes are summed a slot, and a versioned map sends slots to
shards; rebalancing edits the map and moves whole slots. Only the per-slot sums (SLOTS rows at most) reach the driver.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentra.llm.common import fresh_dir

SLOTS = 8192
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, virtual_slot). Null text: no bytes; null id: hashed as such."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select("doc_id", size.alias("size"), crc.cast("long").alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
    )


def slot_sizes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has rows: SLOTS entries at most."""
    rows = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1 of a map, before anything is known of the data: the slots in turn."""
    return {slot: slot % shards for slot in range(slots)}


def rebalance(old: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version: one slot after the other is edited from the fullest shard to the emptiest, the one whose bytes come
    nearest half their difference, while that narrows it. A shard that has none such is settled."""
    out, load, members = dict(old), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in sorted(old.items()):
        size = sizes.get(slot, (0, 0))[0]
        load[shard] += size
        if size:
            bisect.insort(members[shard], (size, slot))
    open_shards = set(range(shards))
    while open_shards:
        full, empty = max(open_shards, key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap, rows = load[full] - load[empty], members[full]
        at = bisect.bisect_left(rows, (gap / 2, -1))
        near = min(rows[max(0, at - 1) : at + 1], key=lambda r: abs(r[0] - gap / 2), default=None)
        if near is None or near[0] >= gap:
            open_shards.remove(full)
            continue
        rows.remove(near)
        bisect.insort(members[empty], near)
        load[full] -= near[0]
        load[empty] += near[0]
        out[near[1]] = empty
    return out


def grow_map(old: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version, for `shards` shards: slots leave the fullest shard for a new one only, until that has its part."""
    out, load, members = dict(old), {s: 0 for s in range(shards)}, {s: [] for s in range(shards)}
    for slot, shard in old.items():
        load[shard] += sizes.get(slot, (0, 0))[0]
        members[shard].append(slot)
    for m in members.values():
        m.sort(key=lambda s: (sizes.get(s, (0, 0))[0], -s))
    target = sum(load.values()) / shards
    before = max(old.values(), default=-1) + 1
    for new in range(before, shards):
        while load[new] < target:
            full = max(range(before), key=lambda s: (load[s], -s))
            if not members[full]:
                break
            slot = members[full].pop()
            b = sizes.get(slot, (0, 0))[0]
            if not b or load[new] + b > target * 1.02 and load[new]:
                break
            out[slot] = new
            load[full] -= b
            load[new] += b
    return out


def store_map(spark: SparkSession, slot_map: dict[int, int], version: int, path: str | None = None) -> str:
    """The map as a version of a table (version, virtual_slot, shard) in the shared folder; gives its path."""
    path = path or fresh_dir(spark, "slot-map")
    rows = spark.createDataFrame(sorted(slot_map.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return path


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def assign(slotted: DataFrame, slot_map: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """slotted rows with shard and slot, the place in the shard: gapless from 0, by virtual slot, doc_id and checksum.

    Rows are numbered inside their virtual slot; the slots' offsets in a shard come from the per-slot counts, so no
    shard's rows have to meet in one task. Broadcast: the map and the counts, SLOTS rows each at most.
    """
    spark = slotted.sparkSession
    counts = spark.createDataFrame([(s, n) for s, (_, n) in sorted(sizes.items())], "virtual_slot int, n long")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(counts, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return slotted.withColumn("_n", inside).join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("offset") + F.col("_n") - 1).drop("_n", "offset")


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, virtual_slot, shard, slot, map_version), one row a row of docs.

    Law: bytes. Version 1 of the map deals the slots in turn; version 2, which is used, is version 1 edited by the
    slots' bytes. Sizes of shards differ by about one slot's bytes at most (by one row's where a row is larger). Both
    versions stay in the shared folder. Repeated rows are numbered apart; equal texts share a checksum but not a slot,
    as a group of them may be larger than a shard; empty tables give empty ones; other columns are not read.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, slots)
    sizes = slot_sizes(slotted)
    first = first_map(shards, slots)
    path = store_map(spark, first, 1)
    store_map(spark, rebalance(first, sizes, shards), 2, path)
    return assign(slotted, load_map(spark, path, 2), sizes).withColumn("map_version", F.lit(2))
