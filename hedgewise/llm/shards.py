"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

A record's slot is a hash of the record and never changes. Which shard holds a slot is looked up in a map that is
stored in versions; rebalancing measures the bytes of every slot and edits as few entries of the newest version as it
needs. Only the slots' totals (thousands of rows, however large the data) ever reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgewise.plans import written

SLOTS = 4096
#: Parts of a slot for numbering its rows; a power of two.
CELLS = 16


def with_slots(docs: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds ``virtual_slot`` and ``cell``, both from one hash of ``keys``. Nulls hash by the other keys."""
    h = F.xxhash64(*keys)
    return docs.withColumn("virtual_slot", F.pmod(h, F.lit(slots)).cast("int")).withColumn(
        "cell", F.pmod(F.shiftright(h, 40), F.lit(CELLS)).cast("int")
    )


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0: slots dealt in turn."""
    return np.arange(slots) % shards


def rebalanced(owner: np.ndarray, weight: np.ndarray, shards: int, close: float = 1e-4) -> np.ndarray:
    """An edited map in which the shards' weights are near equal.

    Again and again the heaviest and the lightest shard exchange what halves their difference best: one slot moves, or
    two slots swap. Ends when the difference is within ``close`` of the mean, or no exchange lessens it.
    """
    owner, weight = owner.copy(), np.asarray(weight, np.int64)
    load = np.bincount(owner, weight, minlength=shards).astype(np.int64)
    goal = max(1, int(load.sum() * close / shards))
    while True:
        a, b = int(load.argmax()), int(load.argmin())
        gap = int(load[a] - load[b])
        if gap <= goal:
            return owner
        have = np.flatnonzero((owner == a) & (weight > 0))
        back = np.flatnonzero((owner == b) & (weight > 0))
        back = back[np.argsort(weight[back], kind="stable")]
        weights = np.concatenate([[0], weight[back]])  # 0: nothing comes back
        want = np.searchsorted(weights, weight[have] - gap / 2)
        best = (gap, -1, -1)
        for near in (want - 1, want):
            near = near.clip(0, len(weights) - 1)
            left = np.abs(gap - 2 * (weight[have] - weights[near]))
            if len(left) and left.min() < best[0]:
                i = int(left.argmin())
                best = (int(left[i]), int(have[i]), int(near[i]))
        if best[1] < 0:
            return owner
        _, x, k = best
        owner[x] = b
        load[a] -= weight[x]
        load[b] += weight[x]
        if k:
            y = back[k - 1]
            owner[y] = a
            load[a] += weight[y]
            load[b] -= weight[y]


class SlotMap:
    """The stored map: one folder with a subfolder of Parquet for each version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, owner: np.ndarray) -> None:
        rows = self.spark.createDataFrame(list(enumerate(map(int, owner))), "virtual_slot int, shard int")
        rows.coalesce(1).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/version={version}").collect()
        return np.array([r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)])


def slot_totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("virtual_slot", "cell").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )


def sharded(docs: DataFrame, map_path: str, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's shard and its place there under the law ``bytes``: sizes near equal.

    Writes version 0 of the map, measures the slots, and writes version 1 rebalanced by bytes. Returns the key, size
    (UTF-8 bytes plus 1, a null text has none), text_crc32, shard, slot (place in the shard, gapless from 0) and
    virtual_slot. A null key is placed by its text; repeated rows share a virtual slot; an empty table gives no rows.
    Only the two named columns are read, so others may have any names. A slot is never split, so one text that is
    larger than a shard's share makes that shard larger.
    """
    spark = docs.sparkSession
    sized = with_slots(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        ["doc_id", "text_crc32", "size"],
    )
    sized = written(sized, "sized")
    totals = written(slot_totals(sized), "slots")
    per_slot = {r.virtual_slot: r for r in totals.groupBy("virtual_slot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()}  # SLOTS rows at most
    weight = np.array([per_slot[i].bytes if i in per_slot else 0 for i in range(SLOTS)])
    count = np.array([per_slot[i].rows if i in per_slot else 0 for i in range(SLOTS)])
    stored = SlotMap(spark, map_path)
    stored.write(0, first_map(shards))
    stored.write(1, rebalanced(stored.read(0), weight, shards))
    owner = stored.read(1)
    first = np.zeros(SLOTS, np.int64)
    for s in range(shards):
        own = owner == s
        first[own] = np.cumsum(count[own]) - count[own]
    placed = spark.createDataFrame(
        [(i, int(owner[i]), int(first[i])) for i in range(SLOTS)], "virtual_slot int, shard int, first long"
    )
    cells = totals.join(F.broadcast(placed), "virtual_slot").select(
        "virtual_slot",
        "cell",
        "shard",
        (
            F.col("first")
            + F.sum("rows").over(Window.partitionBy("virtual_slot").orderBy("cell"))
            - F.col("rows")
        ).alias("first"),
    )
    numbered = sized.withColumn(
        "place",
        F.row_number().over(
            Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
        ),
    )
    # SLOTS * CELLS rows of four numbers: bounded, hence broadcast
    return numbered.join(F.broadcast(cells), ["virtual_slot", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "virtual_slot"
    )
