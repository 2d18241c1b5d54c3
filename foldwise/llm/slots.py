"""Sharding by fixed virtual slots.

Every record hashes to one of a fixed number of slots; bytes and rows are added up per slot
(one short row each, whatever the corpus size), and a versioned table says which shard a slot
belongs to.  Rebalancing edits that table: it moves as few slots as it can, records are never
hashed again.

Defined results: a null text has no bytes, so its size is the fixed overhead; null ids are
spread by the rest of the record; repeated rows fall into the same slot and get different
places there; an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.text import whole
from foldwise.session import materialize

SLOTS = 4096
OVERHEAD = 8
MAP_SCHEMA = "version int, v_slot int, shard int, bytes long, n_rows long, first_place long"


def record_size(text: str = "text") -> Column:
    return (F.octet_length(whole(text)) + F.lit(OVERHEAD)).cast("long")


def virtual_slot(doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    """Slot of a record; the text's checksum takes part, so that missing ids don't share a slot."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.crc32(whole(text))), F.lit(slots)).cast("int")


def slot_stats(records: DataFrame, slot: str, size: str) -> DataFrame:
    """Bytes and rows per slot: at most one row per slot, combined before the shuffle."""
    return records.groupBy(F.col(slot).alias("v_slot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def _rows(stats: DataFrame, slots: int) -> dict[int, tuple[int, int]]:
    """The driver's copy of the slot table, bounded by the number of slots."""
    got = {r["v_slot"]: (r["bytes"], r["n_rows"]) for r in stats.collect()}
    return {s: got.get(s, (0, 0)) for s in range(slots)}


def _table(spark: SparkSession, version: int, shard_of: dict[int, int], stats: dict[int, tuple[int, int]]) -> DataFrame:
    placed: dict[int, int] = {}
    out = []
    for s in sorted(shard_of):
        shard = shard_of[s]
        out.append((version, s, shard, *stats[s], placed.get(shard, 0)))
        placed[shard] = placed.get(shard, 0) + stats[s][1]
    return materialize(spark.createDataFrame(out, MAP_SCHEMA).coalesce(1))


def first_map(stats: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: heaviest slot first, each to the shard that holds the fewest bytes."""
    rows = _rows(stats, slots)
    loads = [(0, k) for k in range(shards)]
    shard_of = {}
    for s in sorted(rows, key=lambda x: (-rows[x][0], x)):
        load, k = heapq.heappop(loads)
        shard_of[s] = k
        heapq.heappush(loads, (load + rows[s][0], k))
    return _table(stats.sparkSession, 1, shard_of, rows)


def rebalance(current: DataFrame, stats: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version for new statistics or another number of shards.

    Slots of removed shards are placed anew; then slots move from the fullest to the emptiest
    shard while the fullest is more than ``tolerance`` over the mean and a move helps.
    """
    old = current.select("version", "v_slot", "shard").collect()
    rows = _rows(stats, len(old))
    version = max(r["version"] for r in old) + 1
    shard_of = {r["v_slot"]: r["shard"] for r in old}
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    homeless = []
    for s, k in shard_of.items():
        (held[k] if k < shards else homeless).append(s)
    load = {k: sum(rows[s][0] for s in held[k]) for k in held}
    for s in sorted(homeless, key=lambda x: (-rows[x][0], x)):
        k = min(load, key=lambda x: (load[x], x))
        held[k].append(s)
        load[k] += rows[s][0]
    mean = sum(load.values()) / shards
    while True:
        full, low = max(load, key=lambda x: (load[x], -x)), min(load, key=lambda x: (load[x], x))
        gap = load[full] - load[low]
        if load[full] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        fit = [s for s in held[full] if 0 < rows[s][0] < gap]
        if not fit:
            break
        s = min(fit, key=lambda x: (abs(rows[x][0] - gap / 2), x))
        held[full].remove(s)
        held[low].append(s)
        load[full] -= rows[s][0]
        load[low] += rows[s][0]
    return _table(current.sparkSession, version, {s: k for k, own in held.items() for s in own}, rows)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest if none is named."""
    versions = spark.read.parquet(path)
    newest = version if version is not None else versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).select(*[c.split()[0] for c in MAP_SCHEMA.split(", ")])


def assign(records: DataFrame, slot_map: DataFrame, slot: str, into: str = "shard") -> DataFrame:
    """Shard of every record, joined through the slot table (a few thousand short rows); other columns stay."""
    key = slot_map.select(F.col("v_slot").alias("_fw_slot"), F.col("shard").alias(into), F.col("first_place").alias("_fw_first"))
    return records.join(key, F.col(slot) == F.col("_fw_slot")).drop("_fw_slot")


def place_in_shard(assigned: DataFrame, slot: str, order: list[str]) -> Column:
    """Place of a record in its shard, without gaps from 0: where its slot begins plus its rank in the slot.

    Ranks are taken per slot, of which there are thousands of about equal size, never per shard.
    """
    return (F.col("_fw_first") + F.row_number().over(Window.partitionBy(slot).orderBy(*order)) - 1).cast("long")
