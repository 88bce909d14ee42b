"""Sharding by fixed virtual slots; DataFrame functions only.

Every record is hashed into one of `SLOTS` virtual slots, a number that never changes. Bytes and rows are aggregated per
slot, and a versioned map says which shard owns each slot. Version 1 deals the slots, heaviest first, to whichever shard is
lightest; `rebalance` edits a map into its next version by moving or swapping as few slots as bring the shards' bytes together.
Only the map changes when shards are added or drift apart: records keep their slots, so the data to move are the slots whose
owner changed. `save_map` and `load_map` keep the versions beside the data; `shards` reads the latest one, and where
shards have drifted from the mean edits it for the bytes that it finds and stores the edited one.

The law is `bytes`: shards have nearly equal sizes. Equal texts are therefore not kept together; a group of them, which may hold a
third of all rows, is spread by its doc_ids. Rows that repeat doc_id and text too have one slot between them, and are
spread over all slots by their place in the input once there are more than `HOT` of them; these alone don't keep their slots when
the input is written anew.

The map has `SLOTS` entries whatever the input, so it and the totals per slot and part are the only things the driver handles.
A record's place in its shard is the count of rows in the shard's earlier slots and parts plus its rank in its own part, of about
`PART` rows at most, so no task ever holds a whole shard or a large slot.

Defined cases: a null text has size 1 and checksum 0; a null doc_id is hashed like any value together with the checksum;
rows that repeat everything get places of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import shared_dir
from .common import scope, stage

SLOTS = 4096
PART = 1_000_000
HOT = 1000
BROADCAST_KEYS = 200_000
TOLERANCE = 0.001  # that an edit aims at
DRIFT = 0.02  # from which on a stored map is edited


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each virtual slot."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    @staticmethod
    def dealt(n_shards: int, slot_bytes: list[int]) -> SlotMap:
        """Version 1: every slot, heaviest first, to the shard that has the fewest bytes so far."""
        if n_shards < 1:
            raise ValueError("at least one shard is needed")
        owner, total = [0] * len(slot_bytes), [(0, s) for s in range(n_shards)]
        for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
            size, owner[slot] = total[0]
            heapq.heapreplace(total, (size + slot_bytes[slot], owner[slot]))
        return SlotMap(1, n_shards, tuple(owner))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(n_shards, virtual_slot, shard)."""
        owners = F.from_json(F.lit(str(list(self.owner))), "array<int>")
        return spark.range(1).select(F.lit(self.n_shards).alias("n_shards"), F.posexplode(owners).alias("virtual_slot", "shard"))

    def of(self, slot: Column) -> Column:
        return F.element_at(F.from_json(F.lit(str(list(self.owner))), "array<int>"), slot.cast("int") + 1)


def drifted(slot_map: SlotMap, slot_bytes: list[int]) -> bool:
    """Whether some shard is further than DRIFT from the mean."""
    total = [0] * slot_map.n_shards
    for size, shard in zip(slot_bytes, slot_map.owner):
        total[shard] += size
    mean = sum(total) / len(total)
    return max(total) > mean * (1 + DRIFT) or min(total) < mean * (1 - DRIFT)


def rebalance(old: SlotMap, slot_bytes: list[int], n_shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
    """The next version of a map. The heaviest shard gives a slot to the lightest, or swaps one with it, whichever brings
    the two nearest, until all are within `tolerance` of the mean or no exchange helps."""
    n = old.n_shards if n_shards is None else n_shards
    owner = [s if s < n else -1 for s in old.owner]
    held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    total = [0] * n
    for slot, s in enumerate(owner):
        if s >= 0:
            held[s].append((slot_bytes[slot], slot))
            total[s] += slot_bytes[slot]
    # slots of shards that are gone go, heaviest first, to whichever is lightest
    for size, slot in sorted(((slot_bytes[i], i) for i, s in enumerate(owner) if s < 0), reverse=True):
        s = min(range(n), key=total.__getitem__)
        owner[slot] = s
        held[s].append((size, slot))
        total[s] += size
    for h in held:
        h.sort()
    mean = sum(total) / n
    stuck: set[int] = set()
    for _ in range(20 * len(owner)):
        low = min(range(n), key=total.__getitem__)
        high = max((s for s in range(n) if s not in stuck), key=total.__getitem__, default=low)
        gap = total[high] - total[low]
        if high == low or gap <= 1 or (total[high] <= mean * (1 + tolerance) and total[low] >= mean * (1 - tolerance)):
            break
        best = None  # (what is left of the gap, given, taken)
        sizes = [x[0] for x in held[low]]
        for given in held[high]:
            for taken_size, k in _partners(sizes, given[0] - gap / 2):
                left = abs(gap - 2 * (given[0] - taken_size))
                if left < gap and (best is None or left < best[0]):
                    best = (left, given, held[low][k] if k >= 0 else None)
        if best is None:
            stuck.add(high)
            continue
        stuck.clear()
        _, given, taken = best
        for item, a, b in ((given, high, low), (taken, low, high)):
            if item is not None:
                held[a].remove(item)
                bisect.insort(held[b], item)
                total[a] -= item[0]
                total[b] += item[0]
                owner[item[1]] = b
    return SlotMap(old.version + 1, n, tuple(owner))


def _partners(sizes: list[int], wanted: float) -> list[tuple[int, int]]:
    """Nothing in return, or the slots whose size is next to `wanted`."""
    out = [(0, -1)]
    at = bisect.bisect_left(sizes, wanted)
    for k in (at - 1, at):
        if 0 <= k < len(sizes):
            out.append((sizes[k], k))
    return out


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Stores a version in its own folder below `path`; versions are never overwritten."""
    slot_map.frame(spark).coalesce(1).write.parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A stored version, the latest one unless named; None where there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(top)] if files.exists(top) else []
    found = [int(x[8:]) for x in found if x.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS"))]
    if not found or version is not None and version not in found:
        return None
    version = max(found) if version is None else version
    rows = sorted(spark.read.parquet(f"{path}/version={version}").collect(), key=lambda r: r["virtual_slot"])  # SLOTS rows
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
    )
    return out.withColumn("virtual_slot", _slot(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"), slots=slots))


def _slot(*parts: Column, slots: int) -> Column:
    head = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(slots)).cast("int")


def _spread(rows: DataFrame) -> DataFrame:
    """`rows`, a staged table, where rows that repeat doc_id and text more than HOT times are dealt to all slots.

    Only the rows of slots that hold more than twice the mean are counted by what they repeat.
    """
    per_slot = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    most = 2 * rows.count() / SLOTS + HOT
    heavy = [r["virtual_slot"] for r in per_slot.where(F.col("n") > most).collect()]  # half of SLOTS at most
    if not heavy:
        return rows
    same = ["doc_id", "text_crc32", "size", "virtual_slot"]
    hot = rows.where(F.col("virtual_slot").isin(heavy)).groupBy(*same).count().where(F.col("count") > HOT)
    hot = stage(hot.select(*[F.col(c).alias(f"_{c}") for c in same]), "shard-hot")  # one row for more than HOT
    few = hot.count()
    if not few:
        return rows
    if few <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in same[1:]:
        match = match & (F.col(c) == F.col(f"_{c}"))
    salted = _slot(F.col("text_crc32"), F.col("_row"), slots=SLOTS)
    return rows.join(hot, match, "left").withColumn("virtual_slot", F.when(F.col("_size").isNotNull(), salted).otherwise(F.col("virtual_slot"))).select(*rows.columns)


def shards(docs: DataFrame, n_shards: int = 16, current: SlotMap | None = None, maps: str | None = None) -> tuple[DataFrame, SlotMap]:
    """The placed records, and the map by which they are placed: the latest one stored in `maps`, or `current`, edited for these
    bytes, or else the first one. A map that was edited is stored in `maps`."""
    spark = docs.sparkSession
    with scope():
        staged = stage(records(docs).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
        rows = stage(_spread(staged), "shard-records", keep=True)
    per_slot = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1)))
    load = {r[0]: (r[1], r[2]) for r in per_slot.collect()}  # SLOTS rows at most
    slot_bytes = [load.get(s, (0, 0))[0] for s in range(SLOTS)]
    old = (load_map(spark, maps) if maps else None) or current
    if old and old.n_shards == n_shards and not drifted(old, slot_bytes):
        slot_map = old
    else:
        slot_map = rebalance(old, slot_bytes, n_shards) if old else SlotMap.dealt(n_shards, slot_bytes)
        if maps:
            save_map(spark, slot_map, maps)

    parts = -(-max((n for _, n in load.values()), default=1) // PART)
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "_row"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("virtual_slot", "_part").count().collect()} if parts > 1 else {(s, 0): n for s, (_, n) in load.items()}
    before, offset = [0] * n_shards, []
    for slot, shard in enumerate(slot_map.owner):
        for k in range(parts):
            offset.append(before[shard])
            before[shard] += counts.get((slot, k), 0)
    first = F.element_at(F.from_json(F.lit(str(offset)), "array<bigint>"), F.col("virtual_slot") * parts + F.col("_part") + 1)
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size", "_row"))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        slot_map.of(F.col("virtual_slot")).alias("shard"),
        (first + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
    return placed, slot_map


def map_folder(spark: SparkSession, name: str) -> str:
    """A folder for the versions of a map in the shared folder."""
    return f"{shared_dir(spark)}/{name}"
