"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands, however large the corpus); the bytes of every
slot are summed; and a small versioned slot-to-shard map, balanced by those bytes, says which shard a slot is in.
Growing or rebalancing edits the map, so only the records of the edited slots move.

A record's slot is a hash of what it holds (id, text checksum, size) and of its number among equal records, so it doesn't
follow the layout of files or the count of cores. Equal texts are not kept together: a group of copies may hold more
than a shard.

Defined cases: a null text has no bytes and counts its overhead alone; a null id hashes like any other value; equal
ids, equal texts and repeated rows are spread, for the hash also takes that number (see ``slotted``); an empty
table gives no rows and a map that deals the empty slots evenly. Extra columns are left alone: only the named
columns are read, and results carry fixed names.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import delete_on_exit, documents, shared_dir, stage, text_of

SLOTS = 8192
OVERHEAD = 16
#: Parts in which equal records are numbered.
SALTS = 64


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: ``shard_of[slot]``."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def shard(self, slot: Column) -> Column:
        """The shard of a slot column; the map is a literal of ``len(shard_of)`` entries, never more."""
        codes = F.split(F.lit(",".join(map(str, self.shard_of))), ",")
        return F.element_at(codes, slot.cast("int") + 1).cast("int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's history."""
        rows = F.posexplode(F.split(F.lit(",".join(map(str, self.shard_of))), ",")).alias("slot", "shard")
        (spark.range(1).select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), rows)
         .withColumn("shard", F.col("shard").cast("int")).coalesce(1).write.mode("append").parquet(path))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The newest version, or the given one. Reads one row per slot."""
        at = spark.read.parquet(path)
        at = at.filter(F.col("version") == (F.lit(version) if version is not None else F.lit(at.agg(F.max("version")).first()[0])))
        rows = at.orderBy("slot").collect()
        return SlotMap(rows[0]["version"], rows[0]["shards"], tuple(r["shard"] for r in rows))


def balanced_map(slot_bytes: list[int], shards: int) -> SlotMap:
    """The first version: heaviest slot first, each into the lightest shard."""
    loads = [(0, 0, shard) for shard in range(shards)]
    shard_of = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        load, held, shard = loads[0]
        shard_of[slot] = shard
        heapq.heapreplace(loads, (load + slot_bytes[slot], held + 1, shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced_map(old: SlotMap, slot_bytes: list[int], shards: int) -> SlotMap:
    """The next version, for new byte counts or another number of shards, moving slots only out of shards that are
    gone or hold more than the mean."""
    loads, slots_of = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(old.shard_of):
        if shard < shards:
            loads[shard] += slot_bytes[slot]
            slots_of[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(slot_bytes) / shards
    for shard, slots in enumerate(slots_of):
        for slot in sorted(slots, key=lambda s: (-slot_bytes[s], s)):
            if slot_bytes[slot] and loads[shard] - slot_bytes[slot] >= mean:
                loads[shard] -= slot_bytes[slot]
                homeless.append(slot)
    shard_of = list(old.shard_of)
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-slot_bytes[s], s)):
        load, shard = heap[0]
        shard_of[slot] = shard
        heapq.heapreplace(heap, (load + slot_bytes[slot], shard))
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One staged row per record without its text: id, size, crc32 of the text and virtual slot.

    Records that are equal in all of these are numbered, so that they don't all land in one slot; which of them has which
    number makes no difference. They are counted first, and numbered in ``SALTS`` parts each."""
    text = text_of(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    rows = stage(rows.withColumn("_key", F.xxhash64("doc_id", "text_crc32", "size")), "records")
    repeated = stage(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"), "repeated-records")
    single = rows.join(repeated, "_key", "left_anti").withColumn("_number", F.lit(0).cast("long"))
    several = rows.join(repeated, "_key", "left_semi").withColumn("_salt", F.pmod("_row", F.lit(SALTS)))
    held = several.groupBy("_key", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    bases = held.select("_key", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy("_row"))
    several = several.withColumn("_number", within - 1).join(bases, ["_key", "_salt"]).withColumn("_number", F.col("_base") + F.col("_number"))
    columns = ["doc_id", "size", "text_crc32", slot_of([F.col("_key"), F.col("_number")], slots).alias("_slot")]
    return stage(single.select(*columns).unionAll(several.select(*columns)), "slotted")


def bytes_per_slot(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each virtual slot: at most ``slots`` rows reach the driver, whatever the input."""
    found = dict(rows.groupBy("_slot").agg(F.sum("size")).collect())
    return [found.get(s, 0) for s in range(slots)]


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, slot_map: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record's shard and its gapless place in the shard, with the map that decided.

    Places are dealt slot by slot: a prefix sum over the (few) slots of a shard plus the place within the virtual
    slot, so that no task ever sorts a whole shard."""
    rows = slotted(df, id_col, text_col, slots)
    slot_map = slot_map or balanced_map(bytes_per_slot(rows, slots), shards)
    counts = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shard", slot_map.shard(F.col("_slot")))
    before = Window.partitionBy("_shard").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_slot", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    placed = rows.withColumn("_k", F.row_number().over(within) - 1)
    out = placed.join(F.broadcast(bases), "_slot")  # at most one row per virtual slot
    return out.select("doc_id", "size", "text_crc32", F.col("_shard").alias("shard"), (F.col("_base") + F.col("_k")).cast("long").alias("slot"), F.col("_slot").alias("virtual_slot")), slot_map


def slot_bytes(placed: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each virtual slot of placed records."""
    return bytes_per_slot(placed.select(F.col("virtual_slot").alias("_slot"), "size"), slots)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes, by version 1 of a stored map; ``next_shard`` is where a record
    goes when the map is edited to version 2 for a 41st shard."""
    rows, first = shard_rows(documents(spark, sf_dir), 40)
    path = f"{shared_dir(spark)}/tidemark-slot-map-{uuid.uuid4().hex}"
    first.save(spark, path)
    rebalanced_map(first, slot_bytes(rows), 41).save(spark, path)
    delete_on_exit(spark, path)
    one, two = SlotMap.load(spark, path, 1), SlotMap.load(spark, path)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), one.shard(F.col("virtual_slot")).alias("shard"), "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "virtual_slot", F.lit(two.version).alias("map_version"), two.shard(F.col("virtual_slot")).alias("next_shard"),
    )
