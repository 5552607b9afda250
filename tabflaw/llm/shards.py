"""Sharding over fixed virtual slots.

Every record is hashed (id, text and the number among its copies) into one of a
fixed number of virtual slots; a record's slot never changes.  A versioned map
says which shard holds each slot.  The first map is made from the bytes per
slot, heaviest slot first onto the lightest shard, so shards are nearly equal in
bytes, and stored as version 1.  A later run over the same map folder loads the
latest version; when shards were added or sizes have drifted, ``rebalance``
edits that map: as few slots as the wanted balance needs move, and the edited
map is stored as the next version.  Maps are tables of as many rows as there are
slots, so they may pass through the driver and be broadcast; records never do.

A record's position in its shard runs from 0 without gaps: its rank within its
slot (thousands of slots, so no shard is sorted in one task) after the counts
of the shard's earlier slots.  Only ids, sizes and checksums are shuffled.

Equal records are counted before they are shuffled, and their copies are
numbered from the count, so a record repeated any number of times is spread over
all slots.

Defined results: a null text has size 1 and the checksum of the empty text;
null ids are hashed as such.  Which of two equal records is which copy does not
matter, as their rows are equal.  With fewer records than shards some shards
stay empty.  Extra columns are ignored.  One writer at a time may use a map folder.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, shared_folder, utf8_crc32, written

SLOTS = 4096
SHARDS = 16
LAW = "bytes"
COPIES = 4096                    # copies of one record that are numbered in one row's array
TOLERANCE = 0.01                 # shards may be above the mean by this share before slots move
MAP = T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False),
                    T.StructField("version", T.IntegerType(), False)])


def slot_of(doc_id: Column, crc: Column, size: Column, copy: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, crc, size, copy), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any (combined before the shuffle; as many rows as slots)."""
    got = records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in got}


def first_map(loads: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: heaviest slot first, onto the shard that is lightest (then has fewest slots, then comes first)."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda k: (-loads.get(k, 0), k)):
        load, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), n + 1, shard))
    return out


def rebalance(current: list[int], loads: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """An edited map over ``shards`` shards: slots leave shards above the mean (and shards that are gone) for the lightest.

    A shard gives its heaviest slot that doesn't take it below the mean, until
    it is within the tolerance or has no such slot.
    """
    total = [0] * max(shards, max(current, default=0) + 1)
    for slot, shard in enumerate(current):
        total[shard] += loads.get(slot, 0)
    mean = sum(total) / shards
    out = list(current)
    moving = [s for s, shard in enumerate(current) if shard >= shards]
    for shard in range(shards):
        mine = sorted((s for s, x in enumerate(current) if x == shard), key=lambda s: (-loads.get(s, 0), s))
        for slot in mine:
            load = loads.get(slot, 0)
            if total[shard] <= mean * (1 + tolerance):
                break
            if load and total[shard] - load >= mean * (1 - tolerance):
                total[shard] -= load
                moving.append(slot)
    heap = [(total[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-loads.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return out


def map_table(spark: SparkSession, shard_of: list[int], version: int) -> DataFrame:
    return spark.createDataFrame([(k, s, version) for k, s in enumerate(shard_of)], MAP)


def store_map(spark: SparkSession, shard_of: list[int], version: int, path: str) -> None:
    """Add a version to the map's table (one small file a version; earlier versions stay readable)."""
    map_table(spark, shard_of, version).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[int], int]:
    """A version of the map (the latest if none is named) and its number."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version").alias("v")).first()["v"]
    rows = stored.filter(F.col("version") == version).orderBy("slot").collect()
    return [r["shard"] for r in rows], version


def current_map(spark: SparkSession, path: str, loads: dict[int, int], shards: int = SHARDS, slots: int = SLOTS,
                tolerance: float = TOLERANCE) -> tuple[list[int], int]:
    """The map to use now and its version: the latest stored one, edited and stored as a new version if these loads need
    it; the first one where none is stored."""
    try:
        stored, version = load_map(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored, version = None, 0
    if stored is not None and len(stored) != slots:
        raise ValueError(f"the map in {path} has {len(stored)} slots, not {slots}")
    wanted = first_map(loads, shards, slots) if stored is None else rebalance(stored, loads, shards, tolerance)
    if wanted != stored:
        version += 1
        store_map(spark, wanted, version, path)
    return wanted, version


def records_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, copy (from 0), vslot of every row."""
    t = F.col(text)
    same = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"),
                       utf8_crc32(t).cast("bigint").alias("text_crc32")) \
        .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    # numbers in steps of COPIES, so no array grows with the copies by more than their COPIES-th part
    stepped = same.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
    return stepped.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1))) \
        .drop("from", "copies").withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy"), slots))


def place(records: DataFrame, shard_of: list[int], rows_in_slot: dict[int, int]) -> DataFrame:
    """``records`` with shard and slot, the position within the shard."""
    spark = records.sparkSession
    before: dict[int, int] = {}
    table = []
    for vslot, shard in enumerate(shard_of):
        table.append((vslot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + rows_in_slot.get(vslot, 0)
    where = F.broadcast(spark.createDataFrame(table, "vslot int, shard int, offset bigint"))     # a row per slot
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "copy"))
    return records.withColumn("__rank", rank).join(where, "vslot") \
        .withColumn("slot", F.col("offset") + F.col("__rank") - 1).drop("offset", "__rank")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text",
          maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, and its virtual slot and the map's version.

    ``maps`` is the folder of the map's versions, in shared storage; without one the map starts anew in a fresh folder."""
    spark = docs.sparkSession
    records = written(records_of(docs, id_col, text, slots), "shard-records")
    loads = slot_loads(records)
    shard_of, version = current_map(spark, maps or f"{shared_folder(spark, 'shard-maps')}/map",
                                    {k: b for k, (b, _) in loads.items()}, shards, slots)
    placed = place(records, shard_of, {k: n for k, (_, n) in loads.items()})
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
                         F.lit(version).alias("map_version"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id",
                 text: str = "text") -> None:
    """The whole rows as Parquet, a folder per shard, by the map whose versions lie beside them (made or edited as needed).

    Rows of equal id and text share a slot here, as their other columns may differ."""
    spark = docs.sparkSession
    t = F.col(text)
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint")
    vslot = free_name(docs.columns, "vslot")
    where_shard = free_name([*docs.columns, vslot], "shard")
    rows = docs.withColumn(vslot, slot_of(F.col(id_col), utf8_crc32(t).cast("bigint"), size, F.lit(0).cast("bigint"), slots))
    loads = {r["s"]: r["b"] for r in rows.groupBy(F.col(vslot).alias("s")).agg(F.sum(size).alias("b")).collect()}
    shard_of, _ = current_map(spark, f"{path}/map", loads, shards, slots)
    where = F.broadcast(spark.createDataFrame(list(enumerate(shard_of)), f"{vslot} int, {where_shard} int"))
    rows.join(where, vslot).drop(vslot).write.partitionBy(where_shard).parquet(f"{path}/rows")
