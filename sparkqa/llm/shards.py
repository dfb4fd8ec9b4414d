"""Sharding by fixed virtual slots (DataFrame functions only on the rows).

A record hashes into one of ``slots`` virtual slots, for ever. Rows and bytes are added up per slot, and a small map
says which shard holds each slot. The map is a versioned table: its first version deals slots to shards in turn, before
anything is measured; every later version is an edit of the one before, which moves only the slots that rebalancing by
the bytes of the day needs. A version is written once, into a folder of its own, and never again.

The map and the statistics have one row per slot (4096 rows by default, whatever the corpus), which bounds what the
driver reads and what is broadcast. Positions in a shard are the slot's offset plus the row's number within its slot, so
no task gets a whole shard.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkqa.llm.shared import documents, new_folder, stored

#: Slots, shards and the law that holds.
SLOTS, SHARDS, LAW = 4096, 24, "bytes"
MAX_SLOTS = 1 << 16

MAP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()),
    T.StructField("slot_bytes", T.LongType()), T.StructField("slot_rows", T.LongType()), T.StructField("first", T.LongType()),
])


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32 and vslot of each row. The slot comes from doc_id and the text's
    checksum, so rows with null or repeated ids but different texts spread out."""
    if slots > MAX_SLOTS:
        raise ValueError(f"at most {MAX_SLOTS} slots, so that the map stays small")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) per slot; at most one row per slot reaches the driver."""
    return {r.vslot: (r.b, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    """Slot to shard, in turn."""
    return {v: v % shards for v in range(slots)}


def rebalanced(placed: dict[int, int], totals: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version of a map for ``shards`` shards: slots leave shards above the mean for those below, largest
    fitting slot first, and slots of shards that no longer exist are placed anew. Nothing else moves."""
    weight = lambda v: totals.get(v, (0, 0))[0]
    load = [0] * shards
    for v, s in placed.items():
        if s < shards:
            load[s] += weight(v)
    mean = sum(weight(v) for v in placed) / shards
    heaviest = sorted(placed, key=lambda v: (-weight(v), v))
    moving = [v for v in heaviest if placed[v] >= shards]
    for v in heaviest:
        if placed[v] < shards and weight(v) and load[placed[v]] - weight(v) >= mean:
            load[placed[v]] -= weight(v)
            moving.append(v)
    out, lightest = dict(placed), [(b, s) for s, b in enumerate(load)]
    heapq.heapify(lightest)
    for v in sorted(moving, key=lambda v: (-weight(v), v)):
        b, out[v] = lightest[0]
        heapq.heapreplace(lightest, (b + weight(v), out[v]))
    return out


def store_map(spark: SparkSession, placed: dict[int, int], totals: dict[int, tuple[int, int]], version: int, path: str) -> DataFrame:
    """Writes a version of the map below ``path`` and returns it; an error if that version is there already. What a failed
    write has left of it, a folder without rows, is written over."""
    first, seen = {}, {}
    for v in sorted(placed):
        first[v] = seen.get(placed[v], 0)
        seen[placed[v]] = first[v] + totals.get(v, (0, 0))[1]
    rows = [(version, v, placed[v], *totals.get(v, (0, 0)), first[v]) for v in sorted(placed)]
    there = load_map(spark, path, version)
    mode = "overwrite" if there is None or there.isEmpty() else "error"
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.mode(mode).parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the map, or the latest; None if there is none yet."""
    try:
        table = spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return None
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return table.where(F.col("version") == version).select(*MAP_SCHEMA.names)


def shard(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, vslot, map_version, shard, slot (position in the shard).

    map_path: where the map is kept from call to call. A call edits the latest version by the bytes it measures, also for
    another number of shards, and writes the next one; without any version yet, it first writes version 1, slots dealt in
    turn. A new path is used where none is given.

    Sizes of shards come out near equal (law ``bytes``) as long as no slot outweighs a shard. Null texts have no bytes,
    null ids are ids like others, repeated rows share a slot and get positions of their own, an empty table gives no
    rows, long texts only weigh more, other columns are left out. Positions go by doc_id (nulls first), checksum and size
    within a slot.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs, slots), "sized")
    totals = slot_totals(rows)
    path = map_path or new_folder(spark, "slot-map")
    last = load_map(spark, path)
    if last is None:
        last = store_map(spark, first_map(slots, shards), {}, 1, path)
    known = last.collect()  # one row a slot
    if len(known) != slots:
        raise ValueError(f"the map at {path} has {len(known)} slots, and slots are for ever")
    table = store_map(spark, rebalanced({r.vslot: r.shard for r in known}, totals, shards), totals, known[0].version + 1, path)
    placed = rows.join(F.broadcast(table.select("vslot", "shard", "first", F.col("version").alias("map_version"))), "vslot")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", "vslot", "map_version", "shard", (F.col("first") + within - 1).cast("long").alias("slot"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
