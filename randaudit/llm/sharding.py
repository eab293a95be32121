"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

Every record hashes into one of `n_slots` virtual slots; the slot never changes. A slot map says which
shard holds a slot. Maps are versioned: rebalancing edits the map (few slots move) and raises the version,
so a reader with an older version still finds its rows. Only the per-slot sums (at most `n_slots` rows,
whatever the corpus holds) meet in one place to edit the map.

Null texts have the size 8 and the crc32 of the empty text; very long texts are measured whole; rows that repeat a doc_id are
placed each; other columns of the documents, whatever their names, are neither read nor returned; an empty table has an empty
map and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from randaudit.llm.common import shared_dir, stored

#: Virtual slots. Thousands, so that one slot is a small part of a shard and moving it is a small step.
N_SLOTS = 4096


def record_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot.

    size is the UTF-8 bytes of the text plus 8; a null text counts no bytes and has the crc32 of the empty
    text. The slot hashes doc_id and text crc, so rows that repeat a doc_id spread, unless they are equal. A row without a
    doc_id has nothing to be found by: it is dealt by its place in the table, so that no number of them crowds a slot.
    Other columns of docs are left behind.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    place = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), place), F.crc32(raw).cast("string"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n_slots).alias("vslot"),
    )


def slot_loads(records: DataFrame) -> DataFrame:
    """vslot, bytes, rows: partial sums before the shuffle, at most n_slots rows after it."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _place(loads: DataFrame, kept: DataFrame | None, n_shards: int) -> DataFrame:
    """Slots without a place go, largest first, to the shard with the fewest bytes (a fold over at most n_slots rows)."""
    start = F.array_repeat(F.lit(0).cast("long"), n_shards)
    free = loads
    if kept is not None:
        free = loads.join(kept.select("vslot"), "vslot", "left_anti")
        held = loads.join(kept, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b"))
        start = F.expr(f"transform(sequence(0, {n_shards - 1}), i -> coalesce(held[i], cast(0 as bigint)))")
    folded = free.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "vslot"))).alias("todo"))
    if kept is not None:
        folded = folded.crossJoin(held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("held")))
    placed = folded.withColumn("start", start).select(
        F.explode(
            F.expr(
                """aggregate(todo,
                     named_struct('loads', start, 'out', cast(array() as array<struct<vslot:bigint,shard:int>>)),
                     (a, x) -> named_struct(
                       'loads', transform(a.loads, (v, i) -> if(i + 1 = array_position(a.loads, array_min(a.loads)), v - x.b, v)),
                       'out', array_append(a.out, named_struct('vslot', x.vslot,
                              'shard', cast(array_position(a.loads, array_min(a.loads)) - 1 as int)))),
                     a -> a.out)"""
            )
        ).alias("p")
    )
    return placed.select("p.vslot", "p.shard")


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """version 1 of the slot map (version, vslot, shard) for measured loads; empty loads give an empty map."""
    return _place(loads, None, n_shards).select(F.lit(1).alias("version"), "vslot", "shard")


def rebalance(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map for new loads or another number of shards.

    A shard keeps its slots, largest first, while they fit into an equal share of all bytes; only the others,
    slots of shards that no longer exist and slots not seen before move. Loads without a row count no bytes.
    """
    latest = slot_map.agg(F.max("version").alias("latest"))
    now = slot_map.join(F.broadcast(latest), F.col("version") == F.col("latest")).select("vslot", "shard", "latest")
    share = loads.agg((F.sum("bytes") / n_shards).alias("share"))
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        loads.join(now, "vslot")
        .where(F.col("shard") < n_shards)
        .crossJoin(F.broadcast(share))
        .withColumn("upto", F.sum("bytes").over(run))
        .where(F.col("upto") <= F.col("share"))
        .select("vslot", "shard")
    )
    both = kept.unionByName(_place(loads, kept, n_shards))
    return both.crossJoin(F.broadcast(latest)).select((F.col("latest") + 1).alias("version"), "vslot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored maps; older versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def stored_maps(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions (version, vslot, shard); none in a folder without maps, or one that doesn't exist."""
    schema = "vslot long, shard int, version int"
    try:
        return spark.read.schema(schema).parquet(path).select("version", "vslot", "shard")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select("version", "vslot", "shard")


def latest_map(spark: SparkSession, path: str) -> DataFrame:
    """The stored map of the highest version."""
    maps = stored_maps(spark, path)
    return maps.join(F.broadcast(maps.agg(F.max("version").alias("latest"))), F.col("version") == F.col("latest")).drop("latest")


def assign(records: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records with shard and slot, the place in the shard from 0 without gaps.

    A slot's rows are numbered inside the slot (ordered by doc_id, crc, size) and start after the rows of the
    lower slots of its shard, so no window ever spans a shard. The map has at most n_slots rows.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(loads, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("k", F.row_number().over(inside))
        .join(F.broadcast(places), "vslot")
        .withColumn("slot", (F.col("before") + F.col("k") - 1).cast("long"))
        .drop("before", "k")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, maps: str | None = None, first_shards: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot: all rows in n_shards shards of nearly equal bytes.

    maps is the folder of the stored slot maps, by default a new one in the shared folder. Where it holds no map yet, version 1 deals these
    documents to first_shards shards (n_shards by default). The latest map, if it isn't such a one for n_shards, is then rebalanced
    for these documents and n_shards and stored as the next version. Rows are placed by the map read back.
    """
    spark = docs.sparkSession
    records = stored(record_slots(docs, n_slots), "shard-records")  # texts are read once
    loads = stored(slot_loads(records), "shard-loads")
    path = maps or f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    new = latest_map(spark, path).isEmpty()
    if new:
        store_map(first_map(loads, first_shards or n_shards), path)
    if not new or (first_shards or n_shards) != n_shards:
        store_map(rebalance(latest_map(spark, path), loads, n_shards), path)
    return assign(records, loads, latest_map(spark, path))
