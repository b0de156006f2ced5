"""Sharding by fixed virtual slots (operator 8), in DataFrame functions only.

A record's id hashes to one of some thousand slots, and a versioned map says
which shard holds each slot. A shard more takes whole slots from the largest
shards and leaves all others where they are. Bytes per slot are summed beside
the map, so that a map can be edited when a shard grows too heavy.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwise.llm.common import numbers, staged, utf8

SLOTS = 4096
#: parts of a slot, by a hash of the whole record, when rows are numbered
PARTS = 64
#: equal rows that one task writes out at most at a time
RUN = 1 << 16


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: from one shard, grown a shard at a time.

    Slots and the number of shards decide alone, so equal calls agree.
    """
    held = [0] * slots
    for n in range(1, shards):
        held = grow(held, n)
    return held


def grow(held: list[int], new: int) -> list[int]:
    """``held`` with shard ``new``: its fair share of slots, the last ones of the fullest shards."""
    held, by = list(held), {}
    for slot, shard in enumerate(held):
        by.setdefault(shard, []).append(slot)
    for _ in range(len(held) // (len(by) + 1)):
        full = max(by, key=lambda s: (len(by[s]), -s))
        held[by[full].pop()] = new
    return held


def rebalance(held: list[int], slot_bytes: dict[int, int], moves: int = 64) -> list[int]:
    """``held`` after up to ``moves`` edits, each a slot from the heaviest shard to the lightest.

    A slot moves only if that lowers the heavier shard of both; the largest
    slot of which that holds goes first.
    """
    held = list(held)
    weight = {s: 0 for s in held}
    for slot, shard in enumerate(held):
        weight[shard] += slot_bytes.get(slot, 0)
    for _ in range(moves):
        high, low = max(sorted(weight), key=weight.get), min(sorted(weight), key=weight.get)
        fits = [s for s, shard in enumerate(held) if shard == high and 0 < slot_bytes.get(s, 0) < weight[high] - weight[low]]
        if not fits:
            break
        slot = max(fits, key=lambda s: (slot_bytes[s], -s))
        held[slot] = low
        weight[high] -= slot_bytes[slot]
        weight[low] += slot_bytes[slot]
    return held


def map_table(spark: SparkSession, held: list[int], version: int = 1) -> DataFrame:
    """(version, virtual_slot, shard): a map as a table of one row per slot."""
    return numbers(spark, held).select(F.lit(version).alias("version"), F.col("pos").alias("virtual_slot"), F.col("value").alias("shard"))


def save_map(table: DataFrame, path: str) -> None:
    """Adds a version of the map to the versioned store at ``path``."""
    table.write.mode("append").partitionBy("version").parquet(path)


def store_versions(sizes: DataFrame, held: list[int], path: str) -> DataFrame:
    """Stores ``held`` as version 1 and the map with one shard more as version 2,
    each with its slots' rows and bytes (``slot_sizes``), and reads both back:
    virtual_slot, shard, grown_shard.
    """
    spark = sizes.sparkSession
    both = map_table(spark, held).unionByName(map_table(spark, grow(held, max(held) + 1), 2))
    summed = both.join(sizes, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "bytes")])
    save_map(summed, path)
    stored = spark.read.schema("virtual_slot int, shard int, rows long, bytes long, version int").parquet(path)
    grown = stored.where("version = 2").select("virtual_slot", F.col("shard").alias("grown_shard"))
    return stored.where("version = 1").select("virtual_slot", "shard").join(grown, "virtual_slot")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version of the map, the latest if none is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("virtual_slot").collect()  # one per slot
    return [r["shard"] for r in rows]


def virtual_slot(doc_id: str, slots: int = SLOTS) -> Column:
    """The slot of an id, by its text, so that integer types agree (null: as an empty text)."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def record_bytes(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def slot_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, rows, bytes): at most a row per slot."""
    return docs.groupBy(virtual_slot(doc_id, slots).alias("virtual_slot")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(record_bytes(text)).alias("bytes"))


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", held: list[int] | None = None,
          store: str | None = None) -> DataFrame:
    """A row per row of ``docs``: its shard, and its place there.

    doc_id, size (UTF-8 bytes and one), text_crc32, law (always ``key``),
    shard, slot (gapless from 0 in each shard), grown_shard (with one shard
    more) and virtual_slot. ``held`` is a stored map (default: ``shards``
    grown from one). With ``store``, a new path, the map and the grown one are
    stored there with the bytes of their slots, and rows are placed by what is
    read back.

    Null texts are empty, null ids go where an empty id would, equal rows are
    numbered apart. Rows are numbered within 64 hashed parts of each slot and
    the parts' counts added up, so an id on a third of all rows with texts of
    its own is many parts, not one. Rows equal in id and text are one counted
    row until the end, when runs of ``RUN`` of them are written out apart.
    """
    spark = docs.sparkSession
    held = slot_map(shards) if held is None else held
    text_col = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), record_bytes(text).alias("size"), F.crc32(utf8(text_col)).alias("text_crc32"),
        virtual_slot(doc_id, len(held)).alias("virtual_slot"))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int")
    equal = staged(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("part", part), "equal-rows")
    if store:
        table = store_versions(equal.groupBy("virtual_slot").agg(
            F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("bytes")), held, store)
    else:
        table = map_table(spark, held).select("virtual_slot", "shard").join(
            map_table(spark, grow(held, max(held) + 1)).select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot")
    dealt = equal.join(F.broadcast(table), "virtual_slot")  # a row per slot: some thousand
    counts = dealt.groupBy("shard", "virtual_slot", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    placed = staged(dealt.join(starts, ["virtual_slot", "part"]).withColumn("first", at.cast("long")), "placed")
    runs = placed.where(F.col("copies") > RUN).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))).alias("at")).repartition("doc_id", "at")
    runs = runs.withColumn("first", F.col("first") + F.col("at")).withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("at"))).drop("at")
    return placed.where(F.col("copies") <= RUN).union(runs).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"), "grown_shard", "virtual_slot")
