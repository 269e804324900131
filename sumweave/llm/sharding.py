"""Sharding by virtual slots: records hash into thousands of slots, and a versioned map says which shard holds a slot."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..folders import new_folder
from .common import any_over, copies, drop_written, whole_row, written

SHARDS = 24
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the slot's shard; each edit makes a new version."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def balanced(slot_bytes: dict[int, int], n_slots: int, n_shards: int) -> SlotMap:
        """Largest slot first, each to the shard that has the least bytes so far."""
        heap, to = [(0, s) for s in range(n_shards)], [0] * n_slots
        for slot in sorted(range(n_slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
            held, shard = heapq.heappop(heap)
            to[slot] = shard
            heapq.heappush(heap, (held + slot_bytes.get(slot, 0), shard))
        return SlotMap(1, n_shards, tuple(to))

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None, slack: float = 0.02) -> SlotMap:
        """The next version, which moves few slots: off removed shards, then from the fullest to the emptiest shard until
        no shard is over the mean by more than slack, or no single move helps."""
        n = n_shards or self.n_shards
        to, held, slots = list(self.shard_of), [0] * n, [set() for _ in range(n)]
        homeless = []
        for slot, shard in enumerate(to):
            if shard < n:
                held[shard] += slot_bytes.get(slot, 0)
                slots[shard].add(slot)
            else:
                homeless.append(slot)

        def put(slot: int, shard: int) -> None:
            to[slot] = shard
            held[shard] += slot_bytes.get(slot, 0)
            slots[shard].add(slot)

        for slot in sorted(homeless, key=lambda s: (-slot_bytes.get(s, 0), s)):
            put(slot, min(range(n), key=lambda s: (held[s], s)))
        mean = sum(held) / n
        for _ in range(len(to)):
            most, least = max(range(n), key=lambda s: (held[s], -s)), min(range(n), key=lambda s: (held[s], s))
            if held[most] <= mean * (1 + slack):
                break
            gap = held[most] - held[least]
            fit = [s for s in slots[most] if 0 < slot_bytes.get(s, 0) < gap]
            if not fit:
                break
            slot = min(fit, key=lambda s: (abs(slot_bytes[s] - gap / 2), s))
            slots[most].remove(slot)
            held[most] -= slot_bytes[slot]
            put(slot, least)
        return SlotMap(self.version + 1, n, tuple(to))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, x) for s, x in enumerate(self.shard_of)], "vslot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """One small JSON file for each version; a version is never overwritten."""
        spark.createDataFrame([(json.dumps([self.version, self.n_shards, list(self.shard_of)]),)], "value string").coalesce(1).write.text(f"{folder}/v{self.version:08d}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        v, n, to = json.loads(spark.read.text(f"{folder}/v{version:08d}").first()[0])
        return SlotMap(v, n, tuple(to))


def doc_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _slot(n_slots: int) -> Column:
    """Of a record by its id, size, checksum, and its number among those alike in them."""
    text = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), *(F.col(c).cast("string") for c in ("size", "text_crc32", "copy")))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def _record(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"], doc_bytes(docs["text"]).alias("size"), F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_crc32")]


RECORD = ("doc_id", "size", "text_crc32")


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, previous: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """A row for each record of docs: doc_id, size, text_crc32, vslot, shard, slot (its place in the shard, from 0); and
    the slot map. Sizes of shards are near equal (law `bytes`). With a previous map, few slots move.

    Null text: 8 bytes, checksum 0. Null ids and repeated rows are records like others; equal texts with different ids
    spread over slots, and so do repeated rows, which are counted and numbered. Other columns are left out. No documents
    give no rows. Of slots or shards with equal bytes the lower number goes first. Of a very long text only size and
    checksum are moved; a record larger than a shard's share makes its shard larger.

    The driver gets one row for each virtual slot: n_slots bounds it, whatever the input. Records are numbered within
    virtual slots, and a slot's offset comes from those counts, so no shard is gathered in one task, nor are the copies
    of a record.
    """
    spark = docs.sparkSession
    counted = written(docs.select(*_record(docs)).groupBy(*RECORD).agg(F.count("*").alias("n")))
    keyed = copies(counted, "n", any_over(counted, "n")).drop("n").withColumn("vslot", _slot(n_slots))
    stats = {r["vslot"]: (r["n"], r["b"]) for r in keyed.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    held = {s: b for s, (_, b) in stats.items()}
    slot_map = previous.rebalanced(held, n_shards) if previous else SlotMap.balanced(held, n_slots, n_shards)
    filled, rows = [0] * n_shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        if slot in stats:
            rows.append((slot, shard, filled[shard]))
            filled[shard] += stats[slot][0]
    places = spark.createDataFrame(rows, "vslot int, shard int, base long")
    order = Window.partitionBy("vslot").orderBy(*RECORD, "copy")
    placed = keyed.withColumn("at", F.row_number().over(order)).join(F.broadcast(places), "vslot")  # n_slots rows at most
    return placed.select(*RECORD, "vslot", "shard", (F.col("base") + F.col("at") - 1).alias("slot")), slot_map


def write_shards(docs: DataFrame, slot_map: SlotMap, folder: str) -> None:
    """Writes whole records as Parquet, one folder _shard=k for each shard, with the columns of docs, whatever their
    names. Rows alike in all columns are counted, then written as often; they go where assign_shards puts them."""
    n_slots = len(slot_map.shard_of)
    keys = [F.xxhash64(whole_row(docs)).alias("h1"), F.xxhash64(F.lit(1), whole_row(docs)).alias("h2")]
    alike = written(docs.select(whole_row(docs), *_record(docs), *keys).groupBy("h1", "h2").agg(F.first("row").alias("row"), *(F.first(c).alias(c) for c in RECORD), F.count("*").alias("n")))
    # records alike in id, size and checksum are numbered on, though they differ in other columns
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*RECORD).orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = alike.select(*RECORD, "h1", "h2", "n").withColumn("before", before).where("before > 0").select("h1", "h2", "before")
    rows = copies(alike.join(more, ["h1", "h2"], "left"), "n", any_over(alike, "n")).withColumn("copy", F.col("copy") + F.coalesce("before", F.lit(0)))
    shards = slot_map.frame(docs.sparkSession).withColumnRenamed("shard", "_shard")
    placed = rows.withColumn("vslot", _slot(n_slots)).join(F.broadcast(shards), "vslot")  # n_slots rows
    # the name of the folders clashes with no column of docs
    name = "_shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    placed.repartition("_shard", F.col("vslot") % 16).select("row.*", F.col("_shard").alias(name)).write.partitionBy(name).parquet(folder)
    drop_written(alike)


def query(docs: DataFrame) -> DataFrame:
    """Shards by a slot map that is stored as version 1 and read again."""
    placed, slot_map = assign_shards(docs)
    folder = new_folder(docs.sparkSession)
    slot_map.save(docs.sparkSession, folder)
    if SlotMap.load(docs.sparkSession, folder, slot_map.version) != slot_map:
        raise RuntimeError(f"the slot map stored in {folder} isn't the one made")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum by its rule, bit by bit for a table and then byte by byte; the slots, largest first, to the lightest shard.
ORACLE_SQL = rf"""
WITH RECURSIVE k AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
h AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
r AS (SELECT doc_id, CAST(len(b) + 8 AS BIGINT) AS size, CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32 FROM h, k),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) AS copy FROM r),
v AS MATERIALIZED (SELECT *, ('0x' || substr(md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), '-'), size, text_crc32, copy)), 1, 8))::BIGINT % {SLOTS} AS vslot FROM c),
b AS MATERIALIZED (SELECT vslot, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, vslot) AS nth FROM v GROUP BY vslot),
s AS (SELECT CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS vslot, 0 AS shard, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS held
  UNION ALL SELECT b.nth, b.vslot, CAST(list_position(held, list_min(held)) - 1 AS INTEGER), list_transform(held, lambda x, i: CASE WHEN i = list_position(held, list_min(held)) THEN x + b.bytes ELSE x END) FROM s JOIN b ON b.nth = s.nth + 1),
p AS (SELECT vslot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s JOIN b USING (vslot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(base + row_number() OVER (PARTITION BY vslot ORDER BY doc_id NULLS FIRST, size, text_crc32, copy) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM v JOIN p USING (vslot)
"""
