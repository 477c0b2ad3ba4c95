"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (thousands); bytes are summed per slot; a small
versioned map sends slots to shards. Rebalancing edits the map, never the hash, so a record moves
only when its slot does.

Edge cases: a null text has no bytes (its record still counts ``ROW_BYTES``); records with a null
key are spread by their text's hash; the slot follows the key, so equal texts of different keys may part; texts of any length count whole, and
columns other than the two named are never read; equal rows stay in one slot and take different positions; an
empty table gives an empty result and a map whose slots are dealt round the shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
ROW_BYTES = 8
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long, map_version int"


def with_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot): the narrow records that sharding moves, no texts."""
    k, t = F.col(key), F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        k.alias(key),
        (F.octet_length(t) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(k, F.when(k.isNull(), t)), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_totals(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows): one row per virtual slot at most, a bound fixed by the slot count."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["virtual_slot"], r["b"], r["n"]) for r in got]


def first_map(totals: Iterable[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> list[tuple]:
    """Version 1: every slot, heaviest first, to the shard with the fewest bytes so far."""
    known = {s: (b, n) for s, b, n in totals}
    loads = [(0, k) for k in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-known.get(s, (0, 0))[0], s)):
        size, rows = known.get(slot, (0, 0))
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + max(size, 1), shard))
        out.append((slot, shard, size, rows, 1))
    return sorted(out)


def rebalanced(slot_map: list[tuple], totals: Iterable[tuple[int, int, int]], shards: int,
               tolerance: float = 0.01) -> list[tuple]:
    """The next version for new totals and, it may be, more or fewer shards. Slots of shards that are gone
    move first; then the heaviest shard gives the slot that best levels it with the lightest one,
    until the gap is within ``tolerance`` of the mean or no single move narrows it."""
    known = {s: (b, n) for s, b, n in totals}
    version = max(r[4] for r in slot_map) + 1
    owner = {r[0]: r[1] for r in slot_map}
    weight = {s: max(known.get(s, (0, 0))[0], 1) for s in owner}
    held: list[set] = [set() for _ in range(shards)]
    load = [0] * shards

    def put(slot: int, shard: int) -> None:
        held[shard].add(slot)
        load[shard] += weight[slot]
        owner[slot] = shard

    homeless = [s for s, k in owner.items() if k >= shards]
    for s, k in list(owner.items()):
        if k < shards:
            put(s, k)
    for s in sorted(homeless, key=lambda s: (-weight[s], s)):
        put(s, min(range(shards), key=lambda k: (load[k], k)))
    mean = sum(load) / shards
    while True:
        high = max(range(shards), key=lambda k: (load[k], -k))
        low = min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        if gap <= tolerance * mean:
            break
        fitting = [s for s in held[high] if weight[s] < gap]
        if not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap / 2 - weight[s]), s))
        held[high].remove(slot)
        load[high] -= weight[slot]
        put(slot, low)
    return [(s, owner[s], *known.get(s, (0, 0)), version) for s in sorted(owner)]


def write_map(spark: SparkSession, slot_map: list[tuple], path: str) -> None:
    """Adds one version to the stored map; earlier versions stay readable."""
    version = slot_map[0][4]
    (spark.createDataFrame(slot_map, MAP_SCHEMA).drop("map_version").coalesce(1)
     .write.mode("errorifexists").parquet(f"{path}/map_version={version}"))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """A stored version, the newest by default; slot count rows."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("map_version")).first()[0]
    rows = stored.where(F.col("map_version") == version).select(*[c.split()[0] for c in MAP_SCHEMA.split(", ")])
    return sorted(tuple(r) for r in rows.collect())


def assign(records: DataFrame, slot_map: list[tuple], key: str = "doc_id") -> DataFrame:
    """Records with ``shard`` and a gapless place ``slot`` in it: slots of a shard follow one another,
    rows of a slot by key. Windows hold one virtual slot each, never a whole shard; the map that is
    joined has one row per slot."""
    start: dict[int, int] = {}
    places = []
    for slot, shard, _, rows, version in slot_map:
        places.append((slot, shard, start.get(shard, 0), version))
        start[shard] = start.get(shard, 0) + rows
    spark = records.sparkSession
    placed = spark.createDataFrame(places, "virtual_slot int, shard int, slot_start long, map_version int")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size"))
    return (records.withColumn("slot_rank", rank).join(F.broadcast(placed), "virtual_slot")
            .withColumn("slot", F.col("slot_start") + F.col("slot_rank") - 1)
            .drop("slot_rank", "slot_start"))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` dealt to ``shards`` shards of near equal bytes. Without ``path`` under a fresh map. With it the map is stored there: version 1 if there is
    none yet, else an edit of the newest one for the rows as they are now; records are placed by what is read back."""
    records = with_slots(docs, key, text, slots)
    if path is None:
        return assign(records, first_map(slot_totals(records), shards, slots), key)
    spark = docs.sparkSession
    return assign(records, read_map(spark, path, store_map(spark, path, slot_totals(records), shards, slots)), key)


def store_map(spark: SparkSession, path: str, totals: Iterable[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> int:
    """Adds the map for these totals to the stored versions, the first or an edit of the newest; its version."""
    try:
        newest = read_map(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        newest = None
    slot_map = rebalanced(newest, totals, shards) if newest else first_map(totals, shards, slots)
    write_map(spark, slot_map, path)
    return slot_map[0][4]


def with_next_shard(placed: DataFrame, slot_map: list[tuple], name: str = "next_shard") -> DataFrame:
    """``placed`` and the shard of its virtual slot under another version of the map."""
    other = placed.sparkSession.createDataFrame([(r[0], r[1]) for r in slot_map], f"virtual_slot int, {name} int")
    return placed.join(F.broadcast(other), "virtual_slot")
