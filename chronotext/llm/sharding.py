"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots.  Bytes and rows are summed per slot, and a slot-to-shard map, stored as a
numbered version, says where each slot lives.  The map is built and edited on slot sums alone (``slots`` rows, whatever
the data's size); growing or shrinking the cluster edits the map and so moves whole slots, never single records.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Slots in production: 256 for each of 16 shards.
SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, n_rows long, first_slot long"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record key."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_sums(records: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows) of the slots in use: partial sums are shuffled, and at most one row per slot reaches the driver."""
    return [tuple(r) for r in records.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()]


def build_map(sums: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot -> shard: the slots by falling bytes, each to the shard with the fewest bytes so far.  Empty slots are dealt round."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(sums, key=lambda x: (-x[1], x[0])):
        filled, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (filled + size, shard))
    return out | {s: s % shards for s in range(slots) if s not in out}


def rebalance(old: dict[int, int], sums: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """An edit of ``old`` for ``shards`` shards (more, fewer or as many) and new slot sums.

    Slots of shards that are gone move first; then, as long as it narrows the gap, the largest slot that fits half the gap
    moves from the fullest shard to the emptiest.  All other slots stay where they are.
    """
    size = {s: b for s, b, _ in sums}
    new = {s: k for s, k in old.items() if k < shards}
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, k in new.items():
        load[k] += size.get(s, 0)
        held[k].append((size.get(s, 0), s))
    for s in sorted(old.keys() - new.keys(), key=lambda s: (-size.get(s, 0), s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        new[s] = k
        load[k] += size.get(s, 0)
        held[k].append((size.get(s, 0), s))
    for _ in range(len(new)):
        full, free = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        fits = [x for x in held[full] if 0 < x[0] <= (load[full] - load[free]) // 2]
        if not fits:
            break
        moved = max(fits)
        held[full].remove(moved)
        held[free].append(moved)
        load[full] -= moved[0]
        load[free] += moved[0]
        new[moved[1]] = free
    return new


def write_map(spark: SparkSession, folder: str, version: int, slot_map: dict[int, int], sums: list[tuple[int, int, int]]) -> DataFrame:
    """Store ``slot_map`` as ``folder/version=N`` and return it; versions are never overwritten.

    ``first_slot`` is the number of records in the shard's earlier slots, so a record's place in its shard needs only its
    rank within its own slot.
    """
    by = {s: (b, n) for s, b, n in sums}
    seen: dict[int, int] = {}
    rows = []
    for s in sorted(slot_map):
        b, n = by.get(s, (0, 0))
        rows.append((version, s, slot_map[s], b, n, seen.get(slot_map[s], 0)))
        seen[slot_map[s]] = seen.get(slot_map[s], 0) + n
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{folder}/version={version}")
    return read_map(spark, folder, version)


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The largest version that ``folder`` holds; None where there is no map yet."""
    try:
        return spark.read.parquet(folder).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 and vslot of every row; a null text has the crc of an empty one.

    A row's key is its id and text, so rows without an id, or with the same one, are spread over the slots by their texts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and its place there (``slot``, gapless from 0).

    The map is broadcast: it has one row per virtual slot, a fixed number.  Records are ranked within virtual slots, of
    which there are thousands, so no task ranks a whole shard.  Rows that repeat in full get places of their own.
    """
    ranked = records.withColumn("place", F.row_number().over(W.Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1)
    found = ranked.join(F.broadcast(slot_map.select("vslot", "shard", "first_slot", "version")), "vslot")
    return found.withColumn("slot", (F.col("first_slot") + F.col("place")).cast("long"))


def shard_documents(docs: DataFrame, folder: str, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """All ``docs`` over ``shards`` shards by bytes, under a new version of the map kept in ``folder``.

    The first version is built from the slots' bytes; later ones are edits of the latest (:func:`rebalance`), so only the
    slots that must move do; a run whose version another one has stored meanwhile edits that one.  Null texts have size 1, columns other than doc_id and text are not looked at, and an empty
    table gives an empty result.
    """
    spark, records = docs.sparkSession, sized(docs, slots)
    sums = slot_sums(records)
    while True:
        latest = latest_version(spark, folder)
        old = {} if latest is None else {r.vslot: r.shard for r in read_map(spark, folder, latest).select("vslot", "shard").collect()}
        if latest is not None and len(old) != slots:
            raise ValueError(f"the map in {folder} has {len(old)} slots, not {slots}: their number is fixed")
        new = build_map(sums, shards, slots) if latest is None else rebalance(old, sums, shards)
        try:
            return assign(records, write_map(spark, folder, (latest or 0) + 1, new, sums))
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise


__all__ = ["MAP_SCHEMA", "SLOTS", "assign", "build_map", "latest_version", "read_map", "rebalance", "shard_documents", "sized", "slot_of", "slot_sums", "write_map"]
