"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots; the bytes of each slot are summed;
and a small table, one version after the other, says which shard holds which slot. Rebalancing
edits that table only: it moves slots, never re-hashes records. The table has one row for each
slot, so what reaches the driver has a constant size whatever the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heapreplace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

SLOTS = 8192


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(owner: list[int], size: list[int], shards: int, most_swaps: int = 20_000) -> list[int]:
    """The next version of a map: moves slots until the shards' sizes are near equal.

    Shards above the mean give up their smallest slots until they are not; the freed slots go,
    largest first, to the lightest shard; then single moves and swaps between the heaviest and
    the lightest shard halve their difference while any can. Shards that no slot maps to yet
    count as empty, so the same edit grows the map to more shards.
    """
    owner, load = list(owner), [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]  # (size, slot), ascending
    for slot, shard in enumerate(owner):
        own[shard].append((size[slot], slot))
        load[shard] += size[slot]
    mean, free = sum(load) / shards, []
    for shard, mine in enumerate(own):
        mine.sort()
        k = 0
        while load[shard] > mean and k < len(mine):
            load[shard] -= mine[k][0]
            k += 1
        free += mine[:k]
        del mine[:k]
    heap = [(x, shard) for shard, x in enumerate(load)]
    heapify(heap)
    for x, slot in sorted(free, key=lambda f: (-f[0], f[1])):
        low, shard = heap[0]
        heapreplace(heap, (low + x, shard))
        owner[slot], load[shard] = shard, low + x
        insort(own[shard], (x, slot))
    for _ in range(most_swaps):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best, give, take = gap, None, None
        for x in own[high]:
            # against nothing (a move) or the slot of the lightest shard that comes nearest to half the gap
            at = bisect_left(own[low], (x[0] - gap // 2, -1))
            for y in (None, *own[low][max(0, at - 1) : at + 2]):
                left = abs(gap - 2 * (x[0] - (y[0] if y else 0)))
                if left < best:
                    best, give, take = left, x, y
        if give is None:
            break
        own[high].remove(give)
        insort(own[low], give)
        owner[give[1]] = low
        moved = give[0]
        if take is not None:
            own[low].remove(take)
            insort(own[high], take)
            owner[take[1]] = high
            moved -= take[0]
        load[high] -= moved
        load[low] += moved
    return owner


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual): what sharding needs of each record, its text left behind."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
    ).withColumn("virtual", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(recs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of every slot; one row for each slot reaches the driver."""
    size, count = [0] * slots, [0] * slots
    for r in recs.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        size[r["virtual"]], count[r["virtual"]] = r["bytes"], r["n"]
    return size, count


def map_table(spark: SparkSession, versions: list[list[int]], counts: list[int]) -> DataFrame:
    """(version, virtual, shard, base): base is where the slot's records begin within the shard."""
    rows = []
    for version, owner in enumerate(versions, 1):
        filled: dict[int, int] = {}
        for slot, shard in enumerate(owner):
            rows.append((version, slot, shard, filled.get(shard, 0)))
            filled[shard] = filled.get(shard, 0) + counts[slot]
    return stored(spark.createDataFrame(rows, "version int, virtual int, shard int, base long"), "slot-map")


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts all records into shards whose sizes in bytes are near equal (law ``bytes``).

    The position within a shard is the slot's base plus the rank within the slot, so the only
    sorting is within a slot, over ids and digests without texts. A record's slot depends on
    its id, size and CRC, so equal ids with different texts spread; equal rows share a slot
    and get different positions. Null ids and texts are allowed (a null text has size 1), and
    an empty table gives an empty result. No shard can be evener than the largest record allows.

    Returns (id, size long, text_crc32 long, law, shard int, slot long, grown_shard int,
    virtual_slot int, map_version int); grown_shard is null under this law.
    """
    spark = docs.sparkSession
    recs = records(docs, slots, id_col, text_col)
    size, count = slot_sizes(recs, slots)
    before = first_map(slots, shards)
    versions = [before, rebalanced(before, size, shards)]
    current = map_table(spark, versions, count).where(F.col("version") == len(versions))
    rank = F.row_number().over(Window.partitionBy("virtual").orderBy("id", "text_crc32", "size"))
    placed = recs.withColumn("rank", rank).join(F.broadcast(current), "virtual")  # one row for each slot
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("virtual").alias("virtual_slot"),
        F.col("version").alias("map_version"),
    )
