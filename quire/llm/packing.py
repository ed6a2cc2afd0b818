"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Only the histogram of piece lengths, at most one count for each length up to the capacity,
is packed on the driver: lengths are placed longest first, each into the open packs that are
emptiest, all packs of one pattern at once. The result is a list of patterns with counts.
Pieces then find their place by rank: the r-th piece of a length takes the r-th place that
the patterns offer to that length. Ranks are made in two steps, within (length, salt) and
by the counts before it, so a length that holds a third of all pieces is split too.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import crc, loaded
from quire.llm.common import per_batch, slices, stored

CAPACITY = 4096
#: Parts in which the pieces of one length are ranked.
SALTS = 64


def packed_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of each pattern, for the number of pieces of each length.

    Open packs are kept by the room they have left. For each length, longest first, packs
    with the most room are extended first ("shortest pack"); when none has enough, the rest
    of the pieces open packs of their own.
    """
    room: list[list[list]] = [[] for _ in range(capacity + 1)]  # by space left: [times, lengths]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        space = capacity
        while left > 0:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                room[capacity - length].append([left, (length,)])
                break
            pack = room[space][-1]
            times = min(left, pack[0])
            room[space - length].append([times, (*pack[1], length)])
            pack[0] -= times
            left -= times
            if not pack[0]:
                room[space].pop()
    return [(times, lengths) for packs in room for times, lengths in packs]


class Places:
    """Where the r-th piece of each length goes; a few arrays, as long as all patterns together."""

    def __init__(self, patterns: Iterable[tuple[int, tuple[int, ...]]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for times, lengths in patterns:
            offset = 0
            for length in lengths:
                at = taken.get(length, 0)
                rows.append((length << 40 | at, sequence, offset))
                taken[length] = at + times
                offset += length
            sequence += times
        rows.sort()
        self.keys = np.array([r[0] for r in rows], dtype=np.int64)
        self.sequence = np.array([r[1] for r in rows], dtype=np.int64)
        self.offset = np.array([r[2] for r in rows], dtype=np.int64)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << 40 | rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[at] + (key - self.keys[at]), self.offset[at]


def pieces(docs: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document's ids, then ``end``, cut at
    multiples of the capacity. A null text counts as empty and leaves ``end`` alone."""
    last = end.to_bytes(4, "little")

    def run(batches):
        coder = loaded(path)
        for b in slices(batches, "text", 1 << 20):  # the words of all its texts are held at once
            rows = []
            for i, ids in zip(b.column("id").to_pylist(), coder.encode_batch(b.column("text").to_pylist()), strict=True):
                ids += last
                n = len(ids) // 4
                rows += [(i, at, min(capacity, n - at), crc(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(source, run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token ids of all documents into sequences of at most ``capacity``.

    Ids may be null or repeat (equal pieces take different places); a null or empty text is
    one piece that holds only the end token; texts longer than the capacity are cut into full
    sequences and a rest; other columns are not read; an empty table gives an empty result.
    Texts are tokenized once; the pieces, without their ids, are stored in the shared folder.

    Returns (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), all long.
    """
    cut = stored(pieces(docs, path, end, capacity, id_col, text_col), "pieces").withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(SALTS)))
    salted = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length
    places = docs.sparkSession.sparkContext.broadcast(Places(packed_histogram(counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = salted.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32"))
    ranked = cut.withColumn("rank", rank).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))

    def run(batches):
        for b in batches:
            sequence, offset = places.value.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    source = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return per_batch(source, run, schema).withColumnRenamed("id", id_col)
