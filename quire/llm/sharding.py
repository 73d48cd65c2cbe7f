"""Consistent-hash ring with virtual nodes and bounded loads.

Keys hash onto a ring of ``CELLS`` equal arcs.  Every shard owns several points on the ring
and takes the keys that lie before its points, clockwise.  A shard takes at most its quota;
what overflows continues clockwise to the next point whose shard has room.  The quotas are
floor or ceiling of rows / shards, so that counts differ by at most one.

Only counts per cell (a fixed number) reach the driver.  The rows are ranked within their
cell, and a table of slices (cell, first rank, shard, first slot), bounded by cells + shards,
turns ranks into shards and slots.  Texts are never shuffled.

Defined results: a null text has size 16 and checksum 0; a row without doc_id is placed by its
text's checksum; repeated rows take separate slots; an empty table gives an empty result;
other columns are left out of the result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import row_id, whole_text

CELL_BITS = 15
CELLS = 1 << CELL_BITS
POINTS_PER_SHARD = 64


def ring_points(shards: int, points: int = POINTS_PER_SHARD) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.  A new shard adds points and moves none."""
    where = lambda s, k: int.from_bytes(hashlib.sha256(f"{s}:{k}".encode()).digest()[:8], "big") >> (64 - CELL_BITS)
    return sorted((where(s, k), s) for s in range(shards) for k in range(points))


def deal_cells(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Slices (cell, first rank, shard, slot of the first rank) by the bounded-load rule."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken = [0] * shards
    points = ring_points(shards)
    onward = list(range(len(points)))  # leads to the next point with room

    def with_room(p: int) -> int:
        trail = []
        while taken[points[p][1]] >= room[points[p][1]]:
            trail.append(p)
            p = (p + 1) % len(points) if onward[p] == p else onward[p]
        for q in trail:
            onward[q] = p
        return p

    slices, home = [], 0
    for cell in sorted(counts):
        while home < len(points) and points[home][0] < cell:
            home += 1
        rank, left, at = 0, counts[cell], home % len(points)
        while left:
            at = with_room(at)
            shard = points[at][1]
            n = min(left, room[shard] - taken[shard])
            slices.append((cell, rank, shard, taken[shard]))
            taken[shard] += n
            rank, left = rank + n, left - n
    return slices


def place(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    text = whole_text()
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.col("text_crc32")))
    keyed = sized.withColumn("key_hash", key).withColumn("cell", F.shiftrightunsigned("key_hash", 64 - CELL_BITS).cast("int"))
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    slices = spark.createDataFrame(deal_cells(counts, shards), "cell int, first_rank long, shard int, first_slot long")
    per_cell = slices.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("first_rank", "shard", "first_slot"))).alias("parts"))

    order = Window.partitionBy("cell").orderBy("key_hash", row_id(), "text_crc32", "size")
    ranked = keyed.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    part = F.element_at(F.filter("parts", lambda p: p["first_rank"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(per_cell), "cell")  # at most CELLS rows, whatever the input
        .withColumn("part", part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("part.shard").alias("shard"),
            (F.col("part.first_slot") + F.col("rank") - F.col("part.first_rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
