"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a 64-bit ring; a row belongs to the first point at or after its
hash. Rows of one arc are ranked by (hash, ties); how many rows an arc holds is all the driver needs
(shards * vnodes numbers, whatever the input's size) to send what overflows a full shard clockwise.
Capacities differ by one at most and add up to the number of rows, so every shard ends exactly full.

Ranks within an arc come from range partitions of (arc, hash, ties, row): numbers within a partition plus
the sizes of the arc's parts before it, so an arc, or one row repeated in a third of the table, is many tasks.

Defined cases: a null text has no bytes and the CRC of the empty text; a very long text is read once, for its
size and CRC. A null doc_id is placed by its text's hash instead. Repeated rows take neighbouring ranks. An
empty table gives an empty result. Further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window as W, functions as F

from loomcycle.session import cut_lineage

VNODES = 96
_MASK = (1 << 64) - 1


def _point(shard: int, k: int) -> int:
    """A fixed place on the ring (a 64-bit finaliser of shard and number)."""
    x = (shard * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & _MASK
    for _ in range(2):
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) - (1 << 63)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) in ring order; points are signed 64-bit numbers."""
    return sorted((_point(s, k), s) for s in range(shards) for k in range(vnodes))


def spill(counts: list[int], owners: list[int], caps: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc, (first rank, shard, first slot) pieces.

    Arcs are served in ring order; what an arc's shard can't take goes on to the next arcs' shards.
    First every arc fills its own shard, then overflow travels, so a row moves only if its shard is full.
    """
    free, taken = list(caps), [0] * len(caps)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    over: list[tuple[int, int]] = []
    for arc, (n, shard) in enumerate(zip(counts, owners)):
        take = min(n, free[shard])
        if take:
            pieces[arc].append((0, shard, taken[shard]))
            free[shard] -= take
            taken[shard] += take
        if n > take:
            over.append((arc, take))
    for arc, rank in over:
        left, at = counts[arc] - rank, arc
        while left:
            at = (at + 1) % len(owners)
            shard = owners[at]
            if take := min(left, free[shard]):
                pieces[arc].append((rank, shard, taken[shard]))
                free[shard] -= take
                taken[shard] += take
                rank += take
                left -= take
    return pieces


def even_caps(total: int, shards: int) -> list[int]:
    low, more = divmod(total, shards)
    return [low + (s < more) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: row counts of shards at most one apart."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col).cast("long"))).alias("h"),
    )
    ends = np.array([p for p, _ in points], np.int64)

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:  # a binary search over a ring of fixed size
        return pd.Series((np.searchsorted(ends, h.to_numpy(np.int64)) % len(ends)).astype(np.int32))

    order = ["h", F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "row_no"]
    ranged = rows.withColumns({"arc": arc("h"), "row_no": F.monotonically_increasing_id()}).repartitionByRange("arc", *order)
    placed = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part", "arc").agg(F.count("*").alias("n"))  # an arc's parts are neighbours: at most parts + arcs rows
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("arc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("ahead", ahead)
    counted = {r["arc"]: r["count"] for r in placed.groupBy("arc").count().collect()}  # at most shards * vnodes rows
    counts = [counted.get(i, 0) for i in range(len(points))]
    pieces = spill(counts, [s for _, s in points], even_caps(sum(counts), shards))
    table = spark.createDataFrame(
        [(a, lo, hi, s, slot) for a, ps in enumerate(pieces) for (lo, s, slot), hi in zip(ps, [p[0] for p in ps[1:]] + [counts[a]])],
        "arc int, lo long, hi long, shard int, slot0 long",
    ).groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard", "slot0"))).alias("pieces"))
    rank = F.row_number().over(W.partitionBy("part", "arc").orderBy(*order)).cast("long") - 1
    ranked = placed.withColumn("inside", rank).join(sizes, ["part", "arc"]).withColumn("rank", F.col("inside") + F.col("ahead")).join(F.broadcast(table), "arc")  # one row per arc: a fixed bound
    piece = F.element_at(F.filter("pieces", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)
    return ranked.withColumn("piece", piece).select(
        "doc_id", "size", "text_crc32", F.col("piece.shard").alias("shard"), (F.col("piece.slot0") + F.col("rank") - F.col("piece.lo")).alias("slot")
    )
