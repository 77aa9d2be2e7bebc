"""Reachability summaries as relations (v, x, t): a walk leaves x at t and reaches v. Immutable: every operation gives a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COLUMNS = ["v", "x", "t"]


def add(summary: DataFrame, points: DataFrame) -> DataFrame:
    """With more (v, x, t) points; repeated points count once."""
    return summary.select(*COLUMNS).unionByName(points.select(*COLUMNS)).distinct()


def merge(summary: DataFrame, source: DataFrame, into: DataFrame) -> DataFrame:
    """Each vertex b of `into` (a, b) also gets what its neighbour a has in `source`."""
    moved = source.join(into, source["v"] == into["a"]).select(F.col("b").alias("v"), "x", "t")
    return add(summary, moved)


def exclude(summary: DataFrame) -> DataFrame:
    """Without the points of a vertex itself."""
    return summary.where(F.col("v") != F.col("x"))


def cut(summary: DataFrame, limit, keep_after: bool = True, include: bool = False) -> DataFrame:
    """Points after (or before) a time; the limit itself only if included."""
    t = F.col("t")
    if keep_after:
        return summary.where(t >= limit if include else t > limit)
    return summary.where(t <= limit if include else t < limit)


def series(summary: DataFrame) -> DataFrame:
    """v, x, ts: the sorted times of each vertex in a summary."""
    return summary.groupBy("v", "x").agg(F.sort_array(F.collect_set("t")).alias("ts"))


def sizes(summary: DataFrame) -> DataFrame:
    """v, points, vertices, times."""
    return summary.groupBy("v").agg(F.count("*").alias("points"), F.count_distinct("x").alias("vertices"), F.count_distinct("t").alias("times"))
