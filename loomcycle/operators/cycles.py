"""Simple temporal cycles: strictly ascending times, span below omega, each vertex once.

One equi-join a hop. The key is the path's last vertex and a time bucket of width omega: a next edge lies in
the bucket of the last time or the one after, so a hub's edges spread over its buckets, and the exact bounds
are residual predicates. Only edges whose source is reached again by a walk within omega start a path, and no
path lasts longer than the latest such time.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

from loomcycle.operators.seeds import return_walks
from loomcycle.session import Stage, cut_lineage

HOPS_A_CHECKPOINT = 4


def returning_edges(edges: DataFrame, omega: int, on_disk: bool = False) -> DataFrame:
    """Edges whose source is reached again by a strict walk within omega, with t_close, the latest such time.

    t_close bounds every path from the edge: what would be later can't return any more.
    """
    walks = return_walks(edges, omega, on_disk=on_disk).groupBy(F.col("root").alias("src"), F.col("begin").alias("t")).agg(F.max("end").alias("t_close"))
    return edges.join(walks, ["src", "t"])


def temporal_cycles(edges: DataFrame, omega: int, max_length: int | None = None, min_length: int = 2, on_disk: bool = False) -> DataFrame:
    """root, t_start, t_end, length, path, times, edge_keys of every cycle of min_length edges at least.

    Times ascend and no vertex repeats, so the search ends by itself. A max_length stops it earlier, with a
    warning if paths are still open then; where just one length is asked for, nothing is lost. Edges that are on disk
    are not written again.
    """
    if max_length is not None and max_length < min_length:
        raise ValueError("max_length is below min_length")
    kept, stage = (Stage(edges.sparkSession) for _ in range(2))  # open paths of finished rounds leave the disk
    edges = edges.select("src", "dst", "t", "edge_key").where(F.col("src") != F.col("dst"))
    edges = edges if on_disk else kept.put(edges)
    step = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("t").alias("_t"), F.col("edge_key").alias("_key"), F.floor(F.col("t") / omega).alias("_b"))
    rows = returning_edges(edges, omega, on_disk=True).select(
        F.col("src").alias("root"), F.col("t").alias("t_start"), F.col("t").alias("t_end"), "t_close", F.col("dst").alias("cur"), F.array("src").alias("path"), F.array("t").alias("times"), F.array("edge_key").alias("edge_keys"), F.lit(False).alias("closed")
    )
    hop, found, length = _Hop(step, omega), None, 1
    while True:
        for _ in range(HOPS_A_CHECKPOINT if max_length is None else min(HOPS_A_CHECKPOINT, max_length - length)):
            length += 1
            rows = hop(rows, length == max_length, warn=length == max_length > min_length)
        rows = stage.put(rows)
        closed = cut_lineage(rows.where(F.col("closed") & (F.size("path") >= min_length)).select("root", "t_start", "t_end", F.size("path").alias("length"), "path", "times", "edge_keys"))
        found = closed if found is None else found.unionByName(closed)
        rows = rows.where("not closed")
        if length == max_length or rows.isEmpty():
            kept.drop()
            stage.drop()
            return found


class _Hop:
    """Open paths with one more edge; closed ones pass through the outer join, so hops chain without a union.

    The expressions are built once: a round trip for each would cost more than a small hop.
    """

    def __init__(self, step: DataFrame, omega: int):
        self.step = step
        self.buckets = F.expr(f"explode(if(closed, array(floor(t_end / {omega})), array(floor(t_end / {omega}), floor(t_end / {omega}) + 1)))")
        self.meets = F.expr("NOT closed AND cur = _src AND _pb = _b AND _t > t_end AND _t <= t_close")
        self.open = "NOT closed AND _dst <> root AND NOT array_contains(path, _dst) AND _t < t_close"
        self.keep = f"closed OR _dst = root OR ({self.open})"
        grow = lambda name, value: f"if(closed, {name}, array_append({name}, {value})) AS {name}"
        self.columns = ["root", "t_start", "coalesce(_t, t_end) AS t_end", "t_close", "coalesce(_dst, cur) AS cur", grow("path", "cur"), grow("times", "_t"), grow("edge_keys", "_key"), "closed OR _dst = root AS closed"]

    def __call__(self, rows: DataFrame, last: bool, warn: bool) -> DataFrame:
        met = rows.withColumn("_pb", self.buckets).join(self.step, self.meets, "left")
        if warn:
            warn_if_open(met.where(self.open))
        return met.where("closed OR _dst = root" if last else self.keep).selectExpr(*self.columns)


def warn_if_open(paths: DataFrame) -> None:
    if not paths.isEmpty():
        warnings.warn("paths are still open at max_length: longer cycles may be missing", stacklevel=4)


def temporal_digons(edges: DataFrame) -> DataFrame:
    """u -> v at t1, then v -> u at t2 > t1."""
    a, b = (edges.select(*[F.col(c).alias(f"{c}_{s}") for c in ("src", "dst", "t")]) for s in "ab")
    return a.join(b, (F.col("dst_a") == F.col("src_b")) & (F.col("dst_b") == F.col("src_a")) & (F.col("t_b") > F.col("t_a"))).select(F.col("src_a").alias("u"), F.col("dst_a").alias("v"), F.col("t_a").alias("t1"), F.col("t_b").alias("t2"))


def temporal_triangles(edges: DataFrame, omega: int, chordless: bool = True) -> DataFrame:
    """u -> v -> w -> u with ascending times within omega; chordless ones have no two neighbours joined both ways."""
    found = temporal_cycles(edges, omega, 3, 3).select("root", "path", "times")
    u, v, w = (F.col("path")[i] for i in range(3))
    rows = found.select(u.alias("u"), v.alias("v"), w.alias("w"), *[F.col("times")[i].alias(f"t{i + 1}") for i in range(3)])
    if chordless:
        pairs = edges.select("src", "dst").distinct()
        for a, b in (("u", "v"), ("v", "w"), ("w", "u")):  # an edge against the direction of the cycle
            rows = rows.join(pairs, (F.col(b) == pairs["src"]) & (F.col(a) == pairs["dst"]), "left_anti")
    return rows
