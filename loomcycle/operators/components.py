"""Connected components of an undirected graph by alternating large and small stars.

Each half-round replaces edges by stars around the smallest neighbour, which takes a logarithmic number
of rounds; every round is two aggregations with map-side combine and two equi-joins, so hubs are split
by the skew join instead of gathering in a task. Only the last round's edges and shuffles stay on disk.

At most LOCAL_EDGES edges - a count that is checked, a few ten MB - are joined by one task's union-find
instead: rounds of small shuffles would cost more than the graph.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcycle.session import Stage, cut_lineage


LOCAL_EDGES = 1_000_000


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) of the task, for integer or text nodes."""
    table = [(b.column(0), b.column(1)) for b in batches]
    if not sum(len(u) for u, _ in table):
        return
    ends = [pa.concat_arrays([pair[k] for pair in table]).to_numpy(zero_copy_only=False) for k in (0, 1)]
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)  # in order, so the smallest place is the smallest node
    up = list(range(len(nodes)))
    half = len(ends[0])
    for a, b in zip(place[:half].tolist(), place[half:].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    roots = np.array(up)
    while (roots[roots] != roots).any():
        roots = roots[roots]
    kind = table[0][0].type
    for at in range(0, len(nodes), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part], kind), pa.array(nodes[roots[part]], kind)], names=["node", "component"])


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u -> each u's neighbours and u itself point to the smallest of them, for both kinds of star."""
    # small star: neighbours not larger than u
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u")
    small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    # large star: all neighbours larger than u hang on the smallest of the neighbourhood
    both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 64, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): every node that has an edge, labelled by the smallest node reachable."""
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stage, before = Stage(pairs.sparkSession), None
    pairs = stage.put(pairs)
    kind = pairs.schema["u"].dataType.simpleString()
    if kind in ("bigint", "int", "string") and pairs.count() <= local_edges:
        # dealt again, or all that joins the result would start from one partition
        return _kept(pairs.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}").repartition("node"), stage)
    for _ in range(max_rounds):
        # stars whose centres have no edge of their own are components
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before = now
        pairs = stage.put(_star(pairs))
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    centres = pairs.select(F.col("v").alias("node")).distinct()
    return _kept(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.withColumn("component", F.col("node"))), stage)


def _kept(found: DataFrame, stage: Stage) -> DataFrame:
    found = cut_lineage(found)
    stage.drop()
    return found
