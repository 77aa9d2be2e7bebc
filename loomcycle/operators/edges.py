"""Projections and filters over edge tables (src, dst, t, edge_key, attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def time_slice(edges: DataFrame, begin=None, end=None, nodes: DataFrame | None = None, closed: bool = False) -> DataFrame:
    """[begin, end] if closed, else [begin, end); None is unbounded. Of `nodes` (one column), both ends must be members."""
    if begin is not None:
        edges = edges.where(F.col("t") >= begin)
    if end is not None:
        edges = edges.where(F.col("t") <= end if closed else F.col("t") < end)
    if nodes is not None:
        members = nodes.select(F.col(nodes.columns[0]).alias("_node")).distinct()
        for side in ("src", "dst"):
            edges = edges.join(members, edges[side] == members["_node"], "left_semi")
    return edges


def prune(edges: DataFrame, lower_limit) -> DataFrame:
    """Edges from the limit on; vertices without edges vanish by themselves."""
    return edges.where(F.col("t") >= lower_limit)


def star(edges: DataFrame, vertex) -> DataFrame:
    return edges.where((F.col("src") == vertex) | (F.col("dst") == vertex))


def retime(edges: DataFrame, block: Column | str) -> DataFrame:
    """Replaces the time by a block number and drops all attributes."""
    return edges.select("src", "dst", (F.col(block) if isinstance(block, str) else block).alias("t"))


def from_transactions(rows: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """All other columns stay as attributes."""
    return rows.withColumnsRenamed({source: "src", target: "dst"})


def clean_trades(rows: DataFrame) -> DataFrame:
    """Sales to the buyer with a known price, without the buyer."""
    return rows.where(F.col("buyer").isNotNull() & (F.col("to") == F.col("buyer")) & F.col("price_usd").isNotNull()).drop("buyer")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct()


def vertex_dictionary(edges: DataFrame, start: int = 0) -> DataFrame:
    """(vertex, vertex_id): dense ids by first appearance in (t, edge_key) order, sources before targets.

    Ranks are found by range partitions: a count for each, then numbers within, so no task sees all vertices.
    """
    from loomcycle.operators.overlap import ranked

    ends = edges.select("t", "edge_key", F.lit(0).alias("side"), F.col("src").alias("vertex")).union(edges.select("t", "edge_key", F.lit(1), "dst"))
    first = ends.groupBy("vertex").agg(F.min(F.struct("t", "edge_key", "side")).alias("at"))
    return ranked(first, "at").select("vertex", (F.col("rank") - 1 + start).cast("long").alias("vertex_id"))


def encode(edges: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ids for src and dst; a vertex that the dictionary lacks gives null."""
    for side in ("src", "dst"):
        d = dictionary.select(F.col("vertex").alias("_v"), F.col("vertex_id").alias("_id"))
        edges = edges.join(d, edges[side] == d["_v"], "left").drop(side, "_v").withColumnRenamed("_id", side)
    return edges


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, ts: the sorted distinct times of each pair."""
    return edges.groupBy("src", "dst").agg(F.sort_array(F.collect_set("t")).alias("ts"))


def blocks(edges: DataFrame) -> DataFrame:
    """t, dst, sources (duplicates kept, sorted), n_sources: edges of one time and target."""
    return edges.groupBy("t", "dst").agg(F.sort_array(F.collect_list("src")).alias("sources"), F.count("*").alias("n_sources"))


def compose(edges: DataFrame) -> DataFrame:
    """Union of edges by identity (src, dst, t, edge_key)."""
    return edges.dropDuplicates(["src", "dst", "t", "edge_key"])


def quantile_filter(rows: DataFrame, column: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Rows up to the exact quantile, overall or in each group."""
    keys = by or []
    limits = rows.groupBy(*keys).agg(F.percentile(column, q).alias("_limit"))
    joined = rows.join(limits, keys) if keys else rows.crossJoin(F.broadcast(limits))  # without keys, one row
    return joined.where(F.col(column) <= F.col("_limit")).drop("_limit")


def edge_count(edges: DataFrame) -> DataFrame:
    """One row: edges. Parquet answers it from its footers."""
    return edges.agg(F.count("*").alias("edges"))


def of_size(features: DataFrame, nodes: tuple = (None, None), edges: tuple = (None, None)) -> DataFrame:
    """Graphs (rows with nodes and edges) whose sizes lie within the bounds, both included; None is open."""
    for column, (lo, hi) in (("nodes", nodes), ("edges", edges)):
        if lo is not None:
            features = features.where(F.col(column) >= lo)
        if hi is not None:
            features = features.where(F.col(column) <= hi)
    return features
