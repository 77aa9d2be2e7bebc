"""Cycles that overlap in time and share a vertex, and the components they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomcycle.operators.components import connected_components
from loomcycle.session import cut_lineage


def overlap_pairs(cycles: DataFrame, slack: int = 0, closed_end: bool = False) -> DataFrame:
    """(i, j), i < j, of rows (cycle, begin, end, vertices): begin_j - slack < end_i, end_j + slack > begin_i, a shared vertex.

    An equi-join on (vertex, time bucket): a row stands in each bucket that its slackened interval touches, and
    a pair counts in the later of its first buckets only, so a hub's rows spread over time and no pair comes twice
    for one vertex. Buckets are as wide as the widest interval, so a row stands in three at most.
    """
    rows = cycles.select("cycle", "begin", "end", F.explode("vertices").alias("v"))
    width = max(1, int(cycles.agg(F.max(F.col("end") - F.col("begin") + slack)).first()[0] or 0) + 1)
    lo, hi = F.floor(F.col("begin") / width), F.floor((F.col("end") + slack) / width)
    placed = rows.withColumn("lo", lo).withColumn("b", F.explode(F.sequence(lo, hi)))
    a, b = (placed.select(*[F.col(c).alias(f"{c}_{s}") for c in placed.columns]) for s in "ab")
    end_i, end_j = F.col("end_a"), F.col("end_b")
    if closed_end:
        end_i, end_j = end_i + 1, end_j + 1
    near = (F.col("begin_b") - slack < end_i) & (end_j + slack > F.col("begin_a"))
    return (
        a.join(b, (F.col("v_a") == F.col("v_b")) & (F.col("b_a") == F.col("b_b")) & (F.col("cycle_a") < F.col("cycle_b")) & near)
        .where(F.col("b_a") == F.greatest("lo_a", "lo_b"))
        .select(F.col("cycle_a").alias("i"), F.col("cycle_b").alias("j"))
        .distinct()
    )


def cycle_components(cycles: DataFrame, slack: int, keep_single: bool = False) -> DataFrame:
    """(cycle, component): labelled by the smallest cycle; cycles without a partner only if asked for."""
    found = connected_components(overlap_pairs(cycles, slack), "i", "j").withColumnRenamed("node", "cycle")
    if not keep_single:
        return found
    return cycles.select("cycle").join(found, "cycle", "left").select("cycle", F.coalesce("component", "cycle").alias("component"))


def component_aggregates(cycles: DataFrame, labels: DataFrame) -> DataFrame:
    """component, begin, end, avg_duration (seconds), cycles, vertices."""
    rows = cycles.join(labels, "cycle")
    base = rows.groupBy("component").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.avg((F.col("end") - F.col("begin")) / F.lit(1e6)).alias("avg_duration"), F.sort_array(F.collect_list("cycle")).alias("cycles")
    )
    members = rows.select("component", F.explode("vertices").alias("v")).distinct().groupBy("component").agg(F.sort_array(F.collect_list("v")).alias("vertices"))
    return base.join(members, "component")


def component_edges(bundle_edges: DataFrame, numbers: DataFrame, labels: DataFrame) -> DataFrame:
    """component and the edges of its composed graph: those of all its bundles (bundle, cycle), each edge once."""
    placed = bundle_edges.join(numbers, "bundle").join(labels, "cycle")
    return placed.drop("bundle", "cycle", "hop").dropDuplicates(["component", "src", "dst", "t", "edge_key"])


def strongly_connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component, single nodes included.

    Rounds of forward colouring: every node takes the smallest label that reaches it; a label's nodes that
    reach its root backwards within the colour are a component and leave. Each step is an equi-join with
    an aggregation; lineage is cut after it.
    """
    e = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct())
    left = cut_lineage(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            return done
        live = cut_lineage(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        colour = left.select("node", F.col("node").alias("c"))
        while True:
            sent = live.join(colour, live["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut_lineage(colour.join(sent, "node", "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        a, b = (colour.select(F.col("node").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
        within = cut_lineage(live.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("c")))
        found = cut_lineage(colour.where("node = c").select("node", F.col("c").alias("component")))
        fresh = found
        while True:
            back = within.join(fresh.select(F.col("node").alias("dst"), "component"), "dst").select(F.col("src").alias("node"), "component").distinct()
            fresh = cut_lineage(back.join(found, "node", "left_anti"))
            if fresh.isEmpty():
                break
            found = cut_lineage(found.unionByName(fresh))
        done = found if done is None else done.unionByName(found)
        left = cut_lineage(left.join(found, "node", "left_anti"))
    raise RuntimeError(f"not finished after {max_rounds} rounds")


def boundary_table(intervals: DataFrame, chunk: int = 10_000) -> DataFrame:
    """chunk, mean_key, boundaries: how many intervals begin at, or end just before, a time; sorted times in chunks."""
    ends = intervals.select(F.col("begin").alias("key")).union(intervals.select(F.col("end") + 1))
    counts = ends.groupBy("key").agg(F.count("*").alias("n"))
    rank = ranked(counts, "key")
    return rank.groupBy(F.floor((F.col("rank") - 1) / chunk).alias("chunk")).agg(F.avg("key").alias("mean_key"), F.sum("n").alias("boundaries"))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with rank 1..n by a key: numbers within range partitions plus the sizes of those before."""
    parts = cut_lineage(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    inside = parts.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    offset = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return inside.join(F.broadcast(sizes.select("_part", offset.alias("_before"))), "_part").withColumn("rank", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def first_per_group(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each group in the order (begin, end descending)."""
    w = W.partitionBy(*by).orderBy("begin", F.desc("end"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
