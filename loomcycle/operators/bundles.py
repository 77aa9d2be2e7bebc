"""Bundles: all cycles of a seed along one vertex path, as sets of times per hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["root", "begin", "end", "path"]


def assign(cycles: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cycles with begin and end of the one combined seed whose [begin, next_begin) holds their start."""
    s = seeds.select(F.col("root").alias("_root"), "begin", "end", "next_begin")
    return cycles.join(s, (F.col("root") == F.col("_root")) & (F.col("t_start") >= F.col("begin")) & (F.col("t_start") < F.col("next_begin"))).drop("_root", "next_begin")


def bundles(assigned: DataFrame) -> DataFrame:
    """root, begin, end, path, length, bundle (sorted times of each hop), cardinality (cycles, parallel edges apart)."""
    hops = assigned.select(*KEY, F.posexplode("times").alias("hop", "t")).distinct()
    per_hop = hops.groupBy(*KEY, "hop").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    shape = per_hop.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("hop", "ts"))).alias("h")).select(*KEY, F.size("path").alias("length"), F.transform("h", lambda x: x["ts"]).alias("bundle"))
    return shape.join(assigned.groupBy(*KEY).agg(F.count("*").alias("cardinality")), KEY)


def bundle_id() -> F.Column:
    return F.concat_ws("|", "root", "begin", F.array_join("path", ">"))


def to_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge of a bundle with its attributes: any parallel edge whose time is among its hop's times."""
    hops = found.select(bundle_id().alias("bundle"), "root", "path", F.posexplode("bundle").alias("hop", "ts"))
    target = F.when(F.col("hop") + 1 < F.size("path"), F.try_element_at("path", F.col("hop") + 2)).otherwise(F.col("root"))
    flat = hops.select("bundle", "hop", F.element_at("path", F.col("hop") + 1).alias("_s"), target.alias("_d"), F.explode("ts").alias("_t"))
    return flat.join(edges, (F.col("_s") == edges["src"]) & (F.col("_d") == edges["dst"]) & (F.col("_t") == edges["t"])).drop("_s", "_d", "_t")


def path_bundle(bundle_edges: DataFrame) -> DataFrame:
    """Back from edges to root, path and times per hop; the root is the source of the earliest edge."""
    hops = bundle_edges.groupBy("bundle", "hop").agg(F.first("src").alias("v"), F.sort_array(F.collect_set("t")).alias("ts"))
    shape = hops.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("hop", "v", "ts"))).alias("h"))
    roots = bundle_edges.groupBy("bundle").agg(F.min_by("src", "t").alias("root"))
    return shape.join(roots, "bundle").select("bundle", "root", F.transform("h", lambda x: x["v"]).alias("path"), F.transform("h", lambda x: x["ts"]).alias("bundle_times"))
