"""Measures of each cycle graph (a bundle's edges). Times are microseconds, durations in results are seconds; what has no value is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def graph_counts(bundle_edges: DataFrame, key: str = "bundle") -> DataFrame:
    """nodes, edges, begin, end, duration, rate (edges / nodes / seconds)."""
    ends = bundle_edges.select(key, F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy(key).agg(F.count("*").alias("nodes"))
    edges = bundle_edges.groupBy(key).agg(F.count("*").alias("edges"), F.min("t").alias("begin"), F.max("t").alias("end"))
    duration = (F.col("end") - F.col("begin")) / F.lit(1e6)
    return edges.join(ends, key).withColumn("duration", duration).withColumn("rate", F.when(duration > 0, F.col("edges") / F.col("nodes") / duration))


def dwell_times(bundle_edges: DataFrame, key: str = "bundle") -> DataFrame:
    """key, intermediate, sender, dwell: from each arrival to every departure after it, up to the sender's next arrival inclusive."""
    e = bundle_edges.where("src <> dst").select(key, "src", "dst", "t")
    arrivals = e.withColumn("next_t", F.lead("t").over(W.partitionBy(key, "src", "dst").orderBy("t"))).withColumnsRenamed({key: "_k", "src": "sender", "dst": "intermediate", "t": "t_in"})
    met = arrivals.join(e, (F.col("_k") == F.col(key)) & (F.col("intermediate") == F.col("src")) & (F.col("t") > F.col("t_in")) & (F.col("next_t").isNull() | (F.col("t") <= F.col("next_t"))))
    return met.select(key, "intermediate", "sender", ((F.col("t") - F.col("t_in")) / F.lit(1e6)).alias("dwell"))


def aggregate_dwell(dwell: DataFrame, aggregator: Callable[[str], Column] | None = F.min, key: str = "bundle") -> DataFrame:
    """One value for each (intermediate, sender); without an aggregator the sorted list."""
    how = aggregator("dwell") if aggregator else F.sort_array(F.collect_list("dwell"))
    return dwell.groupBy(key, "intermediate", "sender").agg(how.alias("dwell"))


def dwell_statistics(bundle_edges: DataFrame, aggregator: Callable[[str], Column] = F.min, key: str = "bundle") -> DataFrame:
    """avg_dwell (mean over pairs) and burstiness (sigma - mu) / (sigma + mu) with the population's sigma, 0 when both are equal."""
    per_pair = aggregate_dwell(dwell_times(bundle_edges, key), aggregator, key)
    stats = per_pair.groupBy(key).agg(F.avg("dwell").alias("avg_dwell"), F.stddev_pop("dwell").alias("sigma"))
    mu, sigma = F.col("avg_dwell"), F.col("sigma")
    return stats.select(key, "avg_dwell", F.when(sigma == mu, 0.0).otherwise((sigma - mu) / (sigma + mu)).alias("burstiness"))


def price_delta(bundle_edges: DataFrame, key: str = "bundle") -> DataFrame:
    """Sum of last minus first price of the tokens with several prices, over the number of all tokens."""
    at = F.struct("t", "price_usd")
    tokens = bundle_edges.groupBy(key, "token_id").agg(F.count("*").alias("n"), (F.max_by("price_usd", at) - F.min_by("price_usd", at)).alias("delta"))
    several = F.when(F.col("n") > 1, F.col("delta"))
    return tokens.groupBy(key).agg((F.sum(several) / F.count("*")).alias("price_delta"))


def measure(bundle_edges: DataFrame, key: str = "bundle") -> DataFrame:
    """All measures of a graph in one row."""
    return graph_counts(bundle_edges, key).join(dwell_statistics(bundle_edges, key=key), key, "left").join(price_delta(bundle_edges, key), key, "left")
