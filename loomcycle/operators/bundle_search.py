"""Bundled search: whole bundles grow hop by hop, so rows count vertex paths, not choices among parallel edges.

Each seed's subgraph becomes an adjacency of sorted time arrays. A row carries its path and the times of each
hop that follow some time of the hop before; when the path closes, one backward pass leaves just the times on
some strict cycle. A combined seed is shorter than omega, so every choice within it is. Hubs with thousands of
parallel edges cost one array here; the enumeration in `cycles` costs a row for each choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomcycle.functions.sequences import cardinality, trim
from loomcycle.operators.cycles import HOPS_A_CHECKPOINT, warn_if_open
from loomcycle.operators.seeds import seed_subgraph
from loomcycle.session import Stage, cut_lineage, share


def bundled_cycles(edges: DataFrame, seeds: DataFrame, max_length: int | None = None, shares: int = 1) -> DataFrame:
    """root, begin, end, path, length, bundle (sorted distinct times of each hop), cardinality, for combined seeds.

    Cardinality counts ascending choices of one edge a hop, parallel edges of one time apart. A max_length that
    leaves paths open gives a warning. The seeds' edges are taken in so many shares by source, each of which reads `edges`.
    """
    if max_length is not None and max_length < 2:
        raise ValueError("max_length is below 2")
    kept, stage = (Stage(edges.sparkSession) for _ in range(2))  # open paths of finished rounds leave the disk
    parts = (edges.where("src <> dst") if shares == 1 else edges.where("src <> dst").where(share("src", k, shares)) for k in range(shares))
    adjacency = kept.put_shares(seed_subgraph(seeds, part).groupBy("seed_id", "src", "dst").agg(F.sort_array(F.collect_list("t")).alias("ts")) for part in parts)
    step = adjacency.select(F.col("seed_id").alias("_seed"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("ts").alias("_ts"))
    keyed = seeds.select(F.concat_ws("|", "root", "begin").alias("seed_id"), "root", "begin", "end", "next_begin")
    starts = keyed.join(adjacency, "seed_id").where(F.col("src") == F.col("root"))
    first = F.filter("ts", lambda t: t < F.col("next_begin"))
    rows = starts.select("seed_id", "root", "begin", "end", F.array("root").alias("path"), F.col("dst").alias("cur"), F.array(first).alias("bundle"), F.lit(False).alias("closed")).where(F.size(F.col("bundle")[0]) > 0)
    found, length = None, 1
    while True:
        for _ in range(HOPS_A_CHECKPOINT if max_length is None else min(HOPS_A_CHECKPOINT, max_length - length)):
            length += 1
            rows = _hop(rows, step, length == max_length)
        rows = stage.put(rows)
        closed = cut_lineage(rows.where("closed").select("root", "begin", "end", "path", F.size("path").alias("length"), trim(F.col("bundle")).alias("bundle")))
        found = closed if found is None else found.unionByName(closed)
        rows = rows.where("not closed")
        if length == max_length or rows.isEmpty():
            break
    kept.drop()
    stage.drop()
    return found.withColumn("cardinality", cardinality(F.col("bundle"))).withColumn("bundle", F.transform("bundle", F.array_distinct))


def _hop(rows: DataFrame, step: DataFrame, last: bool) -> DataFrame:
    """Open paths with one more hop; closed ones pass through the outer join."""
    met = rows.join(step, F.expr("NOT closed AND seed_id = _seed AND cur = _src"), "left").withColumn("_after", F.expr("filter(_ts, t -> t > array_min(element_at(bundle, -1)))"))
    goes_on = "NOT closed AND size(_after) > 0 AND _dst <> root AND NOT array_contains(path, _dst)"
    closes = "closed OR (size(_after) > 0 AND _dst = root)"
    if last:
        warn_if_open(met.where(goes_on))
    grow = lambda name, value: f"if(closed, {name}, array_append({name}, {value})) AS {name}"
    return met.where(closes if last else f"{closes} OR ({goes_on})").selectExpr("seed_id", "root", "begin", "end", grow("path", "cur"), "coalesce(_dst, cur) AS cur", grow("bundle", "_after"), "closed OR _dst = root AS closed")
