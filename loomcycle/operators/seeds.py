"""Seeds: a root, an interval in which walks return to it, and the vertices on them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F

from loomcycle.operators import blocks
from loomcycle.session import Stage, cut_lineage, shares_of, written


def _in_blocks(edges: DataFrame, omega: int, max_hops: int | None, most: int, on_disk: bool = False) -> tuple[Stage, DataFrame, int] | None:
    """The edges, written once unless they are on disk already, and the tasks a block; None if two neighbouring windows hold too many for one task, or rounds are counted."""
    kinds = dict(edges.dtypes)
    if max_hops is not None or kinds["t"] != "bigint" or kinds["src"] != kinds["dst"] or kinds["src"] not in ("bigint", "string"):
        return None
    stage = Stage(edges.sparkSession)
    e = edges.where("src <> dst AND t IS NOT NULL").select("src", "dst", "t")
    e = e if on_disk else stage.put(e)
    largest = e.groupBy(F.floor(F.col("t") / omega).alias("b")).count().agg(F.max("count")).first()[0] or 0
    if 2 * largest > most:
        stage.drop()
        return None
    return stage, e, -(-largest // blocks.TASK_EDGES) or 1


def reverse_reachability(edges: DataFrame, omega: int, max_hops: int | None = None, block_edges: int = blocks.BLOCK_EDGES) -> DataFrame:
    """(v, x, tx, ta): a strict path leaves x at tx and first arrives at v at ta, within omega.

    By time blocks in memory; where two windows hold more than block_edges edges, by rounds of joins. If paths are
    still open after max_hops further hops, it raises. The result reads the edges that were written for it.
    """
    if ready := _in_blocks(edges, omega, max_hops, block_edges):
        _, e, tasks = ready
        kind = dict(e.dtypes)["src"]
        return blocks.by_block(e, omega, blocks.arrivals, f"v {kind}, x {kind}, tx bigint, ta bigint", tasks)
    return _by_rounds(edges, omega, max_hops)


def _by_rounds(edges: DataFrame, omega: int, max_hops: int | None) -> DataFrame:
    """Semi-naive: each round extends only what the last one improved. Times ascend, so it ends."""
    e = cut_lineage(edges.where("src <> dst").select("src", "dst", "t").distinct())
    stage = Stage(e.sparkSession)
    step = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("t").alias("_t"), F.floor(F.col("t") / omega).alias("_b"))
    known = e.select(F.col("dst").alias("v"), F.col("src").alias("x"), F.col("t").alias("tx"), F.col("t").alias("ta"), F.lit(1).alias("fresh"))
    buckets = F.expr(f"explode(array(floor(ta / {omega}), floor(ta / {omega}) + 1))")
    meets = F.expr(f"v = _s AND _pb = _b AND _t > ta AND _t < tx + {omega} AND _d <> x")
    first = F.expr("min(struct(ta, fresh)) AS m")  # of equal arrivals the known one wins, so what stays fresh is an improvement
    for hops in count():
        met = known.where("fresh = 1").withColumn("_pb", buckets).join(step, meets)
        both = known.selectExpr("v", "x", "tx", "ta", "0 AS fresh").unionAll(met.selectExpr("_d", "x", "tx", "_t", "1"))
        known = stage.put(both.groupBy("v", "x", "tx").agg(first).selectExpr("v", "x", "tx", "m.ta", "m.fresh"))
        if known.where("fresh = 1").isEmpty():
            return known.drop("fresh")
        if hops == max_hops:
            raise RuntimeError(f"paths are still open after {max_hops} hops")


def _from_blocks(ready: tuple[Stage, DataFrame, int], omega: int, found, more: str = "") -> DataFrame:
    stage, e, tasks = ready
    kind = dict(e.dtypes)["src"]
    schema, n = f"root {kind}, begin bigint, end bigint" + more.format(kind=kind), shares_of(e.count())
    with written(e.sparkSession, (blocks.by_block(e, omega, found, schema, tasks, (k, n)) for k in range(n))) as rows:
        out = cut_lineage(rows)
    stage.drop()
    return out


def return_walks(edges: DataFrame, omega: int, max_hops: int | None = None, block_edges: int = blocks.BLOCK_EDGES, on_disk: bool = False) -> DataFrame:
    """(root, begin, end) of every strict walk that leaves a root and returns within omega: no bound on its length, unless max_hops is given.

    Edges that are on disk are not written again.
    """
    if ready := _in_blocks(edges, omega, max_hops, block_edges, on_disk):
        return _from_blocks(ready, omega, blocks.walks)
    return _closed(_by_rounds(edges, omega, max_hops), edges, omega).select("root", "begin", "end").distinct()


def _closed(reach: DataFrame, edges: DataFrame, omega: int) -> DataFrame:
    """root, begin, end, last: the walk leaves the root at begin, and an edge from last brings it back at end."""
    e = edges.where("src <> dst").select("src", "dst", "t").distinct()
    back = reach.join(e, (reach["v"] == e["src"]) & (reach["x"] == e["dst"]) & (e["t"] > reach["ta"]) & (e["t"] < reach["tx"] + omega))
    return back.select(F.col("x").alias("root"), F.col("tx").alias("begin"), F.col("t").alias("end"), F.col("v").alias("last"))


def reachability_seeds(edges: DataFrame, omega: int, max_hops: int | None = None, block_edges: int = blocks.BLOCK_EDGES, on_disk: bool = False) -> DataFrame:
    """root, begin, end, candidates, without looking at any cycle: what the root reaches after leaving at begin and
    what from there still reaches the closing edge's source before end; root and that source included.

    A closed walk holds a simple cycle with the same first and last edge, so the intervals are just those of all
    cycles; the candidates are all of their vertices, and at times more. Edges that are on disk are not written again.
    """
    if ready := _in_blocks(edges, omega, max_hops, block_edges, on_disk):
        return _from_blocks(ready, omega, blocks.seeds, ", candidates array<{kind}>")
    reach = _by_rounds(edges, omega, max_hops)
    closed = cut_lineage(_closed(reach, edges, omega).distinct())
    onward = reach.select(F.col("v").alias("_v"), F.col("x").alias("c"), F.col("tx").alias("_tc"), F.col("ta").alias("_ta"), F.floor(F.col("tx") / omega).alias("_b"))
    bucket = F.floor(F.col("begin") / omega)
    near = closed.withColumn("_pb", F.explode(F.array(bucket, bucket + 1)))
    still = near.join(onward, (F.col("last") == F.col("_v")) & (F.col("_pb") == F.col("_b")) & (F.col("_tc") > F.col("begin")) & (F.col("_ta") < F.col("end")) & (F.col("c") != F.col("root")))
    latest = still.groupBy("root", "begin", "end", "c").agg(F.max("_tc").alias("leaves"))
    reached = reach.select(F.col("x").alias("root"), F.col("tx").alias("begin"), F.col("v").alias("c"), "ta")
    inner = latest.join(reached, ["root", "begin", "c"]).where("ta < leaves").select("root", "begin", "end", "c")
    ends = closed.select("root", "begin", "end", F.explode(F.array("root", "last")).alias("c"))
    return inner.unionByName(ends).groupBy("root", "begin", "end").agg(F.array_sort(F.collect_set("c")).alias("candidates"))


def raw_seeds(cycles: DataFrame) -> DataFrame:
    """root, begin, end, candidates: the vertices of all cycles with that root, start and end."""
    found = cycles.select("root", F.col("t_start").alias("begin"), F.col("t_end").alias("end"), F.explode("path").alias("c")).distinct()
    return found.groupBy("root", "begin", "end").agg(F.sort_array(F.collect_list("c")).alias("candidates"))


def combined_seeds(seeds: DataFrame, omega: int) -> DataFrame:
    """root, begin, end, next_begin, candidates: greedy groups in the order (begin, end descending).

    A seed joins the open group if it ends before the group's begin + omega; else the group closes, and its
    next_begin is that seed's begin. The last group's next_begin is its begin + omega. A gap of omega between
    begins closes any group, so the fold runs over the stretches between such gaps, not over a whole root.
    """
    order = W.partitionBy("root").orderBy("begin", F.desc("end"))
    gaps = seeds.withColumn("new", F.coalesce(F.col("begin") - F.lag("begin").over(order) >= omega, F.lit(True)).cast("int"))
    gaps = gaps.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    gaps = gaps.withColumn("follow", F.lead("begin").over(order))
    rows = gaps.groupBy("root", "island").agg(
        F.sort_array(F.collect_list(F.struct("begin", (-F.col("end")).alias("minus_end"), "candidates"))).alias("s"), F.max_by("follow", F.struct("begin", -F.col("end"))).alias("follow")
    )
    group = lambda x: F.struct(x["begin"].alias("begin"), (-x["minus_end"]).alias("end"), x["candidates"].alias("candidates"))

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], -x["minus_end"]).alias("end"), F.array_union(last["candidates"], x["candidates"]).alias("candidates"))
        return F.when(-x["minus_end"] < last["begin"] + omega, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(group(x))))

    groups = rows.select("root", "follow", F.aggregate(F.slice("s", 2, F.size("s")), F.array(group(F.col("s")[0])), add).alias("g"))
    flat = groups.select("root", "follow", "g", F.posexplode("g").alias("i", "x"))
    following = F.coalesce(F.try_element_at("g", F.col("i") + 2)["begin"], F.col("follow"), F.col("x.begin") + omega)
    return flat.select("root", F.col("x.begin").alias("begin"), F.col("x.end").alias("end"), following.alias("next_begin"), F.array_sort("x.candidates").alias("candidates"))


def primed(seeds: DataFrame, now: int | None, omega: int) -> DataFrame:
    """Seeds that no later edge can change: they end by now - omega; None takes all."""
    return seeds if now is None else seeds.where(F.col("end") <= now - omega)


def enveloped(intervals: DataFrame, lo: int, hi: int) -> DataFrame:
    """Intervals wholly within [lo, hi]."""
    return intervals.where((F.col("begin") >= lo) & (F.col("end") <= hi))


def seed_subgraph(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each seed: within [begin, end], both ends among its candidates, by equi-joins on (seed, vertex)."""
    keyed = seeds.withColumn("seed_id", F.concat_ws("|", "root", "begin"))
    member = keyed.select("seed_id", F.explode("candidates").alias("m"))
    span = keyed.select("seed_id", F.col("root").alias("seed_root"), "begin", "end", F.explode("candidates").alias("s"))
    out = span.join(edges, (F.col("s") == F.col("src")) & F.col("t").between(F.col("begin"), F.col("end")))
    return out.join(member.withColumnRenamed("seed_id", "m_id"), (F.col("seed_id") == F.col("m_id")) & (F.col("dst") == F.col("m")), "left_semi").drop("s")
