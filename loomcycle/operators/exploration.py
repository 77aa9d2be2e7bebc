"""Statistics for exploring edges, runs and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """vertex, out_degree, in_degree, degree."""
    out = edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("out_degree"), F.lit(0).cast("long").alias("in_degree"))
    into = edges.groupBy(F.col("dst").alias("vertex")).agg(F.lit(0).cast("long").alias("out_degree"), F.count("*").alias("in_degree"))
    both = out.unionByName(into).groupBy("vertex").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))
    return both.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def frequent_sources(edges: DataFrame, more_than: int = 1) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree")).where(F.col("out_degree") > more_than)


def gaps(rows: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """Differences of consecutive times in each group."""
    return rows.withColumn("gap", F.col(t) - F.lag(t).over(W.partitionBy(*by).orderBy(t))).where(F.col("gap").isNotNull())


def summary(column: str, prefix: str) -> list[Column]:
    return [F.min(column).alias(f"{prefix}_min"), F.max(column).alias(f"{prefix}_max"), F.avg(column).alias(f"{prefix}_mean"), F.percentile(column, 0.5).alias(f"{prefix}_median")]


def inter_event_times(edges: DataFrame, q: float = 1.0) -> DataFrame:
    """src with min, max, mean and median gap among those up to the group's exact q-quantile."""
    g = gaps(edges, ["src"]).select("src", "gap")
    kept = g.join(g.groupBy("src").agg(F.percentile("gap", q).alias("_q")), "src").where(F.col("gap") <= F.col("_q"))
    return kept.groupBy("src").agg(*summary("gap", "gap"))


def incoming_inter_event_times(edges: DataFrame) -> DataFrame:
    """Mean gap of each (src, dst), summed up again for each dst."""
    pair = gaps(edges, ["src", "dst"]).groupBy("src", "dst").agg(F.avg("gap").alias("gap"))
    return pair.groupBy("dst").agg(*summary("gap", "gap"))


def multiplicity(edges: DataFrame) -> DataFrame:
    """Number of parallel edges of each (src, dst), summed up for each dst."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).groupBy("dst").agg(*summary("n", "edges"))


def graph_features(edges: DataFrame, by: Column, name: str = "bucket") -> DataFrame:
    """Nodes, edges, edges per node and density of each bucket (a file, a day)."""
    e = edges.withColumn(name, by)
    nodes = e.select(name, F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy(name).agg(F.count("*").alias("nodes"))
    n = F.col("nodes")
    found = e.groupBy(name).agg(F.count("*").alias("edges")).join(nodes, name)
    return found.withColumn("edges_per_node", F.col("edges") / n).withColumn("density", F.when(n > 1, F.col("edges") / (n * (n - 1))))


def histogram(rows: DataFrame, column: str, bins: int, lo: float, hi: float) -> DataFrame:
    """bin (1 to bins, the last one closed), count; values outside [lo, hi] are left out."""
    x = F.col(column).cast("double")
    at = F.least(F.floor((x - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    return rows.where((x >= lo) & (x <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))


def adaptive_edges(lo: float, hi: float, bins: int, log_above: float = 20.0) -> list[float]:
    """Bin edges: logarithmic if the range is wide, else of equal width."""
    if hi - lo > log_above and lo > 0:
        return [10 ** (math.log10(lo) + (math.log10(hi) - math.log10(lo)) * k / bins) for k in range(bins + 1)]
    return [lo + (hi - lo) * k / bins for k in range(bins + 1)]


def bin_counts(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Half-open bins by a literal chain of bounds; no join."""
    x, at = F.col(column).cast("double"), F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        at = F.when((x >= edges[k]) & (x < edges[k + 1]), F.lit(k)).otherwise(at)
    return rows.withColumn("bin", at).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))


def time_buckets(rows: DataFrame, index: str, width: int, value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum of a value in each bucket of the index."""
    q = [F.percentile(value, p).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return rows.groupBy(F.floor(F.col(index) / width).alias("bucket")).agg(F.min(value).alias("min"), *q, F.avg(value).alias("mean"), F.max(value).alias("max"))


def rebase(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Column minus its minimum, overall or in each group."""
    keys = by or []
    least = rows.groupBy(*keys).agg(F.min(column).alias("_least"))
    joined = rows.join(least, keys) if keys else rows.crossJoin(F.broadcast(least))  # one row
    return joined.withColumn(column, F.col(column) - F.col("_least")).drop("_least")


def seed_statistics(seeds: DataFrame) -> DataFrame:
    """root, seeds, and mean and longest duration (seconds)."""
    d = (F.col("end") - F.col("begin")) / F.lit(1e6)
    return seeds.groupBy("root").agg(F.count("*").alias("seeds"), F.avg(d).alias("mean_duration"), F.max(d).alias("max_duration"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("count"))


def interpolate(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Fills null y linearly in x between the neighbours that have one; at the ends with the nearest."""
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    # both directions run as growing frames, a step a row; a frame that shrinks would be read again for each row
    back, ahead = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(x), F.desc(x)))
    r = rows.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.last(known, ignorenulls=True).over(ahead))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(x) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    return r.withColumn(y, F.coalesce(F.col(y), F.when(F.col("_b.x") > F.col("_a.x"), line), F.col("_a.y"), F.col("_b.y"))).drop("_a", "_b")


def align_runs(runs: DataFrame, step_ms: int) -> DataFrame:
    """run, grid (multiples of step_ms within the run's time), value: each run interpolated on a common grid."""
    span = runs.groupBy("run").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    grid = span.select("run", F.explode(F.sequence(F.ceil(F.col("lo") / step_ms) * step_ms, F.floor(F.col("hi") / step_ms) * step_ms, F.lit(step_ms))).alias("ms"), F.lit(None).cast("double").alias("value"))
    both = runs.select("run", "ms", F.col("value").cast("double").alias("value")).unionByName(grid.join(runs.select("run", "ms"), ["run", "ms"], "left_anti"))
    return interpolate(both, ["run"], "ms", "value").where(F.col("ms") % step_ms == 0)


def cross_run_mean(runs: DataFrame, step_ms: int) -> DataFrame:
    return align_runs(runs, step_ms).groupBy("ms").agg(F.avg("value").alias("mean_value"), F.count("*").alias("runs"))


def savgol_coefficients(window: int, order: int, at: int) -> list[float]:
    """Weights of the least-squares polynomial of a window, read at one place of it."""
    import numpy as np

    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return (np.vander([at - window // 2], order + 1, increasing=True) @ np.linalg.pinv(x))[0].tolist()


def savgol(rows: DataFrame, by: list[str], order_by: str, value: str, window: int = 11, order: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing: fixed weights inside; the first and last half windows read the polynomial of the end's window."""
    w, half = W.partitionBy(*by).orderBy(order_by), window // 2
    values = F.collect_list(value).over(w.rowsBetween(-(window - 1), window - 1))
    r = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*by))).withColumn("_v", values)
    # place of the window's first row within _v, and of the row within the window
    first = F.greatest(F.lit(0), F.least(F.col("_i") - half, F.col("_n") - window))
    r = r.withColumn("_from", first - F.greatest(F.col("_i") - (window - 1), F.lit(0)) + 1).withColumn("_at", F.col("_i") - first)
    smooth = F.lit(None).cast("double")
    for at in range(window):
        c = savgol_coefficients(window, order, at)
        total = sum((F.try_element_at("_v", (F.col("_from") + k).cast("int")) * c[k] for k in range(1, window)), F.try_element_at("_v", F.col("_from").cast("int")) * c[0])
        smooth = F.when(F.col("_at") == at, total).otherwise(smooth)
    return r.withColumn("smoothed", F.when(F.col("_n") >= window, smooth)).drop("_i", "_n", "_v", "_from", "_at")


def throughput(log: DataFrame) -> DataFrame:
    """Rates since the run's begin from totals."""
    t = F.col("time_seconds")
    return log.withColumn("iterations_rate", F.when(t > 0, F.col("iterations_total") / t)).withColumn("cycles_rate", F.when(t > 0, F.col("cycles_total") / t))


def align_on_index(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Columns of both side by side, outer on the index."""
    return left.join(right, index, "full_outer")
