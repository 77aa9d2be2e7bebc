"""Cycles from a stream of edges, and the depth-first search of one small window.

A cycle that starts at t1 lies within [k omega, (k + 2) omega) for k = floor(t1 / omega), so once no edge before
(k + 2) omega can come any more, all cycles that start in window k are found from windows k and k + 1.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loomcycle.operators.cycles import temporal_cycles

SCHEMA = "root long, t_start long, t_end long, length int, path array<long>, times array<long>, edge_keys array<long>"


def window_cycles(edges: list[tuple[int, int, int, int]], omega: int, first_half_end: int, max_length: int | None = None) -> Iterator[tuple]:
    """Depth-first search over (src, dst, t, key) of one window, by times and with dead ends cut by the latest return to the root.

    Times ascend, so it ends without a max_length.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    back: dict[int, list[int]] = {}
    for src, dst, t, key in sorted(edges, key=lambda e: e[2]):
        if src != dst:
            out.setdefault(src, []).append((t, dst, key))
            back.setdefault(dst, []).append(t)
    times_of = {v: [t for t, _, _ in found] for v, found in out.items()}
    for root, starts in out.items():
        for t0, second, key0 in starts:
            if t0 >= first_half_end:
                break
            last = bisect_left(back.get(root, ()), t0 + omega)
            if not last or (close := back[root][last - 1]) <= t0:
                continue
            stack = [((root,), (t0,), (key0,), second)]
            while stack:
                path, times, keys, cur = stack.pop()
                if cur == root:
                    yield root, t0, times[-1], len(path), list(path), list(times), list(keys)
                    continue
                if len(path) == max_length or cur in path:
                    continue
                leaving = times_of.get(cur, ())
                for t, nxt, key in out.get(cur, ())[bisect_right(leaving, times[-1]) : bisect_right(leaving, close)]:
                    stack.append(((*path, cur), (*times, t), (*keys, key), nxt))


class CycleStream:
    """Writes the cycles of a stream of edges (src, dst, edge_key, an event time) to a Parquet table, once each.

    A batch adds its edges to a table by window number floor(t / omega). The watermark is the latest time seen less
    2 omega; a window k is closed when it passes (k + 2) omega, and the batch that passes it runs the batch search
    (joins over all executors) over the closed windows and the one after, keeping cycles that start in a closed one.
    Edges behind the watermark of the batches before are late and dropped; nulls in src, dst or time too.
    The last windows need a later edge, or a batch run. Every write names its batch and overwrites, so a batch that
    is run again after a failure changes nothing.
    """

    def __init__(self, omega: int, folder: str, max_length: int | None = None, time_col: str = "ts"):
        self.omega, self.folder, self.max_length, self.time_col = omega, folder, max_length, time_col

    def start(self, edges: DataFrame, **trigger):
        timed = edges.select("src", "dst", "edge_key", F.unix_micros(F.col(self.time_col).cast("timestamp")).alias("t"))
        return timed.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/state").trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def _mark(self, spark, batch_id: int) -> int | None:
        """The latest time that the batches before this one saw."""
        return spark.read.schema("mark long, batch long").parquet(f"{self.folder}/marks").where(F.col("batch") < batch_id).agg(F.max("mark")).first()[0] if batch_id else None

    def batch(self, edges: DataFrame, batch_id: int) -> None:
        spark, omega = edges.sparkSession, self.omega
        seen = self._mark(spark, batch_id)
        fresh = edges.where("src IS NOT NULL AND dst IS NOT NULL AND t IS NOT NULL")
        if seen is not None:
            fresh = fresh.where(F.col("t") >= seen - 2 * omega)
        fresh.withColumn("k", F.floor(F.col("t") / omega)).write.mode("overwrite").partitionBy("k").parquet(f"{self.folder}/edges/batch={batch_id}")
        table = spark.read.schema("src long, dst long, edge_key long, t long, batch long, k long").parquet(f"{self.folder}/edges").where(F.col("batch") <= batch_id)
        latest = table.where(F.col("batch") == batch_id).agg(F.max("t")).first()[0]
        mark = max((m for m in (seen, latest) if m is not None), default=None)
        spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch_id}")
        closed = lambda m: None if m is None else (m - 2 * omega) // omega - 1  # noqa: E731 the first window that is still open
        lo, hi = closed(seen), closed(mark)
        if hi is None or lo == hi:
            return
        due = table.where(F.col("k") <= hi)
        if lo is not None:
            due = due.where(F.col("k") >= lo)
        found = temporal_cycles(due, omega, self.max_length).where(F.col("t_start") < hi * omega)
        if lo is not None:
            found = found.where(F.col("t_start") >= lo * omega)
        found.write.mode("overwrite").parquet(f"{self.folder}/found/batch={batch_id}")


def read_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cycles that a stream has written so far; none, if it has closed no window yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/found")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.parquet(f"{folder}/found").drop("batch")


class ProgressLog(StreamingQueryListener):
    """Rows like a run log's: seconds, input and output totals, state size."""

    def __init__(self):
        self.rows: list[dict] = []
        self.inputs = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = json.loads(event.progress.json)
        self.inputs += p["numInputRows"]
        state = p.get("stateOperators") or [{}]
        self.rows.append({"batch": p["batchId"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000, "iterations_total": self.inputs, "state_rows": state[0].get("numRowsTotal", 0), "memory_usage_bytes": state[0].get("memoryUsedBytes", 0)})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
