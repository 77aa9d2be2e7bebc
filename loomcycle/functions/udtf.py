"""Table functions and aggregates for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomcycle.streaming.windows import SCHEMA, window_cycles


@udtf(returnType=SCHEMA)
class SubgraphCycles:
    """SELECT * FROM subgraph_cycles(edges, omega, begin, next_begin, max_length): depth-first search in one
    small subgraph, edges being ARRAY<STRUCT<src, dst, t, edge_key>>. For whole graphs the joins are the way."""

    def eval(self, edges, omega: int, begin: int, next_begin: int, max_length: int):
        rows = [(e["src"], e["dst"], e["t"], e["edge_key"]) for e in edges or []]
        for found in window_cycles(rows, omega, next_begin, max_length):
            if found[1] >= begin:
                yield found


def register(spark: SparkSession) -> None:
    spark.udtf.register("subgraph_cycles", SubgraphCycles)
